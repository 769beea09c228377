import random

import pytest
from pyspark.sql import functions as F

from sondage.llm.warc_revisits import KEPT_FROM_RESPONSE, canonical_url, resolve

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload string, response string"


@pytest.mark.parametrize("url,key", [("https://WWW.Ex.com:443/a/?utm_source=x&b=2&a=1#f", "ex.com/a?a=1&b=2"), ("http://user@m.ex.com", "ex.com"), ("ex.com/index.html", "ex.com"), ("HTTP://ex.com/A/index.php?sid=3", "ex.com/A"), ("", ""), (None, None)])
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == key


def brute(rows):
    out = []
    fold = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
    for r in rows:
        if r[3] != "revisit" or r[0] is None:
            continue
        earlier = [x for x in rows if x[3] == "response" and x[4] == 200 and r[1] is not None and x[1] == r[1] and r[2] is not None and x[2] is not None and x[2] < r[2]]
        own = fold(r[5])
        if not earlier:
            out.append((r[0], None, "no response", own, None))
            continue
        x = max(earlier, key=lambda x: (x[2], x[0]))
        theirs = fold(x[5])
        outcome = "no validator"
        if own.get("etag") and theirs.get("etag"):
            outcome = "etag" if own["etag"].removeprefix("W/") == theirs["etag"].removeprefix("W/") else "mismatch"
        elif own.get("last-modified") and theirs.get("last-modified"):
            outcome = "modified" if own["last-modified"] == theirs["last-modified"] else "mismatch"
        headers = own if outcome == "mismatch" else {**theirs, **{k: v for k, v in own.items() if k not in KEPT_FROM_RESPONSE}}
        out.append((r[0], x[0], outcome, headers, None if outcome == "mismatch" else x[6]))
    return sorted(out, key=lambda x: x[0])


def test_same_as_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(300):
        h = {k: r.choice("ab") for k in ("ETag", "Last-Modified", "Content-Length", "X-a", "Date") if r.random() < 0.6}
        if "ETag" in h and r.random() < 0.5:
            h["ETag"] = "W/" + h["ETag"]
        url = r.choice(["a.com/x", "a.com/x", "a.com/x", "b.com/y", "c.com/z", None])
        rows.append((i, url, r.choice([r.randrange(400), r.randrange(20), None]), r.choice(["response", "revisit", "other"]), r.choice([200, 200, 404]), h if r.random() < 0.9 else None, f"p{i}", "own"))
    rows.append((None, "a.com/x", 5, "revisit", 304, {}, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (1000.0, 16.0, 1.0):
        got = sorted(((x["record_id"], x["response_id"], x["outcome"], x["headers"], x["payload"]) for x in resolve(df, bucket, with_payload=True).collect()), key=lambda x: x[0])
        assert got == brute(rows)
    assert resolve(df.limit(0)).count() == 0


def test_repeated_rows_give_a_row_each(spark):
    one = [("a", "ex.com/x", 1, "response", 200, {"ETag": "1"}, "p", "n"), ("b", "ex.com/x", 5, "revisit", 304, {"etag": "1"}, None, "n")]
    df = spark.createDataFrame(one * 2 + [("b", "ex.com/y", 9, "revisit", 304, None, None, "n")], SCHEMA.replace("record_id long", "record_id string"))
    got = sorted((r["url_key"], r["response_id"] or "", r["outcome"], r["payload"] or "") for r in resolve(df, with_payload=True).collect())
    assert got == [("ex.com/x", "a", "etag", "p")] * 2 + [("ex.com/y", "", "no response", "")]
