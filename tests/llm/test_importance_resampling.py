import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondage.llm import importance_resampling as ir
from sondage.llm._common import ranked

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return w, [" ".join(w[i : i + m]) for m in range(1, order + 1) for i in range(len(w) - m + 1)]


def brute(docs, target, order, buckets, percent, least, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, runs(text, order)[1]))
    for text in target:
        t.update(map(of, runs(text, order)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    out = []
    for i, text in docs:
        w, f = runs(text, order)
        weight = sum(gain[of(x)] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted(map(tuple, out), key=str)


DOCS = [(1, "The cat, the CAT; x2 über Ünder 日本 ok"), (2, None), (3, ""), (4, " ;;--\t"), (5, "one two three four five six"), (6, "one two three four five six"), (6, "the cat"), (None, "the cat sat on the mat again"), (None, "dog"), (7, "word " * 30_000), (8, "Z̈ é\x00nul\x7fdel")] + [(10 + i, f"the cat number {i} sat {i % 7} times here") for i in range(60)]
TARGET = ["the cat sat on the mat", None, "", "about number 7 and a word"]


@pytest.mark.parametrize(("order", "buckets"), [(1, 10_000), (2, 97), (3, 5)])
def test_same_as_brute_force(spark, order, buckets):
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in DOCS], "doc_id long, text string, bucket string, weight int")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = ir.resample(docs, target, order=order, buckets=buckets, percent=30, least_words=6, seed=3)
    assert sorted(map(tuple, out.collect()), key=str) == brute(DOCS, TARGET, order, buckets, 30, 6, 3)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(5, "a b c")] * 40 + [(5, "a b d")] * 10
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    out = ir.resample(docs, target, order=2, percent=50, least_words=2).collect()
    assert len(out) == 50
    assert sorted(r["rank"] for r in out if r["rank"] is not None) == list(range(1, 26))
    assert ir.resample(docs.limit(0), target).collect() == []
    none = ir.resample(docs, target.limit(0), least_words=3, percent=100).collect()
    assert sorted(r["rank"] for r in none) == list(range(1, 51))
    assert {(r["n_features"], r["weight"], r["score"]) for r in none} == {tuple(r[1:4]) for r in brute(rows, [], 1, 10_000, 100, 3, 2024)}


def test_ranks_go_through_all_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 50 AS v").repartition(7)
    out = ranked(df, [F.col("v").desc(), F.col("id").asc()], "rank").collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])] == sorted(range(5000), key=lambda i: (-(i % 50), i))
    assert sorted(r["rank"] for r in out) == list(range(1, 5001))
