import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sondage.llm import fingerprints as fp
from sondage.llm._words import mix, words
from sondage.llm.queries import QUERIES, table

DOCS = [(4, "One two two three four"), (9, "one TWO  two three four"), (1, ""), (2, None), (7, "日本 語 über 😀 x"), (20, "alpha beta gamma " * 900), (21, "alpha beta gamma " * 899 + "delta"), (-3, "b"), (40, " \t\n"), (60, "alpha beta gamma " * 900)]


def plain_print(text):
    """Bits by a loop over words; only the hash of a word is the module's."""
    votes = np.zeros(256, np.int64)
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", lower)).items():
        raw = w.encode()
        h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        for b in range(4):
            x = int(mix(h + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64))[0])
            votes[b * 64 : b * 64 + 64] += np.array([1 if x >> (63 - i) & 1 else -1 for i in range(64)]) * math.floor(16 * math.sqrt(n))
    return "".join("1" if v > 0 else "0" for v in votes)


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def brute(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        p, q, n = plain_print(t), plain_print(e), plain_print(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{int(p, 2):064x}", f"{int(q, 2):064x}", likeness(p, q), likeness(p, n)))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, range string")


@pytest.mark.parametrize("parts", [1, 5])
def test_same_as_brute_force(spark, parts):
    out = fp.neighbours(frame(spark, DOCS).repartition(parts))
    assert sorted(map(tuple, out.collect())) == brute(DOCS)


def test_odd_tables(spark):
    assert fp.edited(frame(spark, [])).collect() == []
    assert [tuple(r)[:2] for r in fp.neighbours(frame(spark, [(5, "a b")])).collect()] == [(5, 3)]
    rows = [(5, "x y z")] * 30 + [(5, "x y w")] * 30 + [(None, "q")] * 2
    out = fp.edited(frame(spark, rows)).collect()
    assert len(out) == 62
    assert len({r["fingerprint"] for r in out}) == 3
    assert {r["n_near"] for r in out if r["doc_id"] is None} == {None}


def test_search_finds_all_within_the_radius(spark):
    """Random bits and clusters at every distance; tables of single blocks and of pairs of blocks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (30, 32), dtype=np.uint8)
    prints = [b for b in base]
    for b in base:
        for d in (1, 3, 6, 9, 10, 14):
            bits = np.unpackbits(b)
            bits[rng.choice(256, d, replace=False)] ^= 1
            prints.append(np.packbits(bits))
    prints += prints[:40]
    hexes = [p.tobytes().hex() for p in prints]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hexes)] + [(900, None)], "id long, fingerprint string")
    asked = df.where("id % 3 = 0")
    for radius, agree in ((9, 1), (5, 2)):
        got = {r["fingerprint"]: (r["n_near"], r["matches"]) for r in fp.search(asked, df, radius, agree).collect()}
        far = fp.distances(np.stack(prints)[:, None, :], np.stack(prints)[None, :, :])
        want = {hexes[i]: (int((far[i] <= radius).sum()), sorted({hexes[j] for j in np.flatnonzero(far[i] <= radius)})) for i in range(0, len(hexes), 3)}
        assert got == want
    assert fp.search(asked.limit(0), df).collect() == []
    assert {r["n_near"] for r in fp.search(asked.where("id = 0"), df.limit(0)).collect()} == {0}


def test_crowded_keys_are_dealt_to_chunks(spark, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 8)
    rng = np.random.default_rng(4)
    base, prints = np.unpackbits(rng.integers(0, 256, 32, dtype=np.uint8)), []
    for _ in range(120):
        bits = base.copy()
        bits[rng.choice(256, 5, replace=False)] ^= 1
        prints.append(np.packbits(bits))
    hexes = [p.tobytes().hex() for p in prints]
    df = spark.createDataFrame([(h,) for h in hexes], "fingerprint string")
    far = fp.distances(np.stack(prints)[:, None, :], np.stack(prints)[None, :, :])
    assert {r["fingerprint"]: r["n_near"] for r in fp.search(df, df, with_matches=False).collect()} == {h: int(n) for h, n in zip(hexes, (far <= 9).sum(axis=1), strict=True)}


def test_votes_in_blocks(monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 3)
    texts = ["a b c d e f g " * 5 + "x y", "", "q", "l " * 1_200_000 + "m n o p"]
    assert [p.tobytes().hex() for p in fp.simhash(pa.array(texts))] == [f"{int(plain_print(t), 2):064x}" for t in texts]


def test_narrow_tables_are_written_in_few_files(spark, monkeypatch):
    """Each file on a local disk costs a process in the executor; only the ranges of the order have files of their own."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    written = {}

    def kept(df, name, write=fp.materialise):
        out = write(df, name)
        written[name] = out.inputFiles()
        return out

    monkeypatch.setattr(fp, "materialise", kept)
    try:
        out = fp.edited(frame(spark, [(i, f"a{i} b{i % 7} c{i // 3} d e f") for i in range(400)]))
        assert out.rdd.getNumPartitions() == 1 and out.count() == 400
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(written["prints-tables"]) == 1 and sum(map(len, written.values())) <= 40 + 1 + 1


def test_query_over_the_whole_table(spark, sf_dir):
    out = {r["doc_id"]: r for r in QUERIES["op13_document_fingerprints"](spark, sf_dir).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    assert sorted(out) == [i for i, _ in docs]
    prints = {i: np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint8) for i, r in out.items()}
    own = fp.simhash(pa.array([t for _, t in docs]))
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)]
        e = t[: len(t) - len(t) // 2] + after[1][: len(t) // 2]
        assert (prints[i] == own[k]).all()
        assert out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert out[i]["near_next"] == 1 - fp.distances(own[k], own[(k + 1) % len(docs)]) / 256
        assert out[i]["n_near"] == (int((fp.distances(own[k], own) <= 9).sum()) - 1 if i % 20 == 0 else None)
    assert sum(r["near_edited"] > r["near_next"] for r in out.values()) > 0.98 * len(out)
