import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sondage.llm._words import text_bytes
from sondage.llm.lm_scoring import ORDER, Table, grams, scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return WORD.findall((text or "").translate(LOW))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def stream(text, order):
    return [10] * order + list(" ".join(tokens(text)).encode()) + [10]


def brute(rows, order=ORDER):
    """A plain trie of dictionaries, one symbol at a time, with exclusion sets."""
    counts, trie, n_docs = Counter(), defaultdict(Counter), 0
    for i, t in rows:
        if not held(i):
            n_docs += 1
            counts.update(tokens(t))
            s = stream(t, order)
            for p in range(order, len(s)):
                for k in range(order + 1):
                    trie[tuple(s[p - k : p])][s[p]] += 1
    if n_docs:
        counts["\n"] = n_docs
    total, distinct = sum(counts.values()), len(counts)

    def log_p(context, symbol):
        out, excluded = 0.0, set()
        for k in range(len(context), -1, -1):
            here = trie.get(tuple(context[len(context) - k :]))
            if not here:
                continue
            left = {s: n for s, n in here.items() if s not in excluded}
            room = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / room)
            if left:
                out += math.log10(len(left) / room)
            excluded |= set(left)
        return out - math.log10(256 - len(excluded))

    result = {}
    for i, t in rows:
        w = [*tokens(t), "\n"]
        s = stream(t, order)
        base = sum(math.log10((counts[x] + 1) / (total + 1 * (distinct + 1))) for x in w)
        result[i] = (held(i), len(w), sum(counts[x] > 0 for x in w), total, base, sum(log_p(s[p - order : p], s[p]) for p in range(order, len(s))))
    return result


def corpus(n, seed):
    r = random.Random(seed)
    parts = ["th", "er", "an", "é", "Ing", "on", "st"]
    return [(i, None if i % 17 == 3 else " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.choice([0, 1, 5, 40])))) for i in range(n)]


@pytest.mark.parametrize("words", [1 << 19, 5])
def test_same_as_a_plain_trie(spark, monkeypatch, words):
    from sondage.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "MOST_WORDS", words)  # few: the rest meets its counts in the join
    rows = corpus(80, 4) + [(500, "zebra \U0001d11e\tQUILT"), (501, ""), (506, "x")]
    want = brute(rows)
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, row int, score string")
    got = {r["doc_id"]: tuple(r)[1:] for r in scores(df).collect()}
    assert len(got) == len(rows)
    for i, (h, n, known, total, base, score) in want.items():
        assert got[i][:4] == (h, n, known, total)
        assert got[i][4] == pytest.approx(base, abs=1e-7) and got[i][5] == pytest.approx(score, abs=1e-7)


@pytest.mark.parametrize("nodes", [0, 40])
def test_broadcast_bound_changes_no_score(spark, monkeypatch, nodes):
    from sondage.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "MOST_NODES", nodes)  # few: the rest meets its probabilities in the joins
    monkeypatch.setattr(lm_scoring.trie, "__defaults__", (ORDER, nodes))
    rows = corpus(80, 4) + [(500, "zebra \U0001d11e\tQUILT"), (501, ""), (506, "x")]
    want = brute(rows)
    got = {r["doc_id"]: r["score"] for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(held(i) for i in got) and got == pytest.approx({i: w[5] for i, w in want.items()}, abs=1e-7)


def test_probabilities_of_a_context_sum_to_one(spark):
    from sondage.llm.lm_scoring import corpus_counts, trie

    rows = spark.createDataFrame(corpus(60, 2), "id long, text string")
    for most in (3_000_000, 60):  # a pruned trie too
        model = trie(corpus_counts(rows).where("kind = 1").select("key", "n"), most=most)
        for context in (b"\n\n\n\n\n", b"ether", b"zzzzz", b"zzzer", b" an\xc3\xa9"):
            code = int.from_bytes(context, "big") << 8
            p = model.score(np.array([code | s for s in range(256)], np.uint64))
            assert float((10**p).sum()) == pytest.approx(1.0, abs=1e-9)


def test_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert scores(df([])).count() == 0
    out = next(i for i in range(100) if held(i))
    row = scores(df([(out, "ab")])).first()  # nothing to learn from
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0.0
    assert row["score"] == pytest.approx(-3 * math.log10(256))
    twice = scores(df([(0, "a b"), (0, "a b"), (None, "a")])).collect()
    assert len(twice) == 3 and all(r["train_tokens"] == 8 for r in twice)


def test_model_knows_its_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    real = docs.where("length(text) > 1000").orderBy("doc_id").select("doc_id").collect()
    known = next(r["doc_id"] for r in real if held(r["doc_id"]))
    other = next(i for i in range(-1, -100, -1) if held(i))  # neither is learned from
    backwards = docs.where(f"doc_id = {known}").selectExpr(f"{other}L AS doc_id", "reverse(text) AS text")
    got = {r["doc_id"]: r["score"] for r in scores(docs.unionAll(backwards)).where(f"doc_id IN ({known}, {other})").collect()}
    assert got[known] > got[other]


def test_grams_and_table():
    texts = ["ab c", "", None, " X\n", "q" * 9]
    code, upto, _ = grams(*text_bytes(pa.array(texts)))
    want = [bytes(s[i : i + ORDER + 1]) for s in (stream(t, ORDER) for t in texts) for i in range(len(s) - ORDER)]
    assert [int(c).to_bytes(ORDER + 1, "big") for c in code] == want
    assert np.diff(upto).tolist() == [len(stream(t, ORDER)) - ORDER for t in texts]
    keys = np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64)
    keys = np.unique(keys)
    t = Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1 << 61)) == -1).all()
    assert (Table(keys[:0]).find(keys) == -1).all()
