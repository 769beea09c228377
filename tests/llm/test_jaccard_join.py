import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest


from sondage.llm._common import components
from sondage.llm._words import chunks, shingles, text_bytes, words
from sondage.llm.jaccard_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text, k=3):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, num=90, den=100):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard_components(df, **options).collect())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(160):
        kind = r.random()
        if kind < 0.5 and rows:
            text = rows[r.randrange(len(rows))].split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                text[r.randrange(len(text))] = r.choice(vocabulary) + str(r.randrange(9))
        else:
            text = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 30, 120]))] + (passage if kind < 0.7 else [])
        rows.append(" ".join(text))
    return [(i, t.upper() if i % 9 == 0 else t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_few_heavy_tokens_change_nothing(spark):
    rows = corpus(3)
    assert run(spark, rows, heavy_docs=2) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c d"), (8, "a  b\tc\x0bd"), (9, "a\u00a0b c d"), (7, "a b c d"), (10, "é\U0001d11e x y z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    long = " ".join(f"x{i}" for i in range(60000))
    assert run(spark, [(1, long), (2, long + " y")]) == [(1, 59998, 1), (2, 59999, 1)]


def test_null_id_and_extra_columns(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, "n"), (5, "a b c d", 2, "m"), (6, "q r s t", 3, "o")], "doc_id long, text string, node int, token string")
    out = {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()}
    assert out == {None: 5, 5: 5, 6: 6}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (50, 49), (50, 49)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 49: 49, 50: 49}
    assert components(edges.where("a < 0")).count() == 0


def test_words_match_the_pattern():
    texts = ["", "a", " a\tB\x0bc\n", "\u00a0x y", "z" * 3000, "a b", None, "é b a"]
    data, at = text_bytes(pa.array(texts))
    h, starts, ends, before = words(data, at)
    flat = [w for t in texts for w in WORD.findall((t or "").translate(LOW))]
    assert [bytes(data[s:e]).decode().translate(LOW) for s, e in zip(starts, ends, strict=True)] == flat
    assert np.diff(before).tolist() == [len(WORD.findall(t or "")) for t in texts]
    same = defaultdict(set)
    for w, x in zip(flat, h, strict=True):
        same[w].add(int(x))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)
    assert len(shingles(h[:2], 3)) == 0
    assert [x for x in chunks(at, 10)][0][0] == 0 and sum(b - a for a, b in chunks(at, 10)) == len(texts)
    sliced = pa.array(texts).slice(2, 3)
    assert len(words(*text_bytes(sliced))[0]) == 6
