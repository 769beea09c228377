import random
import re

from sondage.llm.decontamination import candidates, contaminated, decontaminate, item_index, item_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def grams(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, items):
    ds, its = {}, {}
    for i, t in docs:
        ds.setdefault(i, set()).update(grams(t))
    for i, t in items:
        its.setdefault(i, set()).update(grams(t))
    return sorted((d, i, len(q), len(q & s)) for d, s in ds.items() for i, q in its.items() if d is not None and i is not None and q and len(q & s) / len(q) >= 0.8)


def data(seed=1):
    r = random.Random(seed)
    say = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(r.randrange(20)) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([2, 5, 12, 30, 70])))) for i in range(25)]
    docs = []
    for d in range(150):
        w = say(r.choice([0, 3, 60, 400]))
        if d % 2:
            part = items[r.randrange(25)][1].split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                part[r.randrange(len(part))] = "changed"
            if r.random() < 0.3:
                part = part[: len(part) * 3 // 4]
            at = r.randrange(len(w) + 1)
            w = w[:at] + [x.upper() for x in part] + w[at:]
        docs.append((d, "  ".join(w)))
    return docs + [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (None, items[1][1])], items + [(60, None), (61, ""), (0, items[0][1]), (62, items[1][1])]


def test_same_as_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 0, "n") for x in docs], "doc_id long, text string, token int, n_item string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contaminated(d, q).collect())
    assert got == brute(docs, items) and len(got) > 30
    bad = {x[0] for x in got}
    assert sorted((x["doc_id"] for x in decontaminate(d, q).collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)
    assert decontaminate(d, q).columns == d.columns
    assert contaminated(d.limit(0), q).count() == contaminated(d, q.limit(0)).count() == 0


def test_sketches_cannot_miss(spark):
    """A document may lack any n - ceil(0.8 n) shingles and still shares what is required."""
    _, items = data(3)
    sets = item_sets(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5)
    rows = item_index(sets, 0.8, common=2).collect()
    sizes, sketch, required = {}, {}, {}
    for r in rows:
        sizes[r["entry"]], required[r["entry"]] = r["n_item"], r["required"]
        sketch[r["entry"]] = sketch.get(r["entry"], 0) + r["in_sketch"]
    assert len({r["entry"] for r in sets.collect()}) == len(sizes) < sets.count()  # equal items are one entry
    assert all(1 <= required[i] <= sketch[i] - (n - -(-8 * n // 10)) for i, n in sizes.items())


def test_items_that_share_a_prompt_make_no_pairs(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(10**6)) for _ in range(n))
    prompt = "choose the best answer to the question "
    items = [(i, prompt + say(20)) for i in range(400)]
    docs = [(i, f"{say(30)} {prompt}{say(30)}") for i in range(300)] + [(900 + i, f"{say(9)} {items[i][1]} {say(9)}") for i in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = item_index(item_sets(q, "item_id", "text", 5), 0.8)
    assert candidates(d, index, 5).count() == 20
    assert sorted((x["doc_id"], x["item_id"]) for x in contaminated(d, q).collect()) == [(900 + i, i) for i in range(20)]


def test_items_that_share_most_of_their_text_are_all_found(spark):
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(40)]
    items = [(i, " ".join([*base[:30], *(f"x{i}_{j}" for j in range(i % 9)), *base[30:]])) for i in range(30)]
    docs = [(i, " ".join([*base, f"y{i}"]) if i % 2 else " ".join(base[:25])) for i in range(20)] + [(50, items[8][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in contaminated(d, q).collect())
    assert got == brute(docs, items) and len(got) > 60
