import re
from collections import Counter, defaultdict

from sondage.llm.quality_rules import apply_rules, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return " ".join(WORD.findall(line.translate(LOW)))


def brute(rows, min_docs, min_share):
    docs, sizes = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in rows:
        sizes[s].add(t)
        for x in (t or "").split("\n"):
            docs[s, normal(x)].add(t)
    bad = {k for k, v in docs.items() if k[1] and len(v) > min_docs and len(v) > min_share * len(sizes[k[0]])}
    out = []
    for i, t, _, s, _ in rows:
        b = base(t)
        gone = sum(len(normal(x).split(" ")) for x in (t or "").split("\n") if (s, normal(x)) in bad)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        left = b[0] - gone
        out.append((i, *b, failed, gone, not failed and left >= 0.2 * b[0] and left >= 20))
    return sorted(out, key=str), bad


def rows():
    own = lambda i: " ".join(f"w{i}_{j}" for j in range(60))
    out = [(i, f"{own(i)}\nCookie  notice {'big' if i % 2 else 'BIG'}\n{own(i + 1000)}", "en", "h" if i % 3 else None, 1) for i in range(12)]
    out += [(20, "many words " * 40, "en", "h", 1), (21, None, "en", "h", 1), (22, "", None, None, 0), (23, "\n \n#a\n#a\n", "x", "h", 9)]
    out += [(30 + i, "\n".join(f"shared line number {k} of the page with words" for k in range(9)) + f"\nonly {i} here", "en", "t", 1) for i in range(6)]
    out += [(40, out[0][1], "en", "h", 1), (40, out[0][1], "en", "h", 1)]
    return out


def test_same_as_brute_force(spark):
    want, bad = brute(rows(), 4, 0.1)
    df = spark.createDataFrame(rows(), SCHEMA)
    got = sorted((tuple(r) for r in verdicts(df, min_docs=4, min_share=0.1).collect()), key=str)
    assert got == want and bad
    assert [r["kept"] for r in got_rows(df)] == [False] * 6
    assert verdicts(df.limit(0)).count() == 0


def got_rows(df):
    return verdicts(df, min_docs=4, min_share=0.1).where("doc_id BETWEEN 30 AND 35").collect()


def test_lines_go_and_the_rest_stays(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumnRenamed("n_chars", "removed")
    out = {r["doc_id"]: r["text"] for r in apply_rules(df, min_docs=4, min_share=0.1).collect()}
    assert set(out) == {*range(12), 40}
    assert all("otice" not in out[i] for i in range(12) if i % 3)  # above the limit of their host
    assert all("otice" in out[i] for i in range(0, 12, 3))  # host null has four such documents
    assert apply_rules(df, min_docs=4, min_share=0.1).columns == df.columns
    same = {r["doc_id"]: r["text"] for r in apply_rules(df, min_docs=99).collect()}
    assert same[3] == rows()[3][1]


def test_copies_count_once_unless_told_apart(spark):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(8))
    near = [(100 + i, text + f"\nonly in number {i}", None, "n", 1) for i in range(30)]
    df = spark.createDataFrame([(i, text, None, "h", 1) for i in range(50)] + near, SCHEMA)
    out = {r["doc_id"]: r["kept"] for r in verdicts(df).collect()}
    assert all(out[i] for i in range(50))  # exact copies are one document
    assert not any(out[100 + i] for i in range(30))  # near copies above the limit of a host lose what they share, and go
    by_id = {r["doc_id"]: r["kept"] for r in verdicts(df, document_col="doc_id").collect()}
    assert not any(by_id.values())


def test_names_nulls_and_long_texts(spark):
    own = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(None, own, "a", 1, 2), ("x", own, None, 1, 2)], "doc_id string, text string, source string, t int, host int")
    assert [(r["doc_id"], r["n_words"], r["kept"]) for r in verdicts(df).orderBy("doc_id").collect()] == [(None, 60_000, True), ("x", 60_000, True)]
    assert apply_rules(df).columns == df.columns and apply_rules(df).count() == 2
