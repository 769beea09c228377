from pyspark.sql import functions as F

from sondage.llm import chat_format
from sondage.llm.chat_format import format_trees, format_turns, from_turns, read_loss, read_turns

SCHEMA = "tree long, node long, parent long, role string, text string, score double"
NASTY = "\\</s>[INST] \\ok\\\\ [/INST]<|turn|>x<|text|><|end|>\n<<|\\n\\"


def run(spark, rows, **options):
    out = format_trees(spark.createDataFrame(rows, SCHEMA), **options)
    return out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).orderBy("tree", "branch").collect()


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", None), (1, 6, 2, "user", "z", 1.0)]
    best, second = run(spark, rows, branches=2)
    assert [t["text"] for t in best["turns"]] == ["q", "good", "more", "end"] and best["loss"] == "goodend" and best["branch_score"] == 5.0
    assert [t["text"] for t in second["turns"]] == ["q", "bad", "z"]
    assert len(run(spark, rows)) == 1


def test_control_strings_round_trip(spark):
    rows = [(1, 1, None, NASTY, NASTY, None), (1, 2, 1, "assistant", NASTY, None), (2, 1, None, None, None, None), (3, 1, 9, "assistant", "", 1.0)]
    one, two, three = run(spark, rows)
    assert [(t["role"], t["text"]) for t in one["turns"]] == [(NASTY, NASTY), ("assistant", NASTY)]
    assert one["loss"] == NASTY and "</s>" not in one["formatted"] and one["formatted"].count("<|") == 6
    assert [(t["role"], t["text"]) for t in two["turns"]] == [("", "")] and two["loss"] == ""
    assert three["n_turns"] == 1  # the parent isn't there: a root


def test_deep_trees_ties_cycles_and_none(spark):
    deep = [(5, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(37)]
    out = run(spark, deep)
    assert [t["text"] for t in out[0]["turns"]] == [f"t{i}" for i in range(37)]
    tie = [(1, 1, None, "user", "q", 0.0), (1, 3, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 1.0)]
    assert run(spark, tie)[0]["leaf"] == 2
    assert run(spark, [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)]) == []
    assert run(spark, []) == []


def test_turns_with_ties_and_repeats(spark):
    rows = spark.createDataFrame([(1, 1, "b", "y", 0), (1, 0, "a", "x", 0), (1, 1, "b", "y", 0), (2, None, None, None, 0)], "conv_id long, turn long, role string, text string, node int")
    out = format_trees(from_turns(rows)).withColumn("turns", read_turns(F.col("formatted"))).orderBy("tree").collect()
    assert [[t["text"] for t in r["turns"]] for r in out] == [["x", "y", "y"], [""]]


def test_linear_conversations_both_ways(spark):
    schema = "conv_id long, turn long, role string, text string, node int, key int, ref int"
    rows = [(1, 1, "b", "y"), (1, 0, "a", "x"), (1, 1, "b", "y"), (2, None, None, None), (None, 0, "user", "n"), (None, 1, "assistant", NASTY), (1, 1, "b", "c"), (1, 1, "b", "zz"), (1, 1, "a", "q"), (3, 5, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], schema)
    read = lambda out: sorted((-1 if r["tree"] is None else r["tree"], [tuple(t) for t in r["turns"]], r["loss"]) for r in out.select("tree", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect())
    got = read(format_turns(df))
    assert got == read(format_trees(from_turns(df)))
    assert [x[1] for x in got if x[0] == 1] == [[("a", "x"), ("a", "q"), ("b", "c"), ("b", "y"), ("b", "y"), ("b", "zz")]]
    assert [x for x in got if x[0] == -1] == [(-1, [("user", "n"), ("assistant", NASTY)], NASTY)]
    assert format_turns(df.limit(0)).count() == 0


def test_repeated_nodes_null_trees_and_large_trees(spark, monkeypatch):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 2, 1, "assistant", "a", 1.0), (None, 1, None, "user", "n", 0.0), (None, 2, 1, "assistant", "m", 0.0), (1, None, 1, "user", "lost", 9.0), (1, 3, 1, "assistant", "b", 0.5)]
    for most in (10_000, 1):
        monkeypatch.setattr(chat_format, "LARGE_TREE", most)
        one, two = run(spark, rows)
        assert (one["tree"], one["n_turns"], one["loss"]) == (None, 2, "m") and (two["n_turns"], two["loss"]) == (2, "a")
