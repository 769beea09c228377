from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    import corpus_pipeline as p
    from tests.llm.test_decontamination import brute as leaks
    from tests.llm.test_jaccard_join import brute as groups

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    seen = [docs.cache()]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir).cache()
        assert out.columns == docs.columns
        assert out.join(seen[-1], "doc_id", "left_anti").count() == 0
        seen.append(out)
    text = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = seen[1].join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert kept > 0.95 and seen[1].join(labels.where("quality = 1"), "doc_id").count() > 0.97 * docs.join(labels.where("quality = 1"), "doc_id").count()
    assert sorted(i for i, _ in text(seen[3])) == sorted(i for i, _, c in groups(text(seen[2])) if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {x[0] for x in leaks(text(seen[3]), items)}
    assert sorted(i for i, _ in text(seen[4])) == sorted(i for i, _ in text(seen[3]) if i not in bad)
    final = p.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(i for i, _ in text(seen[4])) and all(r["parity"] and r["round_trip"] for r in final)


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    words = lambda a: " ".join(f"word{a + i}, and more" for i in range(40)) + "."
    rows = [(1, words(0), "en", "h", 9), (1, words(0), "en", "h", 9), (2, words(0) + " end", "en", "h", 9), (None, words(500), "en", None, 9), (4, None, None, None, None), (5, "", "en", "h", 0), (6, " ".join(f"word{i}, and more" for i in range(10_000, 26_000)) + ".", "en", "h", 9), (7, words(3000), "en", "h", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    extra = docs.withColumns({c: F.lit(1) for c in ("evidence", "kept", "node", "token", "h", "_id", "rep")})
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(3000, words(3000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, extra, docs.limit(0)):
        seen = table
        for _, stage in p.STAGES[:-1]:
            seen = stage(spark, seen, str(tmp_path))
            assert seen.columns == table.columns
        got = sorted((r["doc_id"] is not None, r["doc_id"]) for r in seen.collect())
        out = p.STAGES[-1][1](spark, seen, str(tmp_path))
        assert out.count() == len(got)
        if table is not docs.limit(0) and got:
            assert [i for _, i in got] == [None, 1, 1, 6]


def test_sizes_of_any_kind_or_none(spark):
    """n_chars follows the text that is left, whatever its type; without the column nothing is added."""
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "h", "en", "5")], "doc_id long, text string, source string, lang string, n_chars string")
    assert [r["n_chars"] for r in p.quality_rule_filter(spark, docs, "").collect()] == [str(len(text))]
    assert [r["n_chars"] for r in p.quality_rule_filter(spark, docs.withColumn("n_chars", F.lit(None).cast("int")), "").collect()] == [len(text)]
    assert p.quality_rule_filter(spark, docs.drop("n_chars"), "").columns == ["doc_id", "text", "source", "lang"]


def test_a_run_leaves_only_the_last_rows(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from sondage.llm import _common

    monkeypatch.setattr(_common, "shared_dir", lambda _: str(tmp_path))
    assert p.run(spark, sf_dir).count() > 0
    assert [x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()] == ["pipeline-benchmark-decontamination"]


def test_a_session_without_a_shared_folder(spark, monkeypatch):
    from sondage.llm import _common

    class Conf:
        def get(self, *_):
            return None

    class Local:
        conf, sparkContext = Conf(), spark.sparkContext

    first = _common.shared_dir(Local())
    assert first and _common.shared_dir(Local()) == first
