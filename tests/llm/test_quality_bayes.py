import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm.quality_bayes import features, fit_logistic, quality_posterior

SCHEMA = "doc_id long, text string, lang string, source string, evidence string"


def test_held_out_accuracy(spark, sf_dir):
    path = f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"  # enough labels for a held-out half
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    out = quality_posterior(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "truth"), "doc_id").select("kept", "truth").collect()
    right = [r["kept"] == bool(r["truth"]) for r in out]
    assert len(out) > 100 and np.mean(right) > 0.97
    assert np.mean([r["kept"] for r in out if r["truth"]]) > 0.99


def test_sites_shrink_towards_their_parents(spark):
    good, bad = "some clean words of a normal sentence, ended here. " * 6, "%%% $$$ ### " * 40
    rows = [(i, good if i % 10 else bad, "en", "good", "x") for i in range(100)] + [(200 + i, bad if i % 10 else good, "en", "bad", "x") for i in range(100)] + [(400, good, "fr", "new", "x"), (401, None, None, None, None), (402, "", "en", "bad", "x"), (0, good, "en", "good", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", F.when(F.col("text").contains("clean"), 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic")).where("doc_id < 400")
    out = quality_posterior(df, labels)
    assert out.columns[:5] == df.columns and out.count() == len(rows)  # evidence is taken: a free name is used
    r = {x["doc_id"]: x for x in out.collect()}
    assert r[1]["host_prior"] > 0.8 > 0.3 > r[201]["host_prior"]
    mean = np.mean([x["_evidence"] for x in r.values()])
    assert abs(r[400]["host_prior"] - mean) < 0.1 and r[400]["kept"] and r[400]["quality"] > 0.5
    assert not r[201]["kept"] and r[1]["kept"] and not r[401]["kept"]
    assert r[201]["quality"] < 0.5 < r[200]["quality"] < r[1]["quality"]


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", "x")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_posterior(df, labels).first()["_evidence"] == pytest.approx(0.5)
    assert quality_posterior(df.limit(0), labels).count() == 0


def test_logistic_fit():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * r.normal(size=500) > 0).astype(float)
    m = fit_logistic(x, y)
    assert (((x - m["mean"]) / m["scale"] @ m["w"] + m["b"] > 0) == y).mean() > 0.95
    assert len(features(None)) == len(features("a b\nc" * 1000)) and features("")[0] == 1.0


def test_priors_by_hand(spark):
    """Evidence as it comes, then counts, strengths, shrunken means and odds in plain loops."""
    good, bad = "some clean words of a normal sentence, ended here. " * 5, "%%% $$$ ### " * 30
    r = np.random.default_rng(3)
    rows = [(i, good if r.random() < (0.9 if i % 4 else 0.2) else bad, "ab"[i % 2], None if i % 4 == 3 else f"h{i % 4}", "x") for i in range(120)] + [(200, good, "a", "lone", "x"), (0, bad, "a", "h0", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("_n", "_h", "_s", "_p", "_hn", "_host", "h", "p", "kept")})
    labels = df.select("doc_id", F.when(F.col("text").contains("clean"), 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic")).where("doc_id BETWEEN 1 AND 100")
    out = [x.asDict() for x in quality_posterior(df, labels).collect()]
    again = quality_posterior(df, labels, with_text=False)
    assert "text" not in again.columns and len(out) == again.count() == 122
    key = [((x["source"],), (x["source"], x["lang"])) for x in out]
    e = np.array([x["_evidence"] for x in out])
    mean = e.mean()

    def groups(level):
        names = sorted({k[level] for k in key}, key=str)
        return {n: e[[i for i, k in enumerate(key) if k[level] == n]] for n in names}

    def strength(g):
        n, total = np.array([len(v) for v in g.values()]), len(e)
        within = sum(((v - v.mean()) ** 2).sum() for v in g.values()) / (total - len(g))
        between = (sum(len(v) * v.mean() ** 2 for v in g.values()) - total * mean**2 - (len(g) - 1) * within) / (total - (n**2).sum() / total)
        return float(np.clip(within / max(between, 1e-9), 1, 1000))

    hosts, paths = groups(0), groups(1)
    hk, pk = strength(hosts), strength(paths)
    logit = lambda p: np.log(p / (1 - p))
    for x, k, own in zip(out, key, e, strict=True):
        host = (hosts[k[0]].sum() - own + hk * mean) / (len(hosts[k[0]]) - 1 + hk)
        path = (paths[k[1]].sum() - own + pk * host) / (len(paths[k[1]]) - 1 + pk)
        odds = logit(own) + 0.5 * (logit(np.clip(path, 0.001, 0.999)) - logit(mean))
        assert (x["host_prior"], x["path_prior"], x["quality"]) == pytest.approx((host, path, 1 / (1 + np.exp(-odds))), rel=1e-6)
        assert x["_kept"] == (x["quality"] >= 0.5)
