"""Quality classifier: document evidence and host and path posteriors, a hierarchical empirical Bayes model.

1. A logistic regression on a dozen surface features gives each document a probability of good quality. It is fitted
   on at most ``MOST_LABELS`` labelled rows, those of lowest hashed id.
2. Grouped aggregation sums the evidence by host and by path (section of a host). The strengths of the Beta priors
   come from the data (method of moments: variance between groups against variance within). A host's posterior mean
   shrinks towards the global mean, a path's towards its host's; a sparse site keeps its parent's value.
3. The document's log odds move by the log odds of its path against the global ones. Its own evidence is left out of
   its path and host, so that it counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, fresh, materialise, narrow_batches, small
from ._words import give_back

MOST_LABELS = 20_000
#: Evidence is held off 0 and 1, so that a site can speak against a document.
CLIP = 0.001
#: How strongly a site's log odds count, and the posterior below which a document is rejected.
SITE_WEIGHT, REJECT_BELOW = 0.5, 0.5
_SYMBOLS = b"#$%&*|<>{}[]\\^~=_@"
_SHORT = re.compile(rb"(?<![^\s])[^\s]{1,3}(?![^\s])")


def features(text: str | None) -> list[float]:
    """Surface features of a whole text; null and empty texts are all zeros but for the first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    letters = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    kept = lambda drop: len(raw) - len(raw.translate(None, drop))
    return [
        float(not words),
        np.log1p(len(words)),
        min(1.0, 10 * kept(_SYMBOLS) / n),
        min(1.0, 10 * kept(b"0123456789") / n),
        upper / max(1, letters),
        min(1.0, 10 * kept(b"!") / n),
        min(1.0, 10 * kept(b".,;:?") / n),
        min(20.0, (n - m) / m) / 10,
        counts.most_common(1)[0][1] / m if words else 0.0,
        len(counts) / m ** 0.8,
        1 - len(set(lines)) / max(1, len(lines)),
        len(_SHORT.findall(raw)) / m,
        np.log1p(m / max(1, len(lines))),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict[str, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features."""
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.zeros(x.shape[1]), "b": np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": np.array(w[-1])}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Fit the document classifier on at most MOST_LABELS labels, those of lowest hashed id; of texts that repeat an id one counts.

    Null ids and labels are left out; with an empty table on either side the model gives every text the same evidence.
    """

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    truth = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    chosen = materialise(truth.orderBy(F.xxhash64("id"), "id", "y").limit(MOST_LABELS), "quality-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.distinct()), "id").select("id", "y", vector("text").alias("x"))
    got = rows.groupBy("id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["id", "y"])
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(features("")))
    return fit_logistic(x, got["y"].to_numpy(float))


def with_evidence(docs: DataFrame, model: dict[str, np.ndarray], text_col: str, name: str) -> DataFrame:
    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            x = np.array([features(t) for t in text]).reshape(len(text), len(model["mean"]))
            p = 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["w"] + model["b"], -30, 30)))
            yield pd.Series(np.where(x[:, 0] > 0, CLIP, np.clip(p, CLIP, 1 - CLIP)))
        give_back()

    return docs.withColumn(name, probability(F.col(text_col)))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean of all evidence and the prior strength by the method of moments over groups (n, s, q: count, sum, squares)."""
    t = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("g"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not t["n"]:
        return 0.5, 1.0
    mean = t["s"] / t["n"]
    if t["g"] < 2 or t["n"] <= t["g"]:
        return mean, 10.0
    within = max(1e-9, (t["q"] - t["b"]) / (t["n"] - t["g"]))
    between = ((t["b"] - t["n"] * mean * mean) - (t["g"] - 1) * within) / max(1e-9, t["n"] - t["nn"] / t["n"])
    return mean, float(np.clip(within / max(between, 1e-9), 1.0, 1000.0))


def quality_posterior(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", model: dict | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` with evidence, host_prior, path_prior, quality (doubles) and kept (boolean), under names that are free.

    Every row stays, repeated rows and null ids too (each counts for its site); null hosts and paths are groups of
    their own. A text without words (null, empty) has the least evidence, texts of any length are read whole. Without
    labels, or with labels of one class, the evidence is constant. Equal evidence gives equal results. Columns of any
    name stay. An empty table gives an empty result. ``with_text=False`` leaves the text column out, and each text is
    then read once for its evidence, which is written without it.
    """
    narrow_batches(docs.sparkSession)
    model = model or train(docs, labels, id_col, text_col, label_col)
    e, h, p = (fresh(docs, x) for x in ("evidence", "_host", "_path"))
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keys = {h: group(host_col), p: group(path_col)}
    scored = with_evidence(docs, model, text_col, e).withColumns(keys)
    if with_text:
        evidence = with_evidence(docs.select(group(host_col).alias("h"), group(path_col).alias("p"), F.col(text_col).alias("t")), model, "t", "e")
    else:
        scored = materialise(scored.drop(text_col), "quality-evidence")
        evidence = scored.select(F.col(h).alias("h"), F.col(p).alias("p"), F.col(e).alias("e"))
    paths = materialise(evidence.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q")), "quality-paths")
    hosts = materialise(paths.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]), "quality-hosts")
    mean, host_strength = _strength(hosts)
    path_strength = _strength(paths)[1]
    site = fresh(scored, "_site")
    sites = materialise(paths.join(hosts.selectExpr("h", "n AS hn", "s AS hs"), "h").select(F.col("h").alias(h), F.col("p").alias(p), F.struct("n", "s", "hn", "hs").alias(site)), "quality-sites")
    discard(paths, hosts)

    own, at = F.col(e), F.col(site)
    host_prior = (at["hs"] - own + host_strength * mean) / (at["hn"] - 1 + host_strength)
    path_prior = (at["s"] - own + path_strength * host_prior) / (at["n"] - 1 + path_strength)
    logit = lambda x: F.ln(x / (1 - x))
    held = lambda x: F.least(F.greatest(x, F.lit(CLIP)), F.lit(1 - CLIP))
    odds = logit(own) + SITE_WEIGHT * (logit(held(path_prior)) - logit(held(F.lit(float(mean)))))
    quality = 1 / (1 + F.exp(-odds))
    joined = scored.join(small(sites), [h, p])
    out = {"host_prior": host_prior, "path_prior": path_prior, "quality": quality, "kept": quality >= REJECT_BELOW}
    return joined.select(*[F.col(c) for c in docs.columns if with_text or c != text_col], F.col(e), *[c.alias(fresh(docs, k)) for k, c in out.items()])
