"""Resistivity lines: schemes, coverage, missing readings, trimming, grouping and reciprocity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import geometric_factor, median_depth
from ..plans.ordered import few, quantiles


def dipole_dipole(spark: SparkSession, electrodes: int, n_max: int = 8, a_max: int = 1) -> DataFrame:
    """(a, b, m, n) of every dipole-dipole reading of a line; indices from 0."""
    one = spark.range(1).select(F.lit(electrodes).alias("e"), F.lit(n_max).alias("k"), F.lit(a_max).alias("d"))
    return dipole_dipole_lines(one, "e", "k", "d", []).select(*"abmn")


def dipole_dipole_lines(lines: DataFrame, electrodes: str, n_max: str, a_max: str, by: list[str]) -> DataFrame:
    """(by, a, b, m, n) of every dipole-dipole reading of each line, whose size and reach are columns."""
    upto = lambda least, most: F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: (i >= least) & (i <= most))
    whole = lambda c: F.col(c).cast("int")
    rows = lines.select(*by, whole(electrodes).alias("_e"), whole(n_max).alias("_n"), F.explode(upto(1, whole(a_max))).alias("_d"))
    rows = rows.select(*by, "_e", "_d", F.explode(upto(1, F.col("_n"))).alias("_k"))
    rows = rows.select(*by, "_d", "_k", F.explode(upto(0, F.col("_e") - 1 - F.col("_d") * (F.col("_k") + 2))).alias("b"))
    return rows.select(*by, (F.col("b") + F.col("_d")).alias("a"), "b", (F.col("b") + F.col("_d") * (F.col("_k") + 1)).alias("m"), (F.col("b") + F.col("_d") * (F.col("_k") + 2)).alias("n"))


def wenner(spark: SparkSession, electrodes: int, a_max: int) -> DataFrame:
    rows = spark.range(electrodes).select(F.col("id").cast("int").alias("a")).select("a", F.explode(F.sequence(F.lit(1), F.lit(a_max))).alias("d"))
    return rows.select("a", (F.col("a") + 3 * F.col("d")).alias("b"), (F.col("a") + F.col("d")).alias("m"), (F.col("a") + 2 * F.col("d")).alias("n")).where(F.col("b") < electrodes)


def with_geometry(readings: DataFrame, spacing: float) -> DataFrame:
    """``readings`` with k, x (mean position) and depth; a null electrode is remote."""
    at = {c: F.col(c) * F.lit(spacing) for c in "abmn"}
    r = [F.abs(at[p] - at[q]) for p, q in (("a", "m"), ("b", "m"), ("a", "n"), ("b", "n"))]
    here = F.filter(F.array(*at.values()), lambda v: v.isNotNull())
    mean = F.aggregate(here, F.lit(0.0), lambda s, v: s + v) / F.size(here)
    return readings.withColumn("k", geometric_factor(*r)).withColumn("x", mean).withColumn("depth", median_depth(*r))


def configurations(readings: DataFrame) -> DataFrame:
    """``readings`` with start (left-most electrode) and offsets from it; remote electrodes have a null offset."""
    start = F.least("a", "b", "m", "n")
    return readings.withColumn("start", start).withColumn("offsets", F.array(*[F.col(c) - start for c in "abmn"]))


def _coded(readings: DataFrame) -> DataFrame:
    return configurations(readings).withColumn("code", F.array_join(F.transform("offsets", lambda o: o.cast("string")), "-", "R"))


def coverage(readings: DataFrame, electrodes: int, by: list[str] | None = None) -> DataFrame:
    """Per line (``by``) and configuration: distinct positions measured, possible and missing."""
    out = _coded(readings).groupBy(*(by or []), "code", F.array_max("offsets").alias("reach")).agg(F.count_distinct("start").alias("measured"))
    possible = F.greatest(F.lit(electrodes) - F.col("reach"), F.lit(0)).cast("long")
    return out.select(*(by or []), "code", "measured", possible.alias("possible"), (possible - F.col("measured")).alias("missing"))


def missing(readings: DataFrame, electrodes: int, by: list[str] | None = None) -> DataFrame:
    """The readings that the configurations in use on a line could have there and don't: by, a, b, m, n, null if remote."""
    c, keys = _coded(readings), [*(by or []), "code"]
    seen = c.select(*keys, "start").distinct()
    kind = c.schema["start"].dataType
    used = c.select(*keys, "offsets").distinct().where(F.array_max("offsets") < electrodes)
    every = used.select(*keys, "offsets", F.explode(F.sequence(F.lit(0).cast(kind), (F.lit(electrodes - 1) - F.array_max("offsets")).cast(kind))).alias("start"))
    gone = every.join(seen, [*keys, "start"], "left_anti")
    return gone.select(*(by or []), *[(F.col("start") + F.col("offsets")[i]).alias(p) for i, p in enumerate("abmn")])


def trim(readings: DataFrame, first: int, count: int) -> DataFrame:
    """Readings with all real electrodes in [first, first + count), renumbered from 0."""
    inside = F.forall(F.array(*"abmn"), lambda e: e.isNull() | ((e >= first) & (e < first + count)))
    return readings.where(inside).withColumns({c: F.col(c) - first for c in "abmn"})


def grouped(readings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positive readings of a position: geometric mean, number, deviation of the logarithm, mean, median, least."""
    up = readings.where(F.col(value) > 0)
    out = up.groupBy(*keys).agg(F.exp(F.avg(F.ln(value))).alias("geometric"), F.count(F.lit(1)).alias("n"), F.stddev_samp(F.ln(value)).alias("std_ln"), F.avg(value).alias("mean"), F.min(value).alias("least"))
    mid = few(quantiles(up, keys, value, {"median": 0.5})).select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    on = [out[k].eqNullSafe(mid[f"_{k}"]) for k in keys]
    return out.join(mid, on, "left").select(*keys, "geometric", "n", "std_ln", "mean", "median", "least")


def schlumberger(spark: SparkSession, electrodes: int, n_max: int = 8, a_max: int = 1) -> DataFrame:
    """(a, b, m, n) of every Wenner-Schlumberger reading of a line."""
    rows = spark.range(electrodes).select(F.col("id").cast("int").alias("a")).select("a", F.explode(F.sequence(F.lit(1), F.lit(a_max))).alias("d")).select("a", "d", F.explode(F.sequence(F.lit(1), F.lit(n_max))).alias("k"))
    a, d, k = F.col("a"), F.col("d"), F.col("k")
    return rows.select(a, (a + d * (2 * k + 1)).alias("b"), (a + d * k).alias("m"), (a + d * (k + 1)).alias("n")).where(F.col("b") < electrodes)
