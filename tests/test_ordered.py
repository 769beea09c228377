import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.plans import joins, ordered


@pytest.mark.parametrize("n,kinds", [(1, 3), (7, 2), (500, 400), (40_000, 39_000), (40_000, 5)])
def test_quantiles_are_exact(spark, n, kinds):
    r = random.Random(n + kinds)
    rows = [(r.choice(["a", "a", "a", None]), None if r.random() < 0.05 else float(r.randrange(kinds)) / 7) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in {x[0] for x in rows}:
        v = [x[1] for x in rows if x[0] == g and x[1] is not None]
        if v:
            want[g] = np.percentile(v, [0, 5, 50, 95, 100]).tolist()
    got = {x["g"]: [x["lo"], x["p5"], x["m"], x["_hi"], x["top"]] for x in ordered.quantiles(df, ["g"], "v", {"lo": 0.0, "p5": 0.05, "m": 0.5, "_hi": 0.95, "top": 1.0}).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert ordered.quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0
    assert ordered.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("n", [3, 100, 5000])
def test_lowest_rows_at_an_exact_rank(spark, n):
    r = random.Random(n)
    rows = [(i, float(r.randrange(max(2, n // 3)))) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, d double")
    take = max(2, n // 10)
    size = df.agg(F.lit(take).alias("n"), F.count(F.lit(1)).alias("all"))
    got = sorted(x["k"] for x in ordered.lowest(df, "d", "k", size, "n").collect())
    assert got == sorted(k for _, k in sorted((d, k) for k, d in rows)[:take])


@pytest.mark.parametrize("width", [1.0, 10.0, 1e6])
def test_next_rows_across_ranges(spark, width):
    r = random.Random(4)
    rows = sorted({(r.choice(["a", "b", None]), float(r.randrange(300))) for _ in range(200)}, key=str)
    df = spark.createDataFrame(rows, "g string, x double").withColumn("y", F.col("x") * 2)
    want = {}
    for g, x in rows:
        later = [b for a, b in rows if a == g and b > x]
        want[g, x] = (min(later), 2 * min(later)) if later else (None, None)
    got = {(q["g"], q["x"]): (q["next_x"], q["next_y"]) for q in ordered.with_next(df, ["g"], "x", ["x", "y"], width).collect()}
    assert got == want
    alone = ordered.with_next(df.where("g = 'a'").drop("g"), [], "x", ["x"], width).orderBy("x").collect()
    assert [q["next_x"] for q in alone][:-1] == [q["x"] for q in alone][1:]


def test_interpolation_clamps_per_group(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0), ("a", 11.0, 3.0), ("b", 5.0, 7.0)], "g string, x double, y double")
    at = spark.createDataFrame([("a", -5.0), ("a", 5.0), ("a", 10.0), ("a", 99.0), ("b", 1.0), ("c", 1.0)], "g string, t double")
    got = [r["v"] for r in joins.interpolate(at, knots, "t", "x", "y", "v", 2.0, by=["g"]).orderBy("g", "t").collect()]
    assert got == [1.0, 2.0, 3.0, 3.0, 7.0, None]


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert ordered.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 1.5


def test_lowest_of_many_ties(spark):
    rows = [(i, float(i % 3)) for i in range(9000)]
    df = spark.createDataFrame(rows, "k long, d double").repartition(5)
    for take in (1, 2999, 3000, 3001, 4500, 9000):
        size = df.agg(F.lit(take).alias("n"), F.count(F.lit(1)).alias("all"))
        assert sorted(x["k"] for x in ordered.lowest(df, "d", "k", size, "n").collect()) == sorted(k for _, k in sorted((d, k) for k, d in rows)[:take])


@pytest.mark.parametrize("width", [1.0, 3.0, 20.0, 1e6])
def test_halo_makes_windows_whole(spark, width):
    r = random.Random(8)
    rows = [(g, float(i), float(r.randrange(50))) for g in ("a", "b", None) for i in sorted(r.sample(range(120), 60))]
    df = spark.createDataFrame(rows, "g string, x double, v double")
    frame = "ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"
    want = sorted(map(str, df.selectExpr("g", "x", f"array_sort(collect_list(v) OVER (PARTITION BY g {frame})) AS w").collect()))
    halo = ordered.with_halo(df, ["g"], "x", 3, width)
    got = halo.selectExpr("g", "x", "_own", f"array_sort(collect_list(v) OVER (PARTITION BY g, _range {frame})) AS w").where("_own").drop("_own")
    assert sorted(map(str, got.collect())) == want


def test_few_groups_are_held_and_many_stay(spark):
    df = spark.range(50).selectExpr("id AS g", "id * 2 AS v")
    assert sorted(map(tuple, ordered.few(df).collect())) == [(i, 2 * i) for i in range(50)]
    assert "isBroadcastable=true" in (plan := ordered.few(df)._jdf.queryExecution().toString()) or "broadcast" in plan
    assert ordered.few(df, 49) is df


def test_rows_of_few_groups_are_not_shuffled_by_group(spark):
    """With broadcasts by size off the plan joins no rows by group or as a product."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id % 5 AS g", "double(id * 37 % 101) AS v")
        for by in (["g"], []):
            plan = ordered.quantiles(df, by, "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
