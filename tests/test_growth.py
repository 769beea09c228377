"""Larger tables: whole results, without the rows, rounds or memory that grew faster than the tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.functions import scalar
from sondage.operators import passive, potential, tomography
from sondage.plans import joins
from sondage.plans.scratch import written
from sondage.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """More parts than a block of cells, of 400 different edges."""
    d = tmp_path_factory.mktemp("many")
    spark.range(6000).selectExpr("id AS p_partkey", "int(id div 40 % 10 + 1) AS p_size", "900D + id % 7 AS p_retailprice").write.parquet(f"{d}/part.parquet")
    spark.range(1, 31).selectExpr("id AS s_suppkey", "int(id % 4) AS s_nationkey").write.parquet(f"{d}/supplier.parquet")
    return str(d)


def corners(f, x, part):
    x0, z0 = part % 40 * 2.5 - x, part // 40 % 10 + 2.0
    return f(x0 + 2.5, z0 + 2.5) - f(x0, z0 + 2.5) - f(x0 + 2.5, z0) + f(x0, z0)


PART = np.arange(6000)
LOG, ATAN = (lambda x, z: np.log(x * x + z * z) / 2), np.arctan2
GZ = lambda x, z: (x * LOG(x, z) + z * ATAN(x, z)) * 2 * 6.674e-11 * 1e5


def effect_once(spark, monkeypatch, many_parts, name, column, want, most):
    """With few different edges they are broadcast; with ``most`` of 70 they meet the stations in a product of partitions."""
    monkeypatch.setattr(potential, "MOST_CELLS", most)
    monkeypatch.setattr(potential, "TASK_PAIRS", 300)
    df = QUERIES[name](spark, many_parts)
    assert ("CartesianProduct" if most < 400 else "BroadcastNestedLoopJoin") in plan(df) and "explode" not in plan(df)  # no copies of stations
    assert {r["station"]: r[column] for r in df.collect()} == pytest.approx(want, rel=1e-9, abs=2e-6 if column == "field" else 2e-9)


@pytest.mark.parametrize("most", [2000, 70])
def test_forward_sums_of_equal_cells(spark, monkeypatch, many_parts, most):
    want = {k: float(((900 + PART % 7) * corners(GZ, k, PART)).sum()) for k in range(1, 31)}
    effect_once(spark, monkeypatch, many_parts, "gravity_forward", "gz", want, most)


@pytest.mark.parametrize("most", [2000, 70])
def test_gravity_of_equal_cells(spark, monkeypatch, many_parts, most):
    want = {k: 200 * float(corners(GZ, k, PART).sum()) for k in range(1, 31)}
    effect_once(spark, monkeypatch, many_parts, "gravity_kernel", "gz", want, most)


@pytest.mark.parametrize("most", [2000, 70])
def test_magnetics_of_equal_cells(spark, monkeypatch, many_parts, most):
    c, s = math.cos(math.radians(60)), math.sin(math.radians(60))
    want = {k: 0.01 * 50000 / (2 * math.pi) * float(((s * s - c * c) * corners(ATAN, k, PART) + 2 * s * c * corners(LOG, k, PART)).sum()) for k in range(1, 31)}
    effect_once(spark, monkeypatch, many_parts, "magnetic_kernel", "field", want, most)


def test_median_depths_in_batches(spark):
    """Each batch is bisected at once, not each reading in a fold; remote electrodes and arrays without signal as before."""
    r = spark.range(20000).selectExpr("double(id % 50 + 1) AS am", "CASE WHEN id % 3 > 0 THEN id % 50 + 3D END AS bm", "id % 50 + 3D AS an", "CASE WHEN id % 3 > 1 THEN id % 50 + 4D END AS bn")
    df = r.withColumn("depth", scalar.median_depth(*[F.col(c) for c in r.columns]))
    assert "ArrowEvalPython" in plan(df) and "aggregate(" not in plan(df)
    want = {}
    for row in df.collect():
        d = tuple(row[:4])
        if d not in want:
            part = lambda z, d=d: sum(s * (1 / x - 1 / math.sqrt(x * x + 4 * z * z)) for s, x in zip((1, -1, -1, 1), d, strict=True) if x)
            total = sum(s / x for s, x in zip((1, -1, -1, 1), d, strict=True) if x)
            lo, hi = 0.0, 10 * max(x for x in d if x)
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if total and part(mid) / total < 0.5 else (lo, mid)
            want[d] = (lo + hi) / 2 if total else None
        assert row["depth"] == (want[d] and pytest.approx(want[d], rel=1e-12))
    none = spark.sql("SELECT 2D AS r").select(scalar.median_depth(*[F.col("r")] * 4).alias("depth"))  # no signal
    assert none.first()["depth"] is None


def test_times_through_tiles(spark, monkeypatch, tmp_path):
    """The times of links relaxed one by one, past missing nodes, in rounds that are counted by tiles."""
    part = spark.range(1, 1701).where("id % 11 <> 5").selectExpr("id AS p_partkey", "int(id * 7 % 50 + 1) AS p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3).selectExpr("id AS r_regionkey", "string(id) AS r_name").write.parquet(f"{tmp_path}/region.parquet")  # node 4 is missing, node 8 is there
    rounds = []
    monkeypatch.setattr(tomography, "SIDE", 32)  # of 60 by 30 nodes
    monkeypatch.setattr(tomography, "written", lambda df, name="times": rounds.append(name) or written(df, name))
    got = {(r["source"], r["node"]): r["time"] for r in QUERIES["grid_travel_times"](spark, str(tmp_path)).collect()}
    assert rounds.count("times") <= 8  # the first state and a few rounds, not one for every three nodes on a path
    p = part.selectExpr("p_partkey - 1 AS node", "0.001D + p_size * 0.00002D AS s")
    nodes = tomography.grid(spark, 60, 30, 2.0).join(p, "node")
    sources = spark.createDataFrame([("0", 0), ("1", 4), ("2", 8)], "source string, node long")
    want = {(r["source"], r["node"]): r["time"] for r in tomography.first_times(tomography.links(nodes, 2.0, 3), sources).collect()}
    assert set(got) == set(want) and got == pytest.approx(want, abs=1.1e-9)


def test_headers_of_resistivity_files_need_no_join(spark, tmp_path):
    """A join could broadcast the exploded lines of all files, whose size Spark takes for that of the table behind them."""
    spark.range(300).selectExpr("id AS p_partkey", "int(id % 9) AS p_size", "900D + id AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["source_res2dinv"](spark, str(tmp_path))
    assert "Join" not in plan(df)
    got = df.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("rhoa").alias("least"), F.max("a").alias("last")).collect()
    first = {1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}
    assert {(r["file"], r["n"], r["least"], r["last"]) for r in got} == {(f"k{k}-{line}", 50, 900.0 + 50 * line, 49 + first[k]) for k in range(1, 8) for line in range(6)}


def windows_by_hand(at, windows, name):
    return {k: next((w[name] for w in sorted(windows, key=lambda w: w["w"]) if t is not None and w["t0"] - 1.5 <= t <= w["t1"] + 1.5), None) for k, t in at.items()}


@pytest.mark.parametrize("name", ["w", "name"])
def test_first_windows_among_many(spark, name):
    """Thousands of windows of all lengths in a bucket of the width: what a point meets is short, and no pairs are made."""
    rng = np.random.default_rng(3)
    at = {k: None if k % 97 == 0 else float(t) for k, t in enumerate(np.round(rng.uniform(-50, 650, 1500), 1))}
    start, size = np.round(rng.uniform(-40, 600, 3000), 1), np.round(rng.choice([-5, 0.0, 0.3, 4, 30, 300], 3000, p=[0.05, 0.2, 0.35, 0.35, 0.04, 0.01]), 1)
    order = rng.permutation(3000) - 100
    windows = [{"w": int(order[i]), "name": int(order[i]) % 11, "t0": float(start[i]), "t1": float(start[i] + size[i])} for i in range(3000)]
    windows += [{"w": 2900, "name": 12, "t0": -400.0, "t1": 3000.0}, {"w": None, "name": 13, "t0": 0.0, "t1": 90.0}]
    points = spark.createDataFrame([(k, t) for k, t in at.items()], "seq long, t double")
    table_ = spark.createDataFrame([tuple(w.values()) for w in windows], "w long, name long, t0 double, t1 double")
    df = joins.interval_match(points, table_, "t", "t0", "t1", "w", width=300.0, tolerance=1.5, point_key="seq")
    assert {r["seq"]: r[name] for r in df.collect()} == windows_by_hand(at, [w for w in windows if w["w"] is not None], name)
    lists = [int(m) for m in met_rows(df)]
    assert max(lists) < 40000  # rows out of any join or Generate


def met_rows(df):
    """Rows out of every join and Generate of the plan as it ran."""
    df._jdf.queryExecution().executedPlan()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if ("Join" in kind or kind == "GenerateExec") and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        c = p.children()
        todo += [c.apply(i) for i in range(c.size())]
    return out


def test_nearest_of_dense_samples(spark):
    """Cells as fine as the samples lie, then wider ones for what is far from all; a point meets one row of a cell, not its samples."""
    rng = np.random.default_rng(5)
    dense = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.integers(0, 60, (3000, 2)) / 2)]  # many at one place
    others = [*dense, (3000, 70.0, 70.0), (2999, 70.0, 70.0), (3001, 150.0, 70.0), (3002, None, 1.0), (3003, -300.0, -1.0)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.integers(-40, 200, (1500, 2)) / 2)]
    points += [(1500, 110.0, 70.0), (1501, -260.0, -1.0), (1502, -259.9, -1.0), (1503, None, 0.0), (0, 5.0, 5.25)]  # equally far from two, at the tolerance, beyond, nowhere, an id again
    df = joins.nearest_within(spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(others, "j long, x double, y double"), "k", "x", "y", "j", 40.0)
    want = {}
    for k, x, y in points:
        d = [(math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b in others if a is not None] if x is not None else []
        d = [v for v in d if v[0] <= 40]
        if d:
            want[k] = min([want[k], *d] if k in want else d)
    assert {r["k"]: (r["distance"], r["other"]) for r in df.collect()} == want and df.count() == len(want)
    assert max(int(m) for m in met_rows(df)) <= 9 * len(others)  # 1.4 million pairs in cells of the tolerance


def test_pairs_of_blocks(spark, monkeypatch):
    """An array larger than a block is shared out by pairs of blocks; every pair comes once, its smaller node first."""
    monkeypatch.setattr(passive, "BLOCK", 40)
    nodes = [(k, k * 17 % 101 / 1.0, k * 29 % 97 / 1.0, k % 3 if k < 240 else None if k < 245 else 9) for k in range(250)] + [(7, 3.0, 4.0, 1), (None, 0.0, 0.0, 1)]
    df = spark.createDataFrame(nodes, "n long, x double, y double, a long")
    got = passive.separations(df, "n", "x", "y", "a")
    want = sorted((p[3], p[0], q[0], math.dist(p[1:3], q[1:3])) for p in nodes for q in nodes if p[3] is not None and p[3] == q[3] and None not in (p[0], q[0]) and p[0] < q[0])
    rows = sorted(tuple(r) for r in got.select("a", "i", "j", "r").collect())
    assert [r[:3] for r in rows] == [w[:3] for w in want] and [r[3] for r in rows] == pytest.approx([w[3] for w in want])
    assert "_g" in plan(got) and "_h" in plan(got)  # keys of pairs of blocks, not the array alone
    alone = passive.separations(df.where("a = 9"), "n", "x", "y")
    assert alone.columns == ["i", "j", "r"] and alone.count() == 10


def test_rounded_separations(spark):
    """Every distance of the query's positions is rounded as by F.round."""
    d = spark.range(101).crossJoin(spark.range(97).withColumnRenamed("id", "b")).select(F.sqrt(F.col("id") * F.col("id") + F.col("b") * F.col("b")).alias("r"))
    assert d.where(F.round("r", 6) != F.floor(F.col("r") * 1e6 + 0.5) / 1e6).isEmpty()
