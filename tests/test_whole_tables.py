"""Queries over every row of their tables against plain loops."""

import math
from collections import defaultdict

import numpy as np
import pytest

from sondage.operators import potential, records
from sondage.queries import QUERIES, table


@pytest.fixture(scope="module")
def more_parts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("parts")
    spark.range(1, 301).selectExpr("id AS p_partkey", "int(id % 50 + 1) AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(1, 31).selectExpr("id AS s_suppkey", "int(id % 4) AS s_nationkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(2).selectExpr("id AS r_regionkey", "string(id) AS r_name").write.parquet(f"{d}/region.parquet")
    return str(d)


def corners(f, x, part):
    x0, z0 = part % 40 * 2.5 - x, part % 50 + 2.0
    return f(x0 + 2.5, z0 + 2.5) - f(x0, z0 + 2.5) - f(x0 + 2.5, z0) + f(x0, z0)


@pytest.mark.parametrize("most", [2000, 70])
def test_kernels_over_all_parts(spark, monkeypatch, more_parts, most):
    monkeypatch.setattr(potential, "MOST_CELLS", most)  # few: in blocks
    c, s = math.cos(math.radians(60)), math.sin(math.radians(60))
    part = np.arange(1, 301)
    log, atan = lambda x, z: np.log(x * x + z * z) / 2, lambda x, z: np.arctan2(x, z)
    gz = {k: 200 * 2 * 6.674e-11 * 1e5 * float(corners(lambda x, z: x * log(x, z) + z * atan(x, z), k, part).sum()) for k in range(1, 31)}
    field = {k: 0.01 * 50000 / (2 * math.pi) * float(((s * s - c * c) * corners(atan, k, part) + 2 * s * c * corners(log, k, part)).sum()) for k in range(1, 31)}
    assert {r["station"]: r["gz"] for r in QUERIES["gravity_kernel"](spark, more_parts).collect()} == pytest.approx(gz, abs=2e-9)
    assert {r["station"]: r["field"] for r in QUERIES["magnetic_kernel"](spark, more_parts).collect()} == pytest.approx(field, abs=2e-6)


def test_times_reach_all_parts(spark, more_parts):
    got = {(r["source"], r["node"]): r["time"] for r in QUERIES["grid_travel_times"](spark, more_parts).collect()}
    assert set(got) == {(s, n) for s in "01" for n in range(300)} and all(t is not None for t in got.values())


def test_limits_of_each_array(spark, more_parts):
    want = {}
    for a in range(4):
        at = [(i * 17 % 101, i * 29 % 97) for i in range(1, 31) if i % 4 == a]
        r = [math.dist(p, q) for k, p in enumerate(at) for q in at[:k]]
        want[a] = (2 * min(r), 2 * max(r), 2 * max(r) / 3)
    got = {r["array"]: (r["lambda_min"], r["lambda_max"], r["depth"]) for r in QUERIES["resolution_limits"](spark, more_parts).collect()}
    assert set(got) == set(want) and all(got[a] == pytest.approx(want[a], abs=2e-6) for a in want)


def test_all_tumbling_events(spark, sf_dir):
    e = spark.range(120).selectExpr("id", "id % 2 AS node", "id div 4 AS w", "double(id div 2 % 2) AS v")  # 30 windows alike
    assert records.tumbling_events(e, "node", "w", "v", 0.9).count() == 30
    assert records.tumbling_events(e, "node", "w", "v", 0.9, 20).count() == 20
    veto = e.where("NOT (node = 1 AND w = 2)")  # a node without samples in a window
    assert records.tumbling_events(veto, "node", "w", "v", 0.9).count() == 29
    cut = e.where("id < 118")  # the last window isn't whole
    assert records.tumbling_events(cut, "node", "w", "v", 0.9, whole=2).count() == 29


def test_every_shot_is_smoothed(spark, sf_dir):
    shots = {r["vec_id"]: np.abs(np.asarray(r["embedding"], float)) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()}
    f = np.arange(64) * 0.5
    want = {}
    for k, v in shots.items():
        want[k, 0.0] = float(v[0])
        for c in f[1:]:
            w = np.sinc(40 * np.log10(f[1:] / c) / math.pi) ** 4
            want[k, c] = float((w * v[1:]).sum() / w.sum())
    got = {(r["vec_id"], r["fc"]): r["smooth"] for r in QUERIES["konno_ohmachi"](spark, sf_dir).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_gaps_over_all_shots(spark, sf_dir):
    directions = defaultdict(set)
    for r in table(spark, sf_dir, "events").select("event_id", "user_id").collect():
        directions[r["user_id"]].add(r["event_id"] * 37 % 360)
    want = {}
    for k, a in directions.items():
        a = sorted(a)
        want[k] = max(y - x for x, y in zip(a, [*a[1:], a[0] + 360], strict=True))
    got = {r["station"]: (r["gap"], r["half_arc"]) for r in QUERIES["azimuth_gap"](spark, sf_dir).collect()}
    assert got == {k: (g, (360 - g) / 2) for k, g in want.items()}
