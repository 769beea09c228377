"""Plane waves and two-station phases recovered from waves that are made; rings of several arrays."""

import math

import numpy as np
import pytest

from sondage.operators import passive

XY = {0: (0.0, 0.0), 1: (25.0, 3.0), 2: (-11.0, 22.0), 3: (7.0, -19.0), 4: (30.0, 24.0)}
FREQUENCIES = [4.0, 6.0, 8.0, 10.0]


def wave(spark, arrays, noise=0.0, seed=1):
    """Coherencies of one plane wave per array: {array: (velocity, azimuth it comes from)}; velocity None: the same signal everywhere."""
    rng, rows = np.random.default_rng(seed), []
    for a, (v, from_) in arrays.items():
        s = 0.0 if v is None else 1 / v
        sx, sy = s * math.sin(math.radians(from_ + 180)), s * math.cos(math.radians(from_ + 180))
        for f in FREQUENCIES:
            for i in XY:
                for j in XY:
                    if i < j:
                        dx, dy = XY[i][0] - XY[j][0], XY[i][1] - XY[j][1]
                        p = -2 * math.pi * f * (sx * dx + sy * dy) + rng.normal(0, noise)
                        rows.append((a, i, j, f, 0.9 * math.cos(p), 0.9 * math.sin(p), 40))
    nodes = spark.createDataFrame([(a, n, *xy) for a in arrays for n, xy in XY.items()], "array string, node int, x double, y double")
    return spark.createDataFrame(rows, "array string, i int, j int, f double, re double, im double, windows long"), nodes


def test_plane_wave_is_recovered(spark):
    coh, nodes = wave(spark, {"a": (250.0, 60.0), "b": (410.0, 200.0)}, noise=0.02)
    rows = passive.plane_wave(coh, nodes, "array", "node", "x", "y", position_error=0.05).collect()
    assert len(rows) == 8
    for r in rows:
        v, az = (250.0, 60.0) if r["array"] == "a" else (410.0, 200.0)
        assert r["resolved"] and r["velocity"] == pytest.approx(v, rel=0.03)
        assert r["velocity_min"] <= v * 1.03 and r["velocity_max"] >= v * 0.97 and r["velocity_min"] <= r["velocity"] <= r["velocity_max"]
        assert abs((r["azimuth"] - az + 180) % 360 - 180) < 3 and r["azimuth_halfwidth"] < 20
        assert r["beam"] / r["coherence"] > 0.95 and r["n_pairs"] == 10
        assert r["wavelengths"] == pytest.approx(r["velocity"] / (r["f"] * max(math.dist(p, q) for p in XY.values() for q in XY.values())), rel=1e-6)


def test_position_error_widens_the_bracket_and_common_signals_are_infinitely_fast(spark):
    coh, nodes = wave(spark, {"a": (250.0, 60.0), "c": (None, 0.0)})
    wide = {(r["array"], r["f"]): r for r in passive.plane_wave(coh, nodes, "array", "node", "x", "y", position_error=3.0).collect()}
    taped = {(r["array"], r["f"]): r for r in passive.plane_wave(coh, nodes, "array", "node", "x", "y", position_error=0.05).collect()}
    width = lambda r: r["velocity_max"] - r["velocity_min"]
    assert width(wide["a", 6.0]) > 3 * width(taped["a", 6.0])
    for f in FREQUENCIES:
        r = taped["c", f]
        assert r["velocity"] == r["velocity_max"] == math.inf and r["azimuth_halfwidth"] == 180 and not r["resolved"] and r["velocity_min"] > 1000


def test_too_few_coherent_pairs_give_no_row(spark):
    coh, nodes = wave(spark, {"a": (250.0, 60.0)})
    assert passive.plane_wave(coh.where("j = 1"), nodes, "array", "node", "x", "y").collect() == []
    assert passive.plane_wave(coh, nodes, "array", "node", "x", "y", min_coherence=0.95).collect() == []


def test_two_stations_count_turns(spark):
    rows, want = [], {}
    for a, v, sign in (("a", 200.0, 1), ("b", 320.0, -1)):
        for f in np.arange(2.0, 30.0, 0.5):
            p = sign * 2 * math.pi * f * 45.0 / (v + 2 * f)
            rows.append((a, 0, 1, float(f), 0.8 * math.cos(p), 0.8 * math.sin(p)))
            want[a, float(f)] = v + 2 * f
    rows.append(("a", 0, 1, 40.0, 0.1, 0.0))  # incoherent
    coh = spark.createDataFrame(rows, "array string, i int, j int, f double, re double, im double")
    pairs = spark.createDataFrame([("a", 0, 1, 45.0), ("b", 0, 1, 45.0)], "array string, i int, j int, r double")
    got = passive.two_station(coh, pairs, ["array"]).collect()
    assert {(r["array"], r["f"]) for r in got} == set(want)
    assert all(r["velocity"] == pytest.approx(want[r["array"], r["f"]]) for r in got) and max(abs(r["turns"]) for r in got) > 3


def test_rings_of_each_array(spark):
    pairs = spark.createDataFrame([("a", 10.0), ("a", 10.4), ("a", 11.0), ("b", 10.5), ("b", 10.0), ("b", 30.0)], "array string, r double")
    assert sorted(tuple(r) for r in passive.rings(pairs, 0.05, "array").collect()) == [("a", 10.0, 1), ("a", 10.4, 1), ("a", 11.0, 2), ("b", 10.0, 1), ("b", 10.5, 1), ("b", 30.0, 2)]


def j0(z):
    t = np.linspace(0, math.pi, 2001)
    y = np.cos(z * np.sin(t))
    return float(((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0]) / math.pi)


def test_separation_test_tells_waves_from_common_noise(spark):
    """Array a: a wave of 300 m/s; b: the same coherency at every separation; c: no relation to separation."""
    rs, rng = [5.0, 8.0, 12.0, 17.0, 23.0], np.random.default_rng(2)
    pairs = [(a, 0, k + 1, r) for a in "abc" for k, r in enumerate(rs)] + [("a", 1, 9, 5.1)]
    rows = []
    for a, i, j, r in pairs:
        for f in (2.0, 5.0, 8.0, 12.0, 16.0):
            rho = j0(2 * math.pi * f * r / 300) * 0.95 if a == "a" else 0.6 if a == "b" else rng.uniform(-0.2, 0.9)
            rows.append((a, i, j, f, rho, 0.02))
    coh = spark.createDataFrame(rows, "array string, i int, j int, f double, re double, im double")
    frame = spark.createDataFrame(pairs, "array string, i int, j int, r double")
    out = {(r["array"], r["f"]): r for r in passive.separation_test(coh, frame, "array", dv=5.0).collect()}
    assert len(out) == 15
    assert out["a", 5.0]["first_lobe"] and out["a", 5.0]["usable"]
    assert out["a", 16.0]["multi_lobe"] and out["a", 16.0]["multi_lobe_velocity"] == pytest.approx(300, rel=0.02)
    assert all(out["a", f]["usable"] for f in (5.0, 8.0, 12.0, 16.0))
    assert not any(out["b", f]["usable"] for f in (2.0, 5.0, 8.0, 12.0, 16.0))  # velocities climb with separation
    assert all(out["b", f]["velocity_slope"] == pytest.approx(1.0, abs=0.02) for f in (5.0, 8.0))
    assert sum(out["c", f]["usable"] for f in (2.0, 5.0, 8.0, 12.0, 16.0)) <= 1


def test_first_lobe_inverts_j0(spark):
    rows = [(r, f, v, j0(2 * math.pi * f * r / v)) for r in (5.0, 10.0) for f in (4.0, 9.0) for v in (160.0, 300.0, 900.0)] + [(5.0, 4.0, None, 1.0), (5.0, 4.0, None, -0.41)]
    df = spark.createDataFrame(rows, "r double, f double, v double, rho double")
    for r in df.withColumn("got", passive.first_lobe_velocity(df["rho"], df["f"], df["r"])).collect():
        assert r["got"] == (None if r["v"] is None else pytest.approx(r["v"], rel=2e-3))
