import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.functions import scalar
from sondage.operators import passive, potential, resistivity, seismic, tomography


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_closed_forms(spark):
    j = one(spark, *[scalar.bessel_j0(F.lit(x)) for x in (0.0, 1.0, 2.404826, 5.520078, 10.0)])
    assert j == pytest.approx((1.0, 0.7651976866, 0.0, 0.0, -0.2459357645), abs=1e-6)
    slab = one(spark, scalar.gravity_prism(F.lit(-1e6), F.lit(1e6), F.lit(1.0), F.lit(3.0)))[0]
    assert slab == pytest.approx(2 * math.pi * scalar.GRAVITY * 2 * 1e5, rel=1e-5)
    low = one(spark, scalar.halfspace_quadrature(F.lit(0.001), 1000.0, 1.0), scalar.lin_conductivity(scalar.halfspace_quadrature(F.lit(0.001), 1000.0, 1.0), 1000.0, 1.0, F.lit(0.0)))
    assert low[0] > 0 and low[1] == pytest.approx(0.001, rel=0.02)
    assert one(spark, scalar.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0] == pytest.approx(111195.1, abs=0.2)


def test_resistivity_goldens(spark):
    w = resistivity.with_geometry(resistivity.wenner(spark, 4, 1), 1.0).first()
    assert w["k"] == pytest.approx(2 * math.pi) and w["depth"] == pytest.approx(0.519, abs=1e-3)
    d = resistivity.with_geometry(resistivity.dipole_dipole(spark, 10, 3), 2.0).where("a = 1 AND m = 4").first()
    assert abs(d["k"]) == pytest.approx(math.pi * 2 * 3 * 4 * 5)
    pole = spark.createDataFrame([(0, None, 1, None)], "a int, b int, m int, n int")
    assert resistivity.with_geometry(pole, 1.0).first()["depth"] == pytest.approx(0.867, abs=1e-3)


def test_refraction_recovers_two_layers(spark):
    v1, v2, h = 500.0, 2000.0, 5.0
    ti = 2 * h * math.sqrt(v2**2 - v1**2) / (v1 * v2)
    rows = [(1, 2.0 * i, min(2.0 * i / v1, ti + 2.0 * i / v2)) for i in range(1, 25)]
    r = seismic.fit_two_layers(spark.createDataFrame(rows, "shot long, x double, t double"), "shot", "x", "t").first()
    assert (r["v1"], r["v2"], r["depth"]) == pytest.approx((v1, v2, h), rel=1e-3)
    layers = spark.createDataFrame([(1, 0, v1, h), (1, 1, v2, 0.0), (2, 0, v2, h), (2, 1, v1, 0.0)], "model long, layer long, v double, h double")
    got = {(x["model"], x["layer"]): x["intercept"] for x in seismic.intercept_times(layers).collect()}
    assert got[1, 1] == pytest.approx(ti) and got[2, 1] is None


def test_spac_finds_the_velocity(spark):
    r = np.random.default_rng(5)
    nodes = [(i, 20.0 * math.cos(1.7 * i) * (1 + i / 3), 20.0 * math.sin(1.7 * i) * (1 + i / 3)) for i in range(5)]
    c, dt, n, rows = 250.0, 0.01, 512, []
    f = np.fft.rfftfreq(n, dt)
    for w in range(60):
        sums = [np.zeros(len(f), complex) for _ in nodes]
        for a in r.uniform(0, 2 * math.pi, 40):
            s = r.normal(size=len(f)) + 1j * r.normal(size=len(f))
            for k, (_, x, y) in enumerate(nodes):
                sums[k] += s * np.exp(-2j * math.pi * f * (x * math.cos(a) + y * math.sin(a)) / c)
        rows += [(k, w, np.fft.irfft(s, n).tolist()) for k, s in enumerate(sums)]
    windows = spark.createDataFrame(rows, "node long, w long, samples array<double>")
    rho = passive.coherency(passive.spectra(windows, ["node", "w"], "samples", dt, 2.0, 5.0), "node", "w")
    pairs = passive.separations(spark.createDataFrame(nodes, "node long, x double, y double"), "node", "x", "y")
    v = passive.spac_velocity(rho.join(pairs, ["i", "j"]), "f", "r", "re", 100.0, 500.0, 5.0).collect()
    assert np.median([x["velocity"] for x in v]) == pytest.approx(c, rel=0.15)
    assert passive.rings(pairs).agg(F.max("ring")).first()[0] <= 10 and passive.resolution(pairs).first()["lambda_min"] > 0


def test_gravity_inversion_finds_the_block(spark):
    cells = potential.mesh(spark, 0.0, 40.0, 12.0, 4.0)
    stations = spark.range(21).select(F.col("id").alias("station"), (F.col("id") * 2.0).alias("x"), F.lit(-1.0).alias("z"))
    k = potential.kernel(stations, cells, "station", "x", "z", scalar.gravity_prism).cache()
    truth = cells.select("cell", F.when((F.col("i") == 6) & (F.col("j") == 1), 500.0).otherwise(0.0).alias("property"))
    data = stations.join(potential.forward(k, truth, "station"), "station")
    model = potential.invert(data, cells, k, "station", "value", 0.001, 1e-5, 1e-4)
    again = {r["station"]: r["value"] for r in potential.forward(k, model, "station").collect()}
    assert all(again[r["station"]] == pytest.approx(r["value"], abs=0.01) for r in data.collect())
    best = model.join(cells, "cell").groupBy("i").agg(F.sum("property").alias("s")).orderBy(F.desc("s")).first()
    assert best["i"] in (5, 6, 7)


def test_times_through_a_grid(spark):
    nodes = tomography.grid(spark, 12, 6, 1.0).withColumn("s", F.lit(0.002))
    times = tomography.first_times(tomography.links(nodes, 1.0), spark.createDataFrame([("S1", 0), ("S2", 5)], "source string, node long"))
    rows = times.join(nodes, "node").where("source = 'S1'").collect()
    assert len(rows) == 72 and all(r["time"] <= 0.002 * math.hypot(r["x"], r["z"]) * 1.03 + 1e-12 and r["time"] >= 0.002 * math.hypot(r["x"], r["z"]) - 1e-12 for r in rows)
    fit = spark.createDataFrame([(i, 0.0001 * (i % 5)) for i in range(30)] + [(99, 0.05)], "i long, residual double")
    assert [r["i"] for r in tomography.outliers(fit, "residual").where("outlier").collect()] == [99]


def test_streaming_sessions(spark, tmp_path):
    from sondage.streaming import windows

    rows = spark.sql("SELECT 'n1' AS node, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS t, double(s) AS v FROM (SELECT explode(array(0, 5, 9, 40, 45, 400)) AS s)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("st_sessions", windows.sessions(stream, "node", "t", "10 seconds", "0 seconds")), ("st_tumbling", windows.tumbling(stream, "node", "t", "v", "30 seconds", "0 seconds"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["files"] for r in spark.table("st_sessions").collect()) == [2, 3]
    assert sorted(r["n"] for r in spark.table("st_tumbling").collect()) == [2, 3]


def test_inversion_solves_the_normal_equations(spark):
    """Against the direct solution of the damped and smoothed system."""
    rng = np.random.default_rng(3)
    cells = potential.mesh(spark, 0.0, 5.0, 2.0, 1.0)
    g, d = rng.normal(size=(7, 10)), rng.normal(size=7)
    k = spark.createDataFrame([(s, c, float(g[s, c])) for s in range(7) for c in range(10)], "station int, cell long, g double")
    data = spark.createDataFrame([(s, float(d[s])) for s in range(7)], "station int, value double")
    got = {r["cell"]: r["property"] for r in potential.invert(data, cells, k, "station", "value", 0.5, 0.05, 0.1).collect()}
    a, b = g.T @ g / 0.25, g.T @ d / 0.25
    at = {(r["i"], r["j"]): r["cell"] for r in cells.collect()}
    reg = 0.05 * np.eye(10)
    for (i, j), c in at.items():
        for o in (at.get((i + 1, j)), at.get((i, j + 1))):
            if o is not None:
                reg[[c, o], [c, o]] += 0.1
                reg[[c, o], [o, c]] -= 0.1
    want = np.linalg.solve(a + np.trace(a) / 10 * reg, b)
    assert [got[c] for c in range(10)] == pytest.approx(want.tolist(), abs=1e-4)


def test_em_closed_forms_at_known_points(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    zero = F.lit(0.0)
    assert get(scalar.investigation_depth(1.0, zero)) == pytest.approx(1.59, abs=0.01) and get(scalar.investigation_depth(1.0, zero, "VCP")) == pytest.approx(0.76, abs=0.01)
    assert get(scalar.investigation_depth(1.66, F.lit(1.0))) == pytest.approx(3.3, abs=0.05) and get(scalar.investigation_depth(1.66, F.lit(3.0))) == pytest.approx(7.3, abs=0.05)
    assert get(scalar.lin_susceptibility(F.lit(500.0), 1.66, zero)) == pytest.approx(0.001)
    assert get(scalar.lin_susceptibility(F.lit(500.0), 2**0.5 * 2, F.lit(1.0))) is None or abs(get(scalar.lin_susceptibility(F.lit(500.0), 2**0.5 * 2, F.lit(1.0)))) > 1e3  # the sign changes there
    assert get(scalar.layered_conductivity([F.lit(0.03)] * 3, [F.lit(1.0), F.lit(2.0)], F.lit(0.5), 1.66, "VCP")) == pytest.approx(0.03)
    with pytest.raises(ValueError):
        scalar.investigation_depth(1.0, zero, share=1.0)
