"""Operators against their definitions, in numpy or by hand."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sondage.operators import records, seismic, stations, survey


def traces(spark, *arrays):
    return spark.createDataFrame([(k, [float(x) for x in a]) for k, a in enumerate(arrays)], "k long, a array<double>")


def test_pickers_on_a_silent_lead_in(spark):
    t = [0.0] * 10 + [5.0, -4.0, 3.0, -2.0, 4.0, -5.0, 3.0, 2.0, -4.0, 1.0]
    df = traces(spark, t, [0.0, 1.0])
    e = seismic.energy_ratio(df, "k", "a", 4).orderBy("k").first()
    assert e["pick"] == 9 and e["ratio"] > 1e6  # the floor keeps the ratio finite
    assert {r["k"]: r["pick"] for r in seismic.aic_pick(df, "k", "a").collect()} == {0: 10}  # two samples have no break
    assert seismic.energy_ratio(df, "k", "a", 4, modified=True).count() == 1


def test_pickers_as_defined(spark):
    r = np.random.default_rng(2)
    data = [np.concatenate([0.1 * r.normal(size=30), r.normal(size=34)]) for _ in range(5)]
    df = traces(spark, *data)
    sta = {x["k"]: (x["pick"], x["most"]) for x in seismic.sta_lta(df, "k", "a", 3, 20, 2.0).collect()}
    aic = {x["k"]: x["pick"] for x in seismic.aic_pick(df, "k", "a").collect()}
    for k, x in enumerate(data):
        e = x**2
        ratio = {i: e[i - 2 : i + 1].mean() / (e[max(0, i - 19) : i + 1].mean() + 1e-30) for i in range(2, 64)}
        assert sta[k] == (min((i for i, v in ratio.items() if v >= 2.0), default=None), pytest.approx(max(ratio.values())))
        cost = {j: j * math.log(max(x[:j].var(), 1e-30)) + (64 - j - 1) * math.log(max(x[j:].var(), 1e-30)) for j in range(1, 63)}
        assert aic[k] == min(cost, key=lambda j: round(cost[j], 6))


def test_reciprocal_pairs(spark):
    rows = [(0, "A", 0.0, 6.0, 0.0101, "l"), (1, "B", 6.1, 0.0, 0.0105, "l"), (2, "B", 6.0, 6.1, 0.0, "l"), (3, "C", 6.0, 0.0, 0.2, "m")]
    df = spark.createDataFrame(rows, "i long, shot string, s double, r double, t double, line string")
    x = seismic.reciprocity(df, "i", "s", "r", "t", 0.25, "shot", "line").collect()
    assert len(x) == 1 and (x[0]["shot_ab"], x[0]["shot_ba"], x[0]["x_a"], x[0]["x_b"], x[0]["offset"]) == ("A", "B", 0.0, 6.0, 6.0)
    assert x[0]["dt"] == pytest.approx(-0.0004)
    assert seismic.reciprocity(df, "i", "s", "r", "t").count() == 2  # without lines: C's reading as well


def test_starting_gradient(spark):
    rows = [(i, float(d), d / v) for i, (d, v) in enumerate([(1, 300.0), (2, 320.0), (3, 310.0), *[(k, 900.0) for k in range(4, 12)], (40, 2000.0), (50, 2100.0), (60, 1900.0)])]
    df = spark.createDataFrame([*rows, (99, 0.0, 1.0), (98, 5.0, None)], "k long, d double, t double")
    r = seismic.apparent_gradient(df, "k", "d", "t").first()
    assert (r["v_top"], r["v_bottom"]) == pytest.approx((310.0, 2200.0))


def test_gate_needs_all_nodes_and_whole_windows(spark):
    rows = [(n, i, math.sin(i * (1 + n)) * (50.0 if n == 1 and 24 <= i < 32 else 1.0)) for n in (0, 1) for i in range(60) if not (n == 0 and i == 3)]
    df = spark.createDataFrame(rows, "n long, i long, v double")
    got = sorted(r["start"] for r in records.sliding_gate(df, "n", "i", "v", 8, 0.3, 3.0).collect())
    assert got == [s for s in range(0, 53, 4) if not (s <= 3 < s + 8) and not (s < 32 and s + 8 > 24)]


def test_smoothing_keeps_what_is_not_positive(spark):
    df = spark.createDataFrame([("a", f, f + 1.0) for f in (0.0, 1.0, 2.0, 4.0)], "s string, f double, v double")
    got = {r["fc"]: r["smooth"] for r in seismic.konno_ohmachi(df, "s", "f", "v").collect()}
    f, v = np.array([1.0, 2.0, 4.0]), np.array([2.0, 3.0, 5.0])
    for c in f:
        w = np.sinc(40 * np.log10(f / c) / math.pi) ** 4
        assert got[c] == pytest.approx((w * v).sum() / w.sum())
    assert got[0.0] == 1.0


def test_silent_traces_count_in_the_image(spark):
    df = spark.createDataFrame([("s", 3.0, [0.0] * 8), ("s", 5.0, [1.0] + [0.0] * 7)], "shot string, x double, a array<double>")
    assert seismic.dispersion_image(df, "shot", "x", "a", 0.002, [20.0], [200.0]).first()["energy"] == pytest.approx(0.5)
    assert seismic.dispersion_image(df, "shot", "x", "a", 0.002, [20.0], [200.0], normalize=True).first()["energy"] == pytest.approx(1.0)


def test_despike_without_noise_flags_nothing(spark):
    flat = spark.createDataFrame([(f"l{i // 10}", i, 100.0 if i == 5 else 1.0) for i in range(40)], "line string, i long, v double")
    assert stations.despike(flat, "line", "i", "v").where("spike").count() == 0
    r = np.random.default_rng(1)
    v = r.normal(size=60)
    v[17] = 50.0
    df = spark.createDataFrame([(f"l{i // 20}", i, float(x)) for i, x in enumerate(v)], "line string, i long, v double")
    for width in (7.0, 1e5):
        out = stations.despike(df, "line", "i", "v", width=width)
        assert [(x["i"], x["despiked"]) for x in out.where("spike").collect()] == [(17, None)]
    both = stations.together(out.withColumn("w", F.lit(1.0)), ["spike"], ["v", "w"])
    assert both.where("w IS NULL").count() == 1


def test_base_shift_guards(spark):
    rows = [(1, 10.0, 45.0, 100.0, 10.0, 45.0, 90.0), (2, 10.1, 45.1, 101.0, 10.0, 45.0, 90.0)]
    df = spark.createDataFrame(rows, "id long, longitude double, latitude double, height double, base_longitude double, base_latitude double, base_height double")
    r = survey.base_shifted(df, (10.0001, 45.0, 92.0)).orderBy("id").first()
    assert (r["longitude"], r["latitude"], r["height"]) == pytest.approx((10.0001, 45.0, 102.0))
    with pytest.raises(PySparkException, match="moves by metres"):
        survey.base_shifted(df, (10.01, 45.0, 92.0)).collect()
    with pytest.raises(PySparkException, match="different base coordinates"):
        survey.base_shifted(df.withColumn("base_height", F.col("id") * 1.0), (10.0, 45.0, 90.0)).collect()


def test_guards_of_gathers_and_positions(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "s long, v double")
    assert survey.gather(df, "s", 3, required=True).count() == 1 and survey.gather(df, "s", 9).count() == 0
    with pytest.raises(PySparkException, match="no traces"):
        survey.gather(df, "s", 9, required=True).collect()
    points = spark.createDataFrame([(1,)], "p long")
    assert [r["s"] for r in survey.unmatched(df, "s", points, "p").collect()] == [3]
    with pytest.raises(PySparkException, match="no position for 3"):
        survey.unmatched(df, "s", points, "p", required=True).collect()


def test_common_window_of_runs(spark):
    df = spark.createDataFrame([(n, i) for n in "ab" for i in [1, 2, 3, 7, 8, 9, 12] if not (n == "b" and i == 12)], "n string, i long")
    assert tuple(records.common_window(df, "i", "n").first()) == (1, 3, 3)
    assert records.common_window(df.limit(0), "i", "n").count() == 0
