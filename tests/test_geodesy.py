import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.functions import geodesy as g


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def arc(latitude, ellipsoid=g.WGS84):
    """Meridian arc by Gauss-Legendre quadrature."""
    a, f = ellipsoid
    e2 = f * (2 - f)
    x, w = np.polynomial.legendre.leggauss(60)
    p = math.radians(latitude) / 2 * (x + 1)
    return float(math.radians(latitude) / 2 * (w * a * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5).sum())


def test_central_meridian_is_the_meridian_arc(spark):
    df = spark.createDataFrame([(float(x),) for x in range(-88, 89, 8)], "lat double")
    e, n = g.transverse_mercator(F.lit(9.0), F.col("lat"), 9.0)
    for r in df.select("lat", e.alias("e"), n.alias("n")).collect():
        assert r["e"] == pytest.approx(500_000, abs=1e-6) and r["n"] == pytest.approx(0.9996 * arc(r["lat"]), abs=1e-5)


def test_both_ways_and_conformal(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-30, 30, 300), rng.uniform(-85, 85, 300), strict=True)], "lon double, lat double")
    e, n = g.transverse_mercator(F.col("lon"), F.col("lat"), 0.0)
    back = df.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = g.from_transverse_mercator(F.col("e"), F.col("n"), 0.0)
    d = 1e-6
    near = {k: v for dx, dy, k in ((d, 0, "x"), (0, d, "y")) for k, v in zip((f"e{k}", f"n{k}"), g.transverse_mercator(F.col("lon") + dx, F.col("lat") + dy, 0.0), strict=True)}
    for r in back.withColumns(near).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon2"] - r["lon"]) < 1e-9 and abs(r["lat2"] - r["lat"]) < 1e-9
        e2, p = g.WGS84[1] * (2 - g.WGS84[1]), math.radians(r["lat"])
        w = math.sqrt(1 - e2 * math.sin(p) ** 2)
        east, north = g.WGS84[0] / w * math.cos(p), g.WGS84[0] * (1 - e2) / w**3  # metres a radian
        u, v = ((r["ex"] - r["e"]) / east, (r["nx"] - r["n"]) / east), ((r["ey"] - r["e"]) / north, (r["ny"] - r["n"]) / north)
        assert math.hypot(*u) == pytest.approx(math.hypot(*v), rel=2e-3) and abs(u[0] * v[0] + u[1] * v[1]) < 2e-3 * math.hypot(*u) * math.hypot(*v)


def test_published_points(spark):
    df = spark.createDataFrame([(44.4, 33.3), (-70.0, -45.0), (179.9, 10.0), (-180.0, 10.0), (180.0, -1.0)], "lon double, lat double")
    assert [tuple(r) for r in df.select(g.utm_zone(F.col("lon")).alias("z"), g.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == [(38, 32638), (19, 32719), (60, 32660), (1, 32601), (1, 32701)]
    e, n = g.utm(F.col("lon"), F.col("lat"), g.utm_zone(F.col("lon")))
    r = df.limit(1).select(e.alias("e"), n.alias("n")).first()
    assert r["e"] == pytest.approx(444140.54, abs=0.01) and r["n"] == pytest.approx(3684706.36, abs=0.01)


def test_geodesic(spark):
    flinders, buninyong = (dms(144, 25, 29.5244), dms(-37, 57, 3.7203)), (dms(143, 55, 35.3839), dms(-37, 39, 10.1561))
    rows = [(*flinders, *buninyong), (0.0, 0.0, 0.0, 90.0), (0.0, 0.0, 90.0, 0.0), (7.0, 8.0, 7.0, 8.0), (179.9, 1.0, -179.9, 1.0), (0.0, 0.0, 179.9999, 0.0001), (0.0, -60.0, 0.0, 30.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    on_grs = df.limit(1).select(g.geodesic(*cols, ellipsoid=g.GRS80).alias("s")).first()["s"]
    assert on_grs == pytest.approx(54972.271, abs=5e-4)
    s = [r["s"] for r in df.select(g.geodesic(*cols).alias("s")).collect()]
    assert s[1] == pytest.approx(arc(90), abs=1e-4)
    assert s[2] == pytest.approx(6378137 * math.pi / 2, abs=1e-4)
    assert s[3] == 0.0 and s[4] < 23_000 and s[5] is None
    assert s[6] == pytest.approx(arc(60) + arc(30), abs=1e-4)
