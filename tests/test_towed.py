"""Towed lines and pick files."""

import pytest
from pyspark.errors import PySparkException

from sondage.operators import seismic, towed


def test_repeats_are_averaged_geometrically(spark):
    track = spark.createDataFrame([("f", 36000.0, 0.0, 1.5), ("f", 36100.0, 100.0, None), ("f", 36200.0, 200.0, 2.0)], "file string, t double, s double, water_depth double")
    rows = [("f", k, 18000.0 + t, 0.0, -5.0, -10.0, -15.0, r, 7.0) for k, (t, r) in enumerate([(50.0, 3.0), (50.4, 3.3), (60.0, 2.0), (60.0, -1.0)])]
    df = spark.createDataFrame(rows, "file string, record long, t double, ax double, bx double, mx double, nx double, r double, current_ma double")
    got = towed.towed_line(df, track, 5.0, utc_offset_hours=5.0).orderBy("time").collect()
    assert [(r["repeats"], r["record"], r["current_ma"]) for r in got] == [(2, 0, 7.0), (1, 2, 7.0)] and got[1]["scatter"] is None
    assert got[0]["a"] < got[0]["n"] < got[0]["m"] and (got[1]["a"] - got[0]["a"], got[0]["n"] - got[0]["a"]) == (2, 1)
    ratio = got[0]["rhoa"] / got[1]["rhoa"]
    assert abs(ratio) == pytest.approx((3.0 * 3.3) ** 0.5 / 2.0) and got[1]["water_depth"] == pytest.approx(1.65)
    with pytest.raises(PySparkException, match="utc_offset_hours"):
        towed.towed_line(df, track, 5.0, utc_offset_hours=4.0).collect()
    with pytest.raises(PySparkException, match="off the grid"):
        towed.towed_line(df, track, 4.0, utc_offset_hours=5.0).collect()


def test_picks_as_text(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 0.012, True), ("A", 2, None, True)], "shot string, channel int, time double, use boolean")
    seismic.write_picks(df, str(tmp_path / "p"))
    got = [tuple(r) for r in seismic.read_picks(spark, str(tmp_path / "p")).orderBy("channel").collect()]
    assert got == [("A", 1, 0.012, True, 0.0, True), ("A", 2, None, False, 0.0, True)]
    df.drop("use").write.csv(str(tmp_path / "q"), header=True)
    with pytest.raises(ValueError, match="use"):
        seismic.read_picks(spark, str(tmp_path / "q"))
