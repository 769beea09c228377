"""Readers that find their columns by each file's own header, and fail where they can't."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sondage.operators import resistivity, seismic, survey
from sondage.sources import files, text


def table(spark, **content):
    return spark.createDataFrame(list(content.items()), "file string, text string")


def test_magnetometer_columns_by_label_and_counts_of_what_goes(spark):
    t = table(spark, a="station line time field quality\nS1 L1 10:00:00 50000.5 0.2\nS2 L1 10:00:10 50001 3\n", b="# Time Reading SQ Sta\n10:00:00 50002 9 S3\n", c="S4 10:00 50003\n")
    seen = Observation()
    rows = {r["station"]: r for r in text.read_g857(spark, t, min_quality=1.0, dropped=seen).collect()}
    assert [(k, r["line"], r["time"], r["field"], r["quality"]) for k, r in sorted(rows.items())] == [("S2", "L1", "10:00:10", 50001.0, 3.0), ("S3", None, "10:00:00", 50002.0, 9.0), ("S4", None, "10:00", 50003.0, None)]
    assert seen.get == {"n_kept": 3, "n_dropped": 1}
    odd = table(spark, d="S1 10:00:00 50000 7\n")
    with pytest.raises(Exception, match="no header for 4 columns"):
        text.read_g857(spark, odd).collect()
    assert [tuple(r) for r in text.read_g857(spark, odd, columns=["station", "time", "field", "x"]).select("station", "field", "quality").collect()] == [("S1", 50000.0, None)]
    with pytest.raises(ValueError, match="layouts: exported, manual"):
        text.read_g857(spark, odd, columns="other")


def test_em_channels_by_each_files_own_header(spark):
    t = table(spark, a="#f\nLine,I_450Hz(ppm),Q_450Hz(ppm)\n1,5,7\n", b="#f\n#\nQ_450Hz(ppm),I_450Hz(ppm),Q_9990Hz(ppm)\n7,5,9\n", c="nothing\n1,2,3\n")
    assert text.gem2_header(spark, t) == ["line", "Q_450", "I_450", "Q_9990"]
    assert sorted(tuple(r) for r in text.read_gem2(spark, t).select("file", "I_450", "Q_450", "Q_9990", F.coalesce("line", F.lit(-1.0))).collect()) == [("a", 5.0, 7.0, None, 1.0), ("b", 5.0, 7.0, 9.0, -1.0)]


def test_positions_by_alias(spark):
    t = table(spark, a='Point ID,Lon,Lat,Height,Note\n"A, first",-92.5,38.25,300,x\n', b="\nNorthing,Easting,Elevation,name\n10,20,30.5,B\n")
    rows = [tuple(r) for r in text.read_positions(spark, t, "ground").select("name", "longitude", "latitude", "easting", "northing", "height", "elevation").orderBy("name").collect()]
    assert rows == [("A, first", -92.5, 38.25, None, None, 300.0, None), ("B", None, None, 20.0, 10.0, None, 30.5)]
    for content, said in (("name,lon,height\nA,1,2\n", "no names, or no longitude"), ("name,lon,lat,height\nA,1,2,3\n", "pass antenna_height")):
        with pytest.raises(Exception, match=said):
            text.read_positions(spark, table(spark, a=content), "antenna", on_duplicate="keep").collect()
    assert text.read_positions(spark, table(spark, a="name,lon,lat,height\nA,1,2,3\n"), "antenna", antenna_height=2.0).first()["height"] == 1.0


def stg(*records, said=None, unit="meter"):
    row = lambda i, x, y: f"{i},U,20261111,12:06:20,4.0,3,435,48,p," + ",".join(f"{v},{y},0.0" for v in x) + ",Ch=1\n"
    return f"Sting\nFirmware Records: {len(records) if said is None else said}\nUnit: {unit}\n" + "".join(row(i, x, y) for i, (x, y) in enumerate(records, 1))


def test_stg_files_are_checked(spark):
    good = [((0, 1, 2, 3), 0.0), ((1, 2, 3, 4.01), 0.0)]
    one = lambda *r, **k: text.stg_readings(text.read_stg(spark, table(spark, a=stg(*r, **k)))).orderBy("record")
    assert [tuple(r[c] for c in "abmn") for r in one(((0, 1, 2, 3), 0.0)).collect()] == [(0, 1, 2, 3)]
    for records, more, said in ((good, {"said": 3}, "2 records, its header says 3"), ([((0, 1, 2, 3), 0.5)], {}, "record 1 has an electrode beside the line"), ([((0, 1, 2, 3), 0.0), ((0, 1, 2, 7.4), 0.0)], {}, "record 2 has an electrode off the grid"), ([((-1, 0, 1, 2), 0.0)], {}, "before the start")):
        with pytest.raises(Exception, match=said):
            one(*records, **more).collect()


def test_each_record_of_a_file_has_its_own_source(spark):
    rows = [("f", k, str(4017 + k // 3), 112.0 if k == 0 else 92.0 if k == 3 else None, 2.0 * (k % 3) if k != 4 else None, 0.0, None) for k in range(6)]
    t = spark.createDataFrame(rows, "file string, trace int, source_id string, source_x double, receiver_x double, delay double, error string")
    got = {r["trace"]: (r["source_x"], r["receiver_x"]) for r in seismic.spread(t).collect()}
    assert got == {0: (112.0, 0.0), 1: (112.0, 2.0), 2: (112.0, 4.0), 3: (92.0, 0.0), 4: (92.0, 2.0), 5: (92.0, 4.0)}
    assert [r["receiver_x"] for r in seismic.spread(t, spacing=5.0).orderBy("trace").collect()] == [0.0, 5.0, 10.0] * 2


def test_mask_counts_come_with_the_pass(spark):
    seen = Observation()
    assert survey.masked(spark.range(10), F.when(F.col("id") != 3, F.col("id") > 5), seen).count() == 4
    assert seen.get == {"n_kept": 4, "n_dropped": 6}


def test_identify_reads_heads_only(spark, tmp_path):
    (tmp_path / "a.asc").write_text("station time field\nS 10:00:00 50000.1\n" + "x" * 10_000_000)
    (tmp_path / "p.csv").write_text("Point,Lon,Lat,Height\nA,1,2,3\n")
    plan = files.identify(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["readers"][:1] for r in plan.collect()} == {"a.asc": ["g857"], "p.csv": ["positions"]}
    assert "content" not in plan._jdf.queryExecution().executedPlan().toString()


def test_resistivity_sink_numbers_all_readings(spark):
    r = spark.createDataFrame([(1, 0, 2, 3, 5.0), (0, None, 1, 2, 7.0), (0, 3, 1, 2, 6.0), (2, None, 3, None, 9.0)], "a int, b int, m int, n int, rhoa double")
    got = [x["line"] for x in text.res2dinv_lines(r, "t", 2.0).orderBy("pos").collect()]
    assert got[:2] == ["t", "2.00000"] and got[6] == "4"
    assert got[9:] == ["3 0.00000 0.0 2.00000 0.0 4.00000 0.0 7.00000", "4 0.00000 0.0 6.00000 0.0 2.00000 0.0 4.00000 0.0 6.00000", "4 2.00000 0.0 0.00000 0.0 4.00000 0.0 6.00000 0.0 5.00000", "2 4.00000 0.0 6.00000 0.0 9.00000"]


def test_missing_readings_per_line_with_remote_electrodes(spark):
    r = spark.createDataFrame([("x", 1, None, 2, 3), ("x", 0, None, 1, 2), ("y", 0, 3, 1, 2)], "line string, a int, b int, m int, n int")
    assert sorted(map(str, (tuple(x) for x in resistivity.missing(r, 5, ["line"]).collect()))) == sorted(map(str, [("x", 2, None, 3, 4), ("y", 1, 4, 2, 3)]))
