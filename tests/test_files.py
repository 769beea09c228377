"""Formats told apart, archives, byte orders, cut records and geometry of shot records."""

import struct
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sondage.functions import scalar
from sondage.operators import resistivity, seismic
from sondage.sources import binary, files, text

SHOT = [(np.arange(8) * 1.0 - k, {"SAMPLE_INTERVAL": "0.001", "RECEIVER_LOCATION": f"{4 * k} 0", "SOURCE_LOCATION": "-12", "DELAY": "0.001"}) for k in range(3)]


def segy(order, kind, extended=0, cut=0):
    data = bytearray(3600 + 3200 * extended)
    struct.pack_into(order + "h", data, 3216, 500)
    struct.pack_into(order + "H", data, 3220, 16)
    struct.pack_into(order + "h", data, 3224, kind)
    struct.pack_into(order + "h", data, 3504, extended)
    for k in range(2):
        head = bytearray(240)
        struct.pack_into(order + "i", head, 8, 4017)
        struct.pack_into(order + "i", head, 80, 4 * k)
        data += head + np.arange(16).astype(order + binary.SEGY_TYPES[kind]).tobytes()
    return bytes(data[: len(data) - cut])


@pytest.mark.parametrize("order", ["<", ">"])
def test_seg2_of_both_byte_orders_and_cut(order):
    raw = binary.encode_seg2(SHOT, order, UNITS="FEET")
    whole = binary.decode_seg2(raw)
    assert [t["receiver_x"] for t in whole] == pytest.approx([0, 4 * 0.3048, 8 * 0.3048]) and whole[0]["source_x"] == pytest.approx(-12 * 0.3048)
    assert whole[2]["samples"].tolist() == SHOT[2][0].tolist() and whole[0]["delay"] == 0.001
    cut = binary.decode_seg2(raw[:-10])
    assert len(cut[2]["samples"]) == 5 and cut[2]["header"]["TRUNCATED"] == "5/8" and len(cut[1]["samples"]) == 8


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", [2, 3, 5, 6])
def test_segy_extended_headers_and_cut(order, kind):
    for extended in (0, 2):
        t = binary.decode_segy(segy(order, kind, extended))
        assert len(t) == 2 and t[1]["samples"].tolist() == list(range(16)) and t[1]["receiver_x"] == 4.0
    width = np.dtype(binary.SEGY_TYPES[kind]).itemsize
    cut = binary.decode_segy(segy(order, kind, cut=3 * width))
    assert len(cut[1]["samples"]) == 13 and cut[1]["header"]["TRUNCATED"] == "13/16"
    with pytest.raises(ValueError):
        binary.decode_segy(segy(order, kind)[:3700])


def test_formats_are_told_apart_and_read(spark, tmp_path):
    content = {
        "a.dat": binary.encode_seg2(SHOT),
        "b.sgy": segy(">", 5),
        "c.dat": b"title\n2.0\n3\n1\n1\n0\n6 2 1 55.5\n0\n0\n",
        "d.txt": b"/\tCG-5 SURVEY\n/Line\tStation\tGrav.\n1\t2\t3000.5\n",
        "e.csv": b"Station,Line_No,Mean_nT\n7,1,50100.5\n",
        "f.log": b"10,x,$GPRMC,101112,A,3830.0,N,09015.0,W,,,,\n",
        "g.asc": b"# line station time field quality\nL1 S1 10:30:15 52431.2 3.0\n",
        "h.bin": b"\0\1\2nothing",
        "._a.dat": b"junk",
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: r["readers"] for r in files.identify(spark, str(tmp_path)).collect()}
    assert {k: v[:1] for k, v in found.items()} == {"a.dat": ["seg2"], "b.sgy": ["segy"], "c.dat": ["res2dinv"], "d.txt": ["cg5"], "e.csv": ["magnetics_summary"], "f.log": ["nmea"], "g.asc": ["g857"], "h.bin": []}
    assert files.read(spark, str(tmp_path / "a.dat")).count() == 3
    r = files.read(spark, str(tmp_path / "e.csv")).first()
    assert (r["station_id"], r["mean_nt"], r["dist_from_s_ft"]) == ("1-7", 50100.5, None)
    assert files.read(spark, str(tmp_path / "g.asc"), min_quality=5.0).count() == 0
    for bad in ("h.bin", "*"):
        with pytest.raises(ValueError, match="readers"):
            files.read(spark, str(tmp_path / bad))
    with pytest.raises(ValueError, match="no reader"):
        files.read(spark, str(tmp_path / "a.dat"), reader="other")
    files.register("nothing", (".bin",), lambda head: head.endswith(b"nothing"), lambda s, p: s.range(5))
    try:
        assert files.read(spark, str(tmp_path / "h.bin")).count() == 5
        with pytest.raises(ValueError):
            files.register("nothing", (), bool, None)
    finally:
        del files.READERS["nothing"]
    assert files.discover(spark, str(tmp_path), (".DAT",)).count() == 2


def test_inside_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/a.sg2", binary.encode_seg2(SHOT))
        z.writestr("__MACOSX/in/._a.sg2", b"junk")
    inside = files.unzipped(spark, str(tmp_path / "x.zip"))
    assert binary.read_seg2(spark, inside).where("error IS NULL").count() == 3
    assert [r["readers"] for r in files.identify(spark, inside).collect()] == [["seg2"]]


def test_spread_from_headers_and_arguments(spark):
    shot = [(t[0], {**t[1], **({"RECEIVER_LOCATION": ""} if k == 1 else {})}) for k, t in enumerate(SHOT)]
    rows = binary.read_seg2(spark, spark.createDataFrame([("s", bytearray(binary.encode_seg2(shot)))], "path string, content binary"))
    out = seismic.spread(rows, standoff=5.0).orderBy("trace").collect()
    assert [r["receiver_x"] for r in out] == [0.0, 4.0, 8.0] and out[0]["offset"] == 13.0 and out[0]["geometry_from"] == "headers"
    mixed = seismic.spread(rows, spacing=2.0).orderBy("trace").collect()
    assert [r["receiver_x"] for r in mixed] == [0.0, 2.0, 4.0] and mixed[0]["geometry_from"] == "mixed"
    bare = binary.encode_seg2([(t[0], {"SAMPLE_INTERVAL": "0.001"}) for t in SHOT])
    bare = binary.read_seg2(spark, spark.createDataFrame([("s", bytearray(bare))], "path string, content binary"))
    with pytest.raises(PySparkException, match="pass spacing"):
        seismic.spread(bare, source_offset=0.0).collect()
    with pytest.raises(PySparkException, match="pass source_offset"):
        seismic.spread(bare, spacing=1.0).collect()
    assert seismic.spread(bare, 1.0, -2.0).agg(F.max("offset")).first()[0] == 4.0


def test_samples_on_one_axis(spark):
    rows = [("f1", "n1", 0.0, [1.0, 2.0]), ("f2", "n1", 1.0, [5.0]), ("g", "n2", 0.25, [7.0, 8.0]), ("h", "n2", 0.5, [9.0])]
    t = spark.createDataFrame(rows, "file string, receiver_id string, start_s double, samples array<double>").withColumn("error", F.lit(None).cast("string"))
    got = {(r["node"], r["i"]): r["v"] for r in binary.common_axis(t, 4.0).collect()}
    assert got == {("n1", 0): 1.0, ("n1", 1): 2.0, ("n1", 4): 5.0, ("n2", 1): 7.0, ("n2", 2): 9.0}


def test_middle_points_of_standard_arrays(spark):
    f = spark.createDataFrame([("x", "t\n1.0\n7\n2\n1\n0\n1.5 1 1 10\n3.5 1 2 11\n"), ("y", "t\n1.0\n11\n0\nkind\n0\n2\n1\n0\n3 0 0 2 0 3 0 7.5\n2 1 0 4 0 8.5\n0\n")], "file string, text string")
    got = {(r["file"], r["rhoa"]): tuple(r[c] for c in "abmn") for r in text.read_res2dinv(spark, f).collect()}
    assert got == {("x", 10.0): (0, 3, 1, 2), ("x", 11.0): (1, 6, 3, 4), ("y", 7.5): (0, None, 2, 3), ("y", 8.5): (1, None, 4, None)}
    s = {tuple(r) for r in resistivity.schlumberger(spark, 6, 2, 1).collect()}
    assert s == {(0, 3, 1, 2), (1, 4, 2, 3), (2, 5, 3, 4), (0, 5, 2, 3)}


def test_clock_over_midnight(spark):
    r = spark.range(1).select(scalar.clock_difference(F.lit(10.0), F.lit(86390.0)), scalar.clock_difference(F.lit(5.0), F.lit(9.0))).first()
    assert tuple(r) == (20.0, -4.0)
