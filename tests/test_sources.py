import struct

import numpy as np
import pytest

from sondage.sources import binary, text


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode("latin-1"))
    return str(p)


def test_g857(spark, tmp_path):
    five = put(tmp_path, "a.asc", "# Line Station Time Field Quality\nL1 S1 10:30:15 52431.2 3.0\nL1 S2 10:30:20 52428.5 1.5\r\n\n")
    three = put(tmp_path, "b.txt", "station time value_nT\nS1 10:30:15 52431.2\nS2 10:30:20 NaN\n")
    rows = text.read_g857(spark, five, min_quality=2.0).collect()
    assert [(r["line"], r["station"], r["field"], r["quality"], r["row_seq"]) for r in rows] == [("L1", "S1", 52431.2, 3.0, 2)]
    rows = text.read_g857(spark, three, min_quality=2.0).collect()
    assert [(r["line"], r["station"], r["time"], r["field"]) for r in rows] == [(None, "S1", "10:30:15", 52431.2)]


def test_cg5(spark, tmp_path):
    p = put(tmp_path, "g.txt", "/\t\tCG-5 SURVEY\n/\tTide Correction: YES\n/\tTerrain Corr.: NO\n/---\n/Line\tStation\n1.0\t100.0\t350.0\t3123.456\t0.012\t-1.2\t0.5\t0.01\t0.023\t60\t5\t10:01:02\t46000.4\t0.0\t2026/03/12\n")
    r = text.read_cg5(spark, p).first()
    assert (r["station"], r["grav"], str(r["time"]), r["tilty"]) == ("100", 3123.456, "2026-03-12 10:01:02", 0.5)
    assert {x["key"]: x["value"] for x in text.cg5_options(spark, p).collect()} == {"tide_correction": "YES", "terrain_corr": "NO"}


def test_magnetics_summary_and_gem2(spark, tmp_path):
    p = put(tmp_path, "m.csv", "Line_No,Station\n1,1,0.0,2,50100.0,4.1,12.0,50112.3\n1,1,13.0,2,50180.0,,12.0,50192.3\n")
    rows = text.read_magnetics_summary(spark, p).orderBy("row_seq").collect()
    assert [(r["station_id"], r["occupation"], r["stddev_nt"]) for r in rows] == [("1-1", 1, 4.1), ("1-1", 2, None)] and rows[1]["distance"] == pytest.approx(3.9624)
    p = put(tmp_path, "e.csv", "#File:x,6 Samples\nLine ,Sample,GPSalt(m),I_5310Hz(ppm)  ,Q_5310Hz(ppm)\n 1, 1, 340.5, -340.0, 130.0\n 1, 2, 340.5, , 131.0\n")
    names = text.gem2_header(spark, p)
    assert names == ["line", "sample", "gpsalt", "I_5310", "Q_5310"]
    assert [(r["I_5310"], r["Q_5310"]) for r in text.read_gem2(spark, p, names).orderBy("row_seq").collect()] == [(-340.0, 130.0), (None, 131.0)]


def test_positions(spark, tmp_path):
    head = "Name,Longitude,Latitude,Ellipsoidal height,Antenna height,Solution status,Averaging start,Averaging end\n"
    p = put(tmp_path, "p.csv", head + "S1,-92.0,38.0,320.0,2.134,FIX,2026-05-14 12:00:30.0 UTC-05:00,2026-05-14 13:01:05.0 UTC-04:00\nS1,-92.1,38.0,321.0,2.134,FLOAT,,\n")
    with pytest.raises(ValueError, match="S1"):
        text.read_positions(spark, p, "antenna")
    with pytest.raises(ValueError):
        text.read_positions(spark, p, "sea level")
    first = text.read_positions(spark, p, "antenna", on_duplicate="first").collect()
    assert len(first) == 1 and first[0]["height"] == pytest.approx(317.866) and first[0]["end_s"] - first[0]["start_s"] == 35.0
    assert text.read_positions(spark, p, "ground", on_duplicate="keep").count() == 2


def test_resistivity_files(spark, tmp_path):
    row = lambda i, *x: f"   {i},USER ,20261111,12:06:20, 4.0E+00,  3,435, 4.8E+01,p , " + ", ".join(f"{v}, 0.0, 0.0" for v in x) + f",Cmd=1,Ch={i}\n"
    p = put(tmp_path, "l.stg", "Sting\nFirmware Records: 2\nUnit: feet\n" + row(1, 2.0, 0.0, 4.0, 6.0) + row(2, 2.0, 0.0, 6.0, 8.0))
    records = text.read_stg(spark, p)
    assert records.first()["ax"] == pytest.approx(0.6096) and records.first()["error"] == 0.003 and records.orderBy("record").collect()[1]["channel"] == 2
    assert [tuple(r[c] for c in "abmn") for r in text.stg_readings(records).orderBy("record").collect()] == [(1, 0, 2, 3), (1, 0, 3, 4)]
    p = put(tmp_path, "l.dat", "t\n 0.5\n3\n2\n1\n0\n 0.75 0.5 1.0 88.4\n 1.0 0.5 2.0 42.0\n0\n0\n")
    rows = text.read_res2dinv(spark, p).orderBy("row_seq").collect()
    assert [tuple(r[c] for c in ("a", "b", "m", "n", "rhoa")) for r in rows] == [(1, 0, 2, 3, 88.4), (1, 0, 3, 4, 42.0)]
    lines = [r["line"] for r in text.res2dinv_lines(text.read_res2dinv(spark, p), "t", 0.5).orderBy("pos").collect()]
    again = text.read_res2dinv(spark, put(tmp_path, "g.dat", "\n".join(lines) + "\n")).orderBy("row_seq").collect()
    assert [tuple(r[c] for c in ("a", "b", "m", "n", "rhoa")) for r in again] == [(1, 0, 2, 3, 88.4), (1, 0, 3, 4, 42.0)]


def test_nmea(spark, tmp_path):
    p = put(tmp_path, "n.txt", "$GPRMC,120000,A,3755.5010,N,09146.5853,W,0\n$SDDPT,1.75,0\n$SDDPT,9.9,0\n$GPRMC,120000,A,3755.0,N,09146.0,W,0\n$GPRMC,120001,V,1,N,1,W\n  1.0, 2.0, $GPGGA,120002,3756.8694,S,09147.1751,E,2,09,0.9,340.5,M\n")
    rows = text.read_nmea(spark, p).orderBy("row_seq").collect()
    assert [r["time"] for r in rows] == ["120000", "120002"] and rows[0]["depth"] == 1.75 and rows[1]["depth"] is None
    assert rows[0]["latitude"] == pytest.approx(37.925017, abs=1e-6) and rows[1]["latitude"] < 0 < rows[1]["longitude"]


def seg2(traces, info, unit="METERS"):
    def block(pairs):
        out = b""
        for k, v in pairs.items():
            s = f"{k} {v}".encode() + b"\0"
            out += struct.pack("<H", len(s) + 2) + s
        return out + b"\0\0"

    head = block({**info, "UNITS": unit})
    n = len(traces)
    parts, at, where = [], 32 + 4 * n + len(head), []
    for t, values in traces:
        strings = block(t)
        where.append(at)
        body = np.asarray(values, "<f4").tobytes()
        parts.append(struct.pack("<HHIIB", 0x4422, 32 + len(strings), len(body), len(values), 4).ljust(32, b"\0") + strings + body)
        at += len(parts[-1])
    return struct.pack("<HHHHB", 0x3A55, 1, 4 * n, n, 1).ljust(32, b"\0") .replace(b"\x01\0", b"\x01\0", 1) + struct.pack(f"<{n}I", *where) + head + b"".join(parts)


def test_seg2(spark, tmp_path):
    data = seg2([({"SAMPLE_INTERVAL": 0.000125, "RECEIVER_LOCATION": 4 * i, "SOURCE_LOCATION": -12, "DELAY": 0.001}, np.arange(8) * i) for i in range(3)], {"ACQUISITION_DATE": "18/09/2026", "ACQUISITION_TIME": "10:00:01"}, "FEET")
    put(tmp_path, "s.dat", data), put(tmp_path, "bad.dat", b"nothing")
    rows = binary.read_seg2(spark, str(tmp_path)).orderBy("trace").collect()
    assert rows[0]["error"] and [r["trace"] for r in rows[1:]] == [0, 1, 2]
    assert rows[3]["receiver_x"] == pytest.approx(8 * 0.3048) and rows[3]["source_x"] == pytest.approx(-12 * 0.3048) and rows[3]["samples"] == [2.0 * i for i in range(8)]
    assert rows[1]["dt"] == 0.000125 and rows[1]["delay"] == 0.001 and rows[1]["start_s"] is not None


@pytest.mark.parametrize("order,kind", [(">", 1), ("<", 5), (">", 2)])
def test_segy(spark, tmp_path, order, kind):
    values = np.array([0.0, 1.0, -2.5, 118.625])
    ibm = [0, 0x41100000, 0xC1280000, 0x4276A000]
    body = struct.pack(order + "4I", *ibm) if kind == 1 else np.asarray(values, order + {5: "f4", 2: "i4"}[kind]).tobytes()
    head = bytearray(3600)
    for k, v in ((3216, 125), (3220, 4), (3224, kind), (3254, 2)):
        struct.pack_into(order + "h", head, k, v)
    out = bytes(head)
    for i in range(2):
        t = bytearray(240)
        for k, v in ((9, 4001 + i), (13, i + 1), (73, 112), (81, 4 * i)):
            struct.pack_into(order + "i", t, k - 1, v)
        for k, v in ((115, 4), (117, 125), (157, 26), (159, 254), (161, 13), (163, 19), (165, 34)):
            struct.pack_into(order + "h", t, k - 1, v)
        out += bytes(t) + body
    rows = binary.read_segy(spark, put(tmp_path, "s.sgy", out)).orderBy("trace").collect()
    assert [r["source_id"] for r in rows] == ["4001", "4002"] and rows[1]["receiver_x"] == pytest.approx(4 * 0.3048)
    assert rows[0]["samples"] == ([0, 1, -2, 118] if kind == 2 else values.tolist()) and rows[0]["dt"] == 125e-6
    assert rows[0]["start_s"] == 1789132774.0


def test_node_files(spark, tmp_path):
    values = np.array([0, 1, -1, 8388607, -8388608])
    head = ("\r\n".join(["Atom  ", "101525", *["x"] * 14, "2026/09/18", "17:00:00"])).encode().ljust(0xEC, b"\0") + b"N3755.5010 \r\nW09146.5853 \r\n+0333.29\r\n"
    packed = ((values << 8) | np.where(values < 0, 0xFF, 0)).astype("<i4").tobytes()
    put(tmp_path, "a.atm", head.ljust(512, b"\0") + packed + b"\1\2"), put(tmp_path, "b.atm", head.ljust(512, b"\0") + b"\1" + packed[1:]), put(tmp_path, "c.txt", b"")
    rows = binary.read_atm(spark, str(tmp_path))
    good = rows.where("error IS NULL").first()
    assert good["samples"] == values.tolist() and float(good["header"]["latitude"]) == pytest.approx(37.925017, abs=1e-6)
    inv = {r["file"][-5:]: r for r in binary.inventory(rows).collect()}
    assert inv["a.atm"]["rms"] == pytest.approx(values.std()) and inv["a.atm"]["end"] - inv["a.atm"]["start"] == pytest.approx(0.02)
    assert inv["b.atm"]["n"] is None and "sign byte" in inv["b.atm"]["error"]
