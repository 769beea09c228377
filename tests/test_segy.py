"""The SEG-Y data source against the decoder of whole files."""

import struct

import numpy as np
import pytest

from sondage.sources import binary, segy

COLUMNS = ["trace", "receiver_id", "source_id", "source_x", "receiver_x", "dt", "delay", "start_s", "samples", "header"]


def content(order=">", kind=5, traces=100, length=16, extended=0, cut=0, counts=None):
    data = bytearray(3600 + 3200 * extended)
    for at, code, v in ((3216, "h", 500), (3220, "H", length), (3224, "h", kind), (3254, "h", 2), (3504, "h", extended)):
        struct.pack_into(order + code, data, at, v)
    for k in range(traces):
        head = bytearray(240)
        for at, code, v in ((8, "i", 10 + k // 12), (12, "i", k), (70, "h", (-100, 0, 10)[k % 3]), (72, "i", k), (80, "i", 4 * k), (108, "h", -3), (114, "H", (counts or {}).get(k, length if k % 2 else 0)), (116, "H", 250 * (k % 2)), (156, "h", (0, 2024, 71, 12)[k % 4]), (158, "h", 60 + k), (160, "h", 23), (162, "h", 5), (164, "h", 59)):
            struct.pack_into(order + code, head, at, v)
        n = (counts or {}).get(k, length)
        data += head + (np.arange(n) * 7 + k).astype(order + binary.SEGY_TYPES[kind]).tobytes()
    return bytes(data[: len(data) - cut])


def values(rows):
    return sorted((r["trace"], *[tuple(r[c]) if c == "samples" else tuple(sorted(r[c].items())) if c == "header" else r[c] for c in COLUMNS[1:]]) for r in rows)


@pytest.mark.parametrize(("order", "kind", "extended", "cut"), [(">", 5, 0, 0), ("<", 1, 1, 0), (">", 3, 2, 7), ("<", 8, 0, 9), (">", 6, 0, 16 * 8 + 100)])
def test_same_rows_as_the_decoder_in_many_tasks(spark, tmp_path, order, kind, extended, cut):
    data = content(order, kind, extended=extended, cut=cut)
    (tmp_path / "a.sgy").write_bytes(data)
    df = segy.register(spark).read.format("segy").option("rangeBytes", "2000").load(str(tmp_path / "a.sgy"))
    assert df.rdd.getNumPartitions() > 10
    assert values(df.collect()) == values([{"header": {}, **t} for t in binary.decode_segy(data)])


def test_traces_of_several_lengths(spark, tmp_path):
    data = content(counts={3: 5, 40: 30}, cut=10)
    (tmp_path / "a.sgy").write_bytes(data)
    read = segy.register(spark).read.format("segy")
    with pytest.raises(Exception, match="lengths = vary"):
        read.load(str(tmp_path)).collect()
    assert values(read.option("lengths", "vary").load(str(tmp_path)).collect()) == values(binary.decode_segy(data))


def test_fewer_columns_and_chosen_ranges(spark, tmp_path):
    (tmp_path / "a.sgy").write_bytes(content(length=2000))
    reads = lambda: segy.register(spark).read.format("segy").option("rangebytes", "20000")
    heads = reads().schema("trace int, source_id string").load(str(tmp_path))
    assert sorted(map(tuple, heads.collect())) == [(k, str(10 + k // 12)) for k in range(100)]
    with pytest.raises(Exception, match="have no colour"):
        reads().schema("trace int, colour string").load(str(tmp_path)).collect()
    reader = segy.ChoosingReader(heads.schema, {"path": str(tmp_path), "rangebytes": "20000"})
    every = reader.partitions()
    list(reader.pushFilters([segy.GreaterThan(("trace",), 30), segy.LessThan(("trace",), 35), segy.EqualTo(("source_id",), "12")]))
    chosen = reader.partitions()
    assert len(every) == 50 and [p.first for p in chosen] == [30, 32, 34]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(r[0] for r in reads().option("pushfilters", "true").load(str(tmp_path)).where("trace BETWEEN 31 AND 33").select("trace").collect()) == [31, 32, 33]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_folders_patterns_and_files_that_are_none(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.sgy").write_bytes(content(traces=3))
    (tmp_path / "x" / "b.bin").write_bytes(b"short")
    (tmp_path / "x" / "._a.sgy").write_bytes(b"short")
    read = segy.register(spark).read.format("segy")
    rows = read.load(str(tmp_path)).collect()
    assert sorted((r["trace"], r["error"]) for r in rows if r["error"] is None) == [(0, None), (1, None), (2, None)]
    assert [r["error"] for r in rows if r["error"]] == ["too short for SEG-Y"]
    assert read.load(f"{tmp_path}/*/*.sgy").count() == 3
    with pytest.raises(Exception, match="nothing"):
        read.load(f"{tmp_path}/nothing").collect()


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(k, k // 5, k * 0.125, 3.0, 0.0005, -0.002, 1_700_000_000.0 if k % 2 else None, [float(k), k / 2, -1.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "receiver_id int, source_id int, receiver_x double, source_x double, dt double, delay double, start_s double, samples array<float>")
    segy.register(spark)
    df.repartition(3).write.format("segy").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("segy").load(str(tmp_path / "out")).selectExpr("int(receiver_id)", "int(source_id)", "receiver_x", "source_x", "dt", "delay", "start_s", "samples")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "samples array<double>").coalesce(1)
    with pytest.raises(Exception, match="in one file"):
        mixed.write.format("segy").mode("append").save(str(tmp_path / "bad"))
    assert list((tmp_path / "bad").iterdir()) == []
