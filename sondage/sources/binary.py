"""Binary records: SEG-2, SEG-Y and node minute-files, one row per trace, decoded in tasks from ``binaryFile``."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEET = 0.3048
#: Paths of files that archives and file systems leave beside real ones.
JUNK = r"(^|/)(\._|__MACOSX/|\.DS_Store|Thumbs\.db)"
TRACES = "file string, trace int, receiver_id string, source_id string, source_x double, receiver_x double, dt double, delay double, start_s double, samples array<double>, header map<string, string>, error string"
EMPTY = {"trace": None, "receiver_id": None, "source_id": None, "source_x": None, "receiver_x": None, "dt": None, "delay": None, "start_s": None, "samples": None, "header": {}, "error": None}


def _decoded(spark: SparkSession, path: str | list[str] | DataFrame, decode, pattern: str | None = None) -> DataFrame:
    """Rows of ``decode(bytes)`` for every file; a file that can't be read gives a row with its error.

    ``path``: files, or a table of them (path, content), as ``files.unzipped`` gives. A file is one task's work.
    """
    if isinstance(path, DataFrame):
        files = path.select("path", "content")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).where(f"NOT path RLIKE r'{JUNK}'").select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                try:
                    out = [{**EMPTY, **x} for x in decode(bytes(data))]
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    out = [{**EMPTY, "error": str(e)[:200] or type(e).__name__}]
                yield pd.DataFrame([{"file": name, **x} for x in out])

    return files.mapInPandas(rows, TRACES)


def _keywords(block: bytes, order: str, end: bytes) -> dict[str, str]:
    """The free-format strings of a SEG-2 descriptor block: each leads with its own length, and a zero length is the last."""
    found: dict[str, str] = {}
    while len(block) > 2 and (size := int.from_bytes(block[:2], "little" if order == "<" else "big")) > 2:
        said, block = block[2:size].partition(end)[0].decode("latin-1").strip(), block[size:]
        if said:
            name, *value = said.split(None, 1)
            found[name.upper()] = value[0] if value else ""
    return found


def _first_number(value: str | None) -> float | None:
    try:
        return float(value.replace(",", " ").split()[0])
    except (AttributeError, IndexError, ValueError):
        return None


#: SEG-2 data format codes: 16 and 32 bit integers, 32 and 64 bit floats.
SEG2_TYPES = {1: "i2", 2: "i4", 4: "f4", 5: "f8"}


def decode_seg2(data: bytes) -> list[dict]:
    """Traces of a shot record of either byte order; feet become metres, missing locations are null.

    A record that ends early keeps the samples it has, and its header says so (TRUNCATED: kept/declared).
    """
    order = {b"\x55\x3a": "<", b"\x3a\x55": ">"}.get(data[:2])
    if order is None or len(data) < 32:
        raise ValueError("not a SEG-2 file")
    pointers, n = struct.unpack_from(order + "HH", data, 4)
    if n == 0 or pointers < 4 * n:
        raise ValueError(f"{n} traces in {pointers} bytes of pointers")
    end = data[9 : 9 + data[8]] or b"\0"
    starts = struct.unpack_from(f"{order}{n}I", data, 32)
    info = _keywords(data[32 + pointers : starts[0]], order, end)
    unit = FEET if info.get("UNITS", "").upper().startswith(("FEET", "FOOT", "FT")) else 1.0
    start = None
    try:
        start = datetime.strptime(f"{info['ACQUISITION_DATE']} {info['ACQUISITION_TIME'][:8]}", "%d/%m/%Y %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()
    except (KeyError, ValueError):
        pass
    out = []
    for i, at in enumerate(starts):
        mark, size, _, count, kind = struct.unpack_from(order + "HHIIB", data, at)
        if mark != 0x4422 or kind not in SEG2_TYPES:
            raise ValueError(f"trace {i}: no trace block or format {kind}")
        head = _keywords(data[at + 32 : at + size], order, end)
        dtype = np.dtype(order + SEG2_TYPES[kind])
        kept = max(0, min(count, (len(data) - at - size) // dtype.itemsize))
        if kept < count:
            head["TRUNCATED"] = f"{kept}/{count}"
        place = lambda k, head=head: None if (x := _first_number(head.get(k))) is None else x * unit
        values = np.frombuffer(data, dtype, kept, at + size).astype(float) * (_first_number(head.get("DESCALING_FACTOR")) or 1.0)
        out.append({"trace": i, "receiver_id": str(i), "source_id": "S1", "source_x": place("SOURCE_LOCATION"), "receiver_x": place("RECEIVER_LOCATION"), "dt": _first_number(head["SAMPLE_INTERVAL"]), "delay": _first_number(head.get("DELAY")) or 0.0, "start_s": start, "samples": values, "header": {**info, **head}})
    return out


def encode_seg2(traces: list[tuple], order: str = ">", **info: str) -> bytes:
    """A SEG-2 record of (samples, keywords) as 32-bit floats."""

    def words(keys: dict[str, str]) -> bytes:
        out = b""
        for k, v in keys.items():
            said = f"{k} {v}".encode("latin-1") + b"\0"
            out += struct.pack(order + "H", len(said) + 2) + said
        return out + struct.pack(order + "H", 0)

    head = words(info)
    blocks = []
    for samples, keys in traces:
        v, said = np.asarray(samples, order + "f4"), words(keys)
        blocks.append(struct.pack(order + "HHIIB", 0x4422, 32 + len(said), v.nbytes, len(v), 4).ljust(32, b"\0") + said + v.tobytes())
    at, starts = 32 + 4 * len(blocks) + len(head), []
    for b in blocks:
        starts.append(at)
        at += len(b)
    top = struct.pack(order + "HHHH", 0x3A55, 1, 4 * len(blocks), len(blocks)) + b"\1\0\0\1\n\0"
    return top.ljust(32, b"\0") + struct.pack(f"{order}{len(starts)}I", *starts) + head + b"".join(blocks)


def ibm_floats(raw: np.ndarray) -> np.ndarray:
    """IBM 32-bit floats given as unsigned integers."""
    sign, power, fraction = np.where(raw >> 31, -1.0, 1.0), ((raw >> 24) & 0x7F).astype(float), (raw & 0xFFFFFF).astype(float)
    return sign * fraction / 2.0**24 * 16.0 ** (power - 64)


#: SEG-Y sample formats: IBM floats (1), and numpy types of the others.
SEGY_TYPES = {1: "u4", 2: "i4", 3: "i2", 5: "f4", 6: "f8", 8: "i1"}


def decode_segy(data: bytes) -> list[dict]:
    """Traces of a SEG-Y file of either byte order, IBM or IEEE floats or integers; field records are sources.

    Extended text headers are skipped. A trace that ends early keeps the samples it has (TRUNCATED in its header).
    """
    if len(data) < 3840:
        raise ValueError("too short for SEG-Y")
    fits = lambda o: struct.unpack_from(o + "h", data, 3224)[0] in SEGY_TYPES and struct.unpack_from(o + "H", data, 3220)[0] > 0
    order = next((o for o in "><" if fits(o)), None)
    if order is None:
        raise ValueError("no known sample format")
    dt, n, kind, unit, more = (struct.unpack_from(order + "h", data, 3200 + k)[0] for k in (16, 20, 24, 54, 304))
    dtype = np.dtype(order + SEGY_TYPES[kind])
    out, at = [], 3600 + 3200 * max(more, 0)
    while at + 240 <= len(data):
        i4 = lambda k, at=at: struct.unpack_from(order + "i", data, at + k - 1)[0]
        i2 = lambda k, at=at: struct.unpack_from(order + "h", data, at + k - 1)[0]
        count = i2(115) & 0xFFFF or n & 0xFFFF
        kept = min(count, (len(data) - at - 240) // dtype.itemsize)
        if kept <= 0:
            break
        raw = np.frombuffer(data, dtype, kept, at + 240)
        s = i2(71)
        to_m = (FEET if unit == 2 else 1.0) * (s if s > 0 else 1 / -s if s < 0 else 1.0)
        year, start = i2(157), None
        if year:
            year += (2000 if year < 70 else 1900) if year < 100 else 0
            start = (datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(days=i2(159) - 1, hours=i2(161), minutes=i2(163), seconds=i2(165))).timestamp()
        header = {"format": str(kind)} | ({"TRUNCATED": f"{kept}/{count}"} if kept < count else {})
        out.append({"trace": len(out), "receiver_id": str(i4(13)), "source_id": str(i4(9)), "source_x": i4(73) * to_m, "receiver_x": i4(81) * to_m, "dt": (i2(117) & 0xFFFF or dt & 0xFFFF) / 1e6, "delay": i2(109) / 1000, "start_s": start, "samples": ibm_floats(raw) if kind == 1 else raw.astype(float), "header": header})
        at += 240 + count * dtype.itemsize
    if not out:
        raise ValueError("no traces after the headers")
    return out


def _degrees(token: str) -> float:
    """[NSEW] with degrees and decimal minutes run together: minutes are the last two digits before the point."""
    whole = token.index(".") - 2
    size = float(token[1:whole]) + float(token[whole:]) / 60
    return -size if token[0] in "SW" else size


def decode_atm(data: bytes, rate: float = 250.0) -> list[dict]:
    """A node's minute: a text header of 512 bytes, samples of 24 bits behind a sign byte; a partial last sample is dropped."""
    if data[:4] != b"Atom":
        raise ValueError("not a node file")
    said = data[:512].decode("latin-1")
    lines = [x.strip(" \0") for x in said[:0xEC].split("\r\n")]
    raw = np.frombuffer(data[512 : 512 + (len(data) - 512) // 4 * 4], "<i4")
    values, low = raw >> 8, raw & 0xFF
    if np.any(low != np.where(values < 0, 0xFF, 0)):
        raise ValueError("a sign byte disagrees with its sample")
    start = None
    if len(lines) > 17:
        try:
            start = datetime.strptime(" ".join(lines[16:18]), "%Y/%m/%d %H:%M:%S").replace(tzinfo=timezone.utc).timestamp()
        except ValueError:
            pass
    header = {"unit": lines[1]}
    for name, shape in (("latitude", r"[NS]\d{4}\.\d+"), ("longitude", r"[EW]\d{5}\.\d+")):
        if fix := re.search(shape, said):
            header[name] = str(_degrees(fix[0]))
    if fix := re.search(r"[EW]\d{5}\.\d+\s*([+-]\d+\.\d+)", said):
        header["elevation"] = str(float(fix[1]))
    return [{"trace": 0, "receiver_id": lines[1], "dt": 1 / rate, "delay": 0.0, "start_s": start, "samples": values.astype(float), "header": header}]


def read_seg2(spark: SparkSession, path: str | DataFrame, pattern: str | None = None) -> DataFrame:
    return _decoded(spark, path, decode_seg2, pattern)


def read_segy(spark: SparkSession, path: str | DataFrame, pattern: str | None = None) -> DataFrame:
    return _decoded(spark, path, decode_segy, pattern)


def read_atm(spark: SparkSession, path: str | DataFrame, pattern: str = "*.atm") -> DataFrame:
    return _decoded(spark, path, decode_atm, pattern)


def inventory(traces: DataFrame) -> DataFrame:
    """A row per node file: start and end, number of samples, deviation and largest size; unreadable files keep their error."""
    n, mean = F.size("samples"), lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size("samples")
    m = mean(F.col("samples"))
    var = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v) / n - m * m
    return traces.select("file", F.col("receiver_id").alias("node"), F.col("start_s").alias("start"), (F.col("start_s") + n * F.col("dt")).alias("end"), F.when(F.col("error").isNull(), n).alias("n"), F.when(n > 0, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("rms"), F.array_max(F.transform("samples", F.abs)).alias("largest"), "error")


def common_axis(traces: DataFrame, rate: float) -> DataFrame:
    """(node, i, v): samples of node files on one axis of absolute time, i from the earliest start on.

    Records are placed by their start, to the nearest sample; what no record covers has no row, so a gap stays a gap.
    Where records of a node overlap, the sample of the later file counts. Records without a start are left out.
    """
    placed = traces.where("error IS NULL AND start_s IS NOT NULL").select(F.col("receiver_id").alias("node"), "file", "start_s", "samples")
    zero = placed.agg(F.min("start_s").alias("zero"))  # one row
    each = placed.crossJoin(F.broadcast(zero)).select("node", "file", "start_s", F.rint((F.col("start_s") - F.col("zero")) * rate).cast("long").alias("first"), F.posexplode("samples").alias("k", "v"))
    return each.groupBy("node", (F.col("first") + F.col("k")).alias("i")).agg(F.max_by("v", F.struct("start_s", "file")).alias("v"))
