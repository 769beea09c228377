"""SEG-Y as a Spark data source: a file is read in ranges of whole traces by many tasks, and written by tasks.

``spark.read.format("segy").load(path)`` after ``register(spark)``. All traces of a file have one length, so that a range of
traces is a range of bytes: no task holds a file, and a file may be of any size. A schema of fewer columns reads less:
without ``samples`` the samples of long traces aren't read at all.

Options: ``rangebytes`` (64 MB), the bytes of a range; ``lengths`` "vary" for files whose traces differ in length, which
are walked from trace to trace by one task each; ``pushfilters`` "true": comparisons of ``trace`` choose ranges (the session
must push filters to Python sources, spark.sql.python.filterPushdown.enabled). Paths are local or have a scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .binary import FEET, JUNK, SEGY_TYPES, TRACES, ibm_floats
from .binary import read_segy as decode_table

HEAD, TRACE_HEAD = 3600, 240
RANGE_BYTES, AT_ONCE = 64 << 20, 8 << 20


@dataclass(frozen=True)
class Layout:
    """What the headers of a file say: byte order, where traces start, samples and sample format, interval and unit codes."""

    order: str
    start: int
    samples: int
    kind: int
    interval: int
    unit: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.order + SEGY_TYPES[self.kind])

    @property
    def stride(self) -> int:
        return TRACE_HEAD + self.samples * self.dtype.itemsize


def layout(head: bytes) -> Layout:
    if len(head) < HEAD:
        raise ValueError("too short for SEG-Y")
    for order in "><":
        interval, samples, kind, unit, more = (struct.unpack_from(order + "h", head, 3200 + k)[0] for k in (16, 20, 24, 54, 304))
        if kind in SEGY_TYPES and samples & 0xFFFF:
            return Layout(order, HEAD + 3200 * max(more, 0), samples & 0xFFFF, kind, interval & 0xFFFF, unit)
    raise ValueError("no known sample format")


@dataclass
class TraceRange(InputPartition):
    """Traces ``first`` to ``first + count`` of a file; ``kept``: samples of the last one, if the file ends in it."""

    path: str
    first: int
    count: int
    layout: Layout | None
    kept: int | None = None
    vary: bool = False
    error: str | None = None


def _fields(block: np.ndarray, lay: Layout, first: int) -> dict[str, np.ndarray]:
    """Header columns of a block of trace headers (a row of 240 bytes each)."""
    at = lambda k, size: np.ascontiguousarray(block[:, k - 1 : k - 1 + size]).view(f"{lay.order}i{size}")[:, 0].astype(np.int64)
    scale = at(71, 2).astype(float)
    to_m = (FEET if lay.unit == 2 else 1.0) * np.where(scale > 0, scale, np.where(scale < 0, 1 / -np.where(scale == 0, 1, scale), 1.0))
    year = at(157, 2)
    year = np.where((year >= 0) & (year < 100), np.where(year < 70, year + 2000, year + 1900), year)
    start = (year - 1970).astype("M8[Y]").astype("M8[s]").astype(np.int64) + (at(159, 2) - 1) * 86400 + at(161, 2) * 3600 + at(163, 2) * 60 + at(165, 2)
    interval = at(117, 2) & 0xFFFF
    return {
        "trace": np.arange(first, first + len(block), dtype=np.int32),
        "receiver_id": at(13, 4).astype(str),
        "source_id": at(9, 4).astype(str),
        "source_x": at(73, 4) * to_m,
        "receiver_x": at(81, 4) * to_m,
        "dt": np.where(interval > 0, interval, lay.interval) / 1e6,
        "delay": at(109, 2) / 1000,
        "start_s": np.where(at(157, 2) != 0, start.astype(float), np.nan),
        "count": at(115, 2) & 0xFFFF,
    }


def _batch(schema: pa.Schema, path: str, lay: Layout, fields: dict[str, np.ndarray], samples: list[np.ndarray] | None, cut: dict[int, str]) -> pa.RecordBatch:
    """Columns of ``schema``; ``cut``: rows whose trace ends early, with what their header says of it."""
    n = len(fields["trace"])
    if samples is not None and "samples" in schema.names:
        values = np.concatenate(samples) if samples else np.empty(0)
        ends = np.concatenate([[0], np.cumsum([len(s) for s in samples])]).astype(np.int32)
        values = ibm_floats(values.astype(np.uint32)) if lay.kind == 1 else values.astype(float)
    made = []
    for f in schema:
        if f.name == "file":
            made.append(pa.array([path] * n, f.type))
        elif f.name == "samples":
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)).cast(f.type))
        elif f.name == "header":
            made.append(pa.array([[("format", str(lay.kind)), *([("TRUNCATED", cut[i])] if i in cut else [])] for i in range(n)], f.type))
        elif f.name == "error":
            made.append(pa.nulls(n, f.type))
        elif f.name == "start_s":
            made.append(pa.array(fields["start_s"], mask=np.isnan(fields["start_s"])).cast(f.type))
        else:
            made.append(pa.array(fields[f.name]).cast(f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def files_of(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Files of a path: one file, all below a folder, or those that match a pattern; what systems leave beside them is left out."""
    cut = re.search(r"[*?\[]", path)
    fixed = path[: path.rfind("/", 0, cut.start()) + 1] if cut else path
    fs, base = pafs.FileSystem.from_uri(fixed.rstrip("/") or "/")
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
    if cut:
        rest = f"{base.rstrip('/')}/{path[len(fixed) :]}"
        found = [f for f in found if fnmatch.fnmatch(f.path, rest)]
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and not re.search(JUNK, f.path) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


class SegySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return TRACES

    def reader(self, schema: StructType) -> SegyReader:
        chosen = self.options.get("pushfilters", "false") == "true"
        return (ChoosingReader if chosen else SegyReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SegyWriter:
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        return SegyWriter(schema, self.options)


class SegyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        known = {x.strip().split(" ", 1)[0] for x in re.sub(r"<[^>]*>", "", TRACES).split(",")}
        if more := set(schema.names) - known:
            raise ValueError(f"SEG-Y traces have no {', '.join(sorted(more))}")
        self.arrow, self.names = to_arrow_schema(schema), schema.names
        self.path = options.get("path", "")
        self.range_bytes, self.vary = int(options.get("rangebytes", RANGE_BYTES)), options.get("lengths", "equal") == "vary"
        self.low, self.high = 0, None

    def partitions(self) -> list[TraceRange]:
        fs, found = files_of(self.path)
        out: list[TraceRange] = []
        for info in found:
            try:
                with fs.open_input_file(info.path) as f:
                    lay = layout(f.read_at(HEAD, 0))
                if self.vary:
                    out.append(TraceRange(info.path, 0, 0, lay, vary=True))
                    continue
                whole, rest = divmod(max(0, info.size - lay.start), lay.stride)
                kept = (rest - TRACE_HEAD) // lay.dtype.itemsize if rest > TRACE_HEAD else 0
                n = whole + (kept > 0)
                if not n:
                    raise ValueError("no traces after the headers")
                step = max(1, self.range_bytes // lay.stride)
                for first in range(0, n, step):
                    count = min(step, n - first)
                    if first + count > self.low and (self.high is None or first < self.high):
                        out.append(TraceRange(info.path, first, count, lay, kept if kept and first + count == n else None))
            except ValueError as e:
                out.append(TraceRange(info.path, 0, 0, None, error=str(e)))
        return out

    def read(self, part: TraceRange) -> Iterator[pa.RecordBatch]:
        if part.error:
            yield pa.RecordBatch.from_arrays([pa.array([{"file": part.path, "error": part.error}.get(f.name)], f.type) for f in self.arrow], schema=self.arrow)
            return
        fs, path = pafs.FileSystem.from_uri(self.path.split("*")[0].rstrip("/") or "/")[0], part.path
        with fs.open_input_file(path) as f:
            yield from self._walk(f, part) if part.vary else self._range(f, part)

    def _range(self, f: pa.NativeFile, part: TraceRange) -> Iterator[pa.RecordBatch]:
        lay = part.layout
        whole = "samples" in self.names or lay.stride < 16 * TRACE_HEAD
        step = max(1, AT_ONCE // lay.stride) if whole else AT_ONCE // TRACE_HEAD
        for first in range(part.first, part.first + part.count, step):
            n = min(step, part.first + part.count - first)
            at = lay.start + first * lay.stride
            cut = part.kept is not None and first + n == part.first + part.count
            if whole:
                raw = f.read_at(n * lay.stride, at)
                block = np.frombuffer(raw.ljust(n * lay.stride, b"\0"), np.uint8).reshape(n, lay.stride)
            else:
                block = np.frombuffer(b"".join(f.read_at(TRACE_HEAD, at + i * lay.stride) for i in range(n)), np.uint8).reshape(n, TRACE_HEAD)
            fields = _fields(block[:, :TRACE_HEAD], lay, first)
            if (odd := np.flatnonzero((fields["count"] != lay.samples) & (fields["count"] != 0))).size:
                raise ValueError(f"{part.path}: trace {first + odd[0]} has {fields['count'][odd[0]]} samples, the file {lay.samples}; read it with the option lengths = vary")
            samples = None
            if "samples" in self.names:
                values = np.ascontiguousarray(block[:, TRACE_HEAD:]).view(lay.dtype)
                samples = [*values[:-1], values[-1, : part.kept if cut else None]]
            yield _batch(self.arrow, part.path, lay, fields, samples, {n - 1: f"{part.kept}/{lay.samples}"} if cut else {})

    def _walk(self, f: pa.NativeFile, part: TraceRange) -> Iterator[pa.RecordBatch]:
        """Traces of any lengths, one after the other; a batch when enough bytes are held."""
        lay, size, at, first = part.layout, f.size(), part.layout.start, 0
        heads: list[bytes] = []
        samples: list[np.ndarray] = []
        cut: dict[int, str] = {}
        held = 0

        def batch() -> pa.RecordBatch:
            block = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), TRACE_HEAD)
            return _batch(self.arrow, part.path, lay, _fields(block, lay, first), samples, cut)

        while at + TRACE_HEAD <= size:
            head = f.read_at(TRACE_HEAD, at)
            count = (struct.unpack_from(lay.order + "h", head, 114)[0] & 0xFFFF) or lay.samples
            kept = min(count, (size - at - TRACE_HEAD) // lay.dtype.itemsize)
            if kept <= 0:
                break
            if kept < count:
                cut[len(heads)] = f"{kept}/{count}"
            heads.append(head)
            samples.append(np.frombuffer(f.read_at(kept * lay.dtype.itemsize, at + TRACE_HEAD), lay.dtype) if "samples" in self.names else np.empty(0))
            at += TRACE_HEAD + count * lay.dtype.itemsize
            held += kept * lay.dtype.itemsize
            if held > AT_ONCE or len(heads) >= 10_000:
                yield batch()
                first, held = first + len(heads), 0
                heads, samples, cut = [], [], {}
        if heads:
            yield batch()
        elif not first:
            yield from self.read(replace(part, error="no traces after the headers"))


class ChoosingReader(SegyReader):
    """A reader that is told the filters: bounds of ``trace`` choose ranges; Spark still applies every filter."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if getattr(f, "attribute", None) == ("trace",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class SegyWriter(DataSourceArrowWriter):
    """A file per task, of 32-bit IEEE floats, big-endian, distances in millimetres.

    Columns: samples; and, if there, receiver_id and source_id (integers), receiver_x, source_x, dt, delay, start_s. All
    traces of a task must have as many samples. A task that fails leaves no file behind.
    """

    def __init__(self, schema: StructType, options: dict):
        if "samples" not in schema.names:
            raise ValueError("samples are needed")
        self.path = options.get("path", "").rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        path, part, length, number = None, None, None, 0
        out = None
        try:
            for batch in batches:
                if not len(batch):
                    continue
                lengths = set(batch.column("samples").value_lengths().to_pylist())
                length = next(iter(lengths)) if length is None else length
                if lengths != {length} or not length:
                    raise ValueError(f"traces of {sorted(map(str, lengths | {length}))} samples in one file")
                if out is None:
                    part = f"{base}/_{uuid.uuid4().hex}"
                    path = f"{base}/part-{uuid.uuid4().hex}.sgy"
                    out = fs.open_output_stream(part)
                    dt = round((batch.column("dt")[0].as_py() or 0) * 1e6) if "dt" in batch.schema.names else 0
                    out.write(b" " * 3200 + struct.pack(">16xHxxHxxh", dt, length, 5).ljust(400, b"\0"))
                out.write(_encoded(batch, length, number))
                number += len(batch)
            if out is not None:
                out.close()
                fs.move(part, path)
        except BaseException:
            if part is not None:
                out.close()
                fs.delete_file(part)
            raise
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        """Files have their names already."""

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


def _encoded(batch: pa.RecordBatch, length: int, first: int) -> bytes:
    n = len(batch)
    block = np.zeros((n, TRACE_HEAD + 4 * length), np.uint8)

    def put(at: int, values: np.ndarray, kind: str) -> None:
        v = values.astype(kind)
        block[:, at - 1 : at - 1 + v.itemsize] = v.view(np.uint8).reshape(n, v.itemsize)

    column = lambda name, scale=1.0: np.rint(np.nan_to_num(batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)) * scale) if name in batch.schema.names else np.zeros(n)
    put(1, np.arange(first + 1, first + n + 1), ">i4")
    put(9, column("source_id"), ">i4")
    put(13, column("receiver_id"), ">i4")
    put(71, np.full(n, -1000), ">i2")
    put(73, column("source_x", 1000), ">i4")
    put(81, column("receiver_x", 1000), ">i4")
    put(109, column("delay", 1000), ">i2")
    put(115, np.full(n, length), ">u2")
    put(117, column("dt", 1e6), ">u2")
    if "start_s" in batch.schema.names:
        at = batch.column("start_s")
        known = ~np.asarray(at.is_null())
        t = np.floor(np.nan_to_num(at.to_numpy(zero_copy_only=False))).astype(np.int64).astype("M8[s]")
        day, year = t.astype("M8[D]"), t.astype("M8[Y]")
        second = (t - day.astype("M8[s]")).astype(np.int64)
        for k, v in ((157, year.astype(np.int64) + 1970), (159, (day - year.astype("M8[D]")).astype(np.int64) + 1), (161, second // 3600), (163, second // 60 % 60), (165, second % 60)):
            put(k, np.where(known, v, 0), ">i2")
    values = batch.column("samples").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, length)
    block[:, TRACE_HEAD:] = np.ascontiguousarray(values.astype(">f4")).view(np.uint8).reshape(n, 4 * length)
    return block.tobytes()


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    spark.dataSource.register(SegySource)
    return spark


def read_segy(spark: SparkSession, path: str | list[str] | DataFrame, **options) -> DataFrame:
    """Traces of files by ranges (options as above); a table of (path, content) is decoded file by file."""
    if isinstance(path, DataFrame):
        return decode_table(spark, path)
    each = [register(spark).read.format("segy").options(**options).load(p) for p in ([path] if isinstance(path, str) else path)]
    out = each[0]
    for more in each[1:]:
        out = out.unionAll(more)
    return out
