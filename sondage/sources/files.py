"""Finding files, looking inside archives, telling formats apart and reading by the right reader."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, segy, text

#: name -> (extensions, sniff(first bytes) -> bool, read(spark, path, **options)); ``register`` adds to it.
READERS: dict[str, tuple[tuple[str, ...], Callable[[bytes], bool], Callable]] = {}
_HEAD = 4096


def register(name: str, extensions: tuple[str, ...], sniff: Callable[[bytes], bool], read: Callable, replace: bool = False) -> None:
    """Add a reader: ``sniff`` looks at a file's first bytes, ``read(spark, path, **options)`` gives a DataFrame."""
    if name in READERS and not replace:
        raise ValueError(f"a reader named {name} is registered already")
    READERS[name] = (tuple(e.lower() for e in extensions), sniff, read)


def _lines(head: bytes) -> list[str]:
    return head.decode("latin-1").lstrip("\xef\xbb\xbf").replace("\r", "").split("\n")


def _line(pattern: str, among: int = 40) -> Callable[[bytes], bool]:
    return lambda head: any(re.search(pattern, x, re.I) for x in _lines(head)[:among])


def _segy(head: bytes) -> bool:
    return len(head) >= 3600 and any(struct.unpack_from(o + "h", head, 3224)[0] in binary.SEGY_TYPES and struct.unpack_from(o + "H", head, 3220)[0] > 0 for o in "><")


def _res2dinv(head: bytes) -> bool:
    x = _lines(head)[1:3]
    try:
        return len(x) == 2 and float(x[0]) > 0 and int(x[1]) in text.RES2DINV_KINDS
    except ValueError:
        return False


register("seg2", (".dat", ".sg2", ".seg2"), lambda h: h[:2] in (b"\x55\x3a", b"\x3a\x55"), binary.read_seg2)
register("atm", (".atm",), lambda h: h[:4] == b"Atom", binary.read_atm)
register("segy", (".sgy", ".segy", ".su"), _segy, segy.read_segy)
register("cg5", (".txt", ".asc"), _line(r"^/.*CG-?5|^/.*stat.*grav"), text.read_cg5)
register("magnetics_summary", (".csv", ".xlsx"), _line(r"(?=.*line)(?=.*station)(?=.*(mean|level).*nt)", 3), text.read_magnetics_summary)
register("gem2", (".csv",), _line(r"[IQ]_\d+Hz", 3), text.read_gem2)
register("positions", (".csv",), _line(r"(?=.*\b(name|station|point|id)\b)(?=.*\b(lon|long|longitude|east|easting)\b)", 1), text.read_positions)
register("stg", (".stg",), _line(r"^Advanced Geosciences|SuperSting|^Unit:\s*(meter|feet|foot)", 3), text.read_stg)
register("res2dinv", (".dat",), _res2dinv, text.read_res2dinv)
register("nmea", (".csv", ".log", ".nmea", ".txt"), _line(r"\$[A-Z]{2}(RMC|GGA|DPT),"), text.read_nmea)
register("g857", (".asc", ".txt", ".dat"), _line(r"\b\d{1,2}:\d{2}:\d{2}[\s,]+\d{5}(\.\d+)?\b"), text.read_g857)


def discover(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modified) of all files below a folder or of a pattern; what archives and systems leave is left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.where(~F.col("path").rlike(binary.JUNK)).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.where(F.lower("path").rlike("(" + "|".join(re.escape(e.lower()) for e in extensions) + ")$")) if extensions else found


def unzipped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of the files in zip archives, as ``archive!member``; an archive is one task's work."""

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for m in z.infolist():
                        if not m.is_dir() and not re.search(binary.JUNK, m.filename):
                            yield pd.DataFrame({"path": [f"{name}!{m.filename}"], "content": [z.read(m)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, content binary")


def _head(path: str) -> bytes:
    """The first bytes of a file, read where it lies."""
    fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with fs.open_input_stream(at) as f:
        return f.read(_HEAD)


def identify(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """(path, readers): every reader that claims a file, those of its extension first; none is an empty list.

    Of files only the first 4 KB are read, by tasks that open them (of a file system that only Spark reads, and of a
    table of (path, content), the whole). A sniff that fails on a file it wasn't made for doesn't claim it.
    """
    known = dict(READERS)

    def one(n: str, h: bytes) -> list[str]:
        out = []
        for reader, (extensions, sniff, _) in sorted(known.items(), key=lambda x: not n.lower().endswith(x[1][0])):
            try:
                if sniff(bytes(h)):
                    out.append(reader)
            except Exception:  # noqa: BLE001, S112: a user's sniff may fail on any file
                continue
        return out

    @F.pandas_udf("array<string>")
    def claims(name: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([one(n, h) for n, h in zip(name, head, strict=True)])

    @F.pandas_udf("array<string>")
    def opened(name: pd.Series) -> pd.Series:
        return pd.Series([one(n, _head(n)) for n in name])

    real = ~F.col("path").rlike(binary.JUNK)
    if not isinstance(path, DataFrame):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        if all(re.match(r"^(/|file:|hdfs:|s3:|gs:)", p) for p in ([path] if isinstance(path, str) else path)):
            return found.select("path").where(real).select("path", opened("path").alias("readers"))
        path = found.select("path", "content")
    return path.where(real).select("path", claims("path", F.expr(f"substring(content, 1, {_HEAD})")).alias("readers"))


def read(spark: SparkSession, path: str | list[str], reader: str | None = None, **options) -> DataFrame:
    """Read files of one format by the named reader, or by the first that claims them; other options go to it."""
    if reader is None:
        best = identify(spark, path).select(F.get("readers", F.lit(0)).alias("r")).distinct().limit(3).collect()
        if len(best) != 1 or best[0]["r"] is None:
            raise ValueError(f"files of {len(best)} formats or of none that is known: {sorted(str(b['r']) for b in best)}; readers: {', '.join(sorted(READERS))}")
        reader = best[0]["r"]
    if reader not in READERS:
        raise ValueError(f"no reader named {reader}; readers: {', '.join(sorted(READERS))}")
    return READERS[reader][2](spark, path, **options)
