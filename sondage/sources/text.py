"""Text formats. A file is read whole and exploded to lines, so every row carries its file and line number in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import nmea_degrees, snake_label
from ..operators.survey import instant

FEET = 0.3048
#: Share of a spacing that an electrode may lie off the grid.
SNAP = 0.02
#: Columns of a CG-5 dump without a header line.
CG5_COLUMNS = ["line", "station", "alt", "grav", "sd", "tiltx", "tilty", "temp", "tide", "dur", "rej", "time", "dectimedate", "terrain", "date"]


#: Array types of RES2DINV (the last is the general one), and where a, b, m, n of the others stand, in dipole lengths.
RES2DINV_KINDS = (1, 2, 3, 4, 5, 6, 7, 11)
_at = lambda *x: [None if v is None else v if isinstance(v, Column) else F.lit(float(v)) for v in x]
RES2DINV_LAYOUT = {
    1: lambda n: _at(0, 3, 1, 2),
    2: lambda n: _at(0, None, 1, None),
    3: lambda n: _at(1, 0, n + 1, n + 2),
    4: lambda n: _at(1, 0, 2, 3),
    5: lambda n: _at(0, 2, 1, 3),
    6: lambda n: _at(0, None, n, n + 1),
    7: lambda n: _at(0, 2 * n + 1, n, n + 1),
}


def lines(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """(file, line_no from 1, line) of text files, or of a table of them (file, text); carriage returns and byte order marks are dropped."""
    return _whole(spark, path).select("file", F.posexplode("lines").alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def _whole(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """(file, lines): a row per file."""
    read = path.select("file", F.col("text").alias("value")) if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return read.select("file", F.split(F.regexp_replace("value", "\r|\ufeff", ""), "\n").alias("lines"))


def _by_header(rows: DataFrame, heads: DataFrame, names: list[str], text: set[str]) -> DataFrame:
    """Columns ``names`` of the ``f`` of each row, found by the labels of the file's ``header``; without one in order."""
    labelled = rows.join(heads, "file", "left")
    at = lambda i, n: F.when(F.col("header").isNull(), F.get("f", F.lit(i))).otherwise(F.get("f", F.array_position("header", F.lit(n)).cast("int") - 1))
    cell = lambda i, n: at(i, n) if n in text else number(at(i, n))
    return labelled.select("file", "row_seq", *[cell(i, n).alias(n) for i, n in enumerate(names)])


def fields(line: Column, pattern: str = r"\s+") -> Column:
    return F.split(F.trim(line), pattern)


def number(c: Column) -> Column:
    """A number, or null; NaN counts as missing."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


#: Labels of magnetometer files, and the layouts of files without a header.
G857_LABELS = {
    "line": ("line", "l", "lineid", "line_id"),
    "station": ("station", "stn", "sta", "station_id", "stationid", "point"),
    "time": ("time", "timestamp", "clock"),
    "date": ("date",),
    "field": ("field", "total_field", "totalfield", "value_nt", "value", "nt", "mag", "magnetic_field", "reading", "tf"),
    "quality": ("quality", "signal", "signal_strength", "sq", "qual"),
}
G857_LAYOUTS = {"manual": ["station", "time", "field"], "exported": ["line", "station", "time", "field", "quality"]}


def _aliased(labels: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """Labels by the name that they stand for; unknown ones stay."""
    known = F.create_map(*[F.lit(x) for name, said in names.items() for label in said for x in (label, name)])
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), x))


def read_g857(spark: SparkSession, path: str | DataFrame, min_quality: float | None = None, columns: list[str] | str | None = None, dropped: Observation | None = None) -> DataFrame:
    """Magnetometer readings: file, row_seq, line, station, time, date, field, quality.

    Columns are those of ``columns`` (names or a layout, "manual" or "exported"), else those that the file's header
    labels (a comment line may be one) if there are as many as in its rows, else three or five as usual; any other file
    fails the job. A file may differ from the next. Lines that aren't readings and readings without a field are left out.
    Readings below ``min_quality`` go; without a quality they stay. ``dropped`` observes n_kept and n_dropped in the pass.
    """
    if isinstance(columns, str) and columns not in G857_LAYOUTS:
        raise ValueError(f"no layout {columns!r}; layouts: {', '.join(sorted(G857_LAYOUTS))}")
    bare = F.regexp_replace("line", r"^[\s#/;*]+", "")
    all_ = lines(spark, path).where("trim(line) <> ''").select("file", F.col("line_no").alias("row_seq"), F.col("line").rlike(r"^\s*[#/;*]").alias("comment"), fields(bare, r"[\s,]+").alias("f"))
    reading = F.exists(F.slice("f", 1, 3), lambda x: x.try_cast("double").isNotNull() | x.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")) & (F.size("f") >= 2)
    rows = all_.where(~F.col("comment") & reading).select("file", "row_seq", "f")
    plain = lambda x: F.regexp_replace(F.substring_index(F.regexp_replace(F.lower(x), r"\(.*?\)", ""), "/", 1), r"[^a-z0-9_]", "")
    labels = all_.where(~reading).select("file", "row_seq", _aliased(F.transform("f", plain), G857_LABELS).alias("labels"))
    heads = labels.where(F.array_contains("labels", "field") & (F.array_contains("labels", "station") | F.array_contains("labels", "time"))).groupBy("file").agg(F.min_by("labels", "row_seq").alias("labels"))
    width = F.col("width")
    names = lambda n: F.array(*[F.lit(c) for c in n])
    if columns is not None:
        header = names(G857_LAYOUTS[columns] if isinstance(columns, str) else columns)
    else:
        unknown = F.raise_error(F.concat("file", F.lit(": no header for "), width.cast("string"), F.lit(" columns, pass columns"))).cast("array<string>")
        header = F.when(F.size("labels") == width, F.col("labels")).when(width == 3, names(G857_LAYOUTS["manual"])).when(width == 5, names(G857_LAYOUTS["exported"])).otherwise(unknown)
    heads = rows.groupBy("file").agg(F.max(F.size("f")).alias("width")).join(heads, "file", "left").select("file", header.alias("header"))
    out = _by_header(rows, heads, list(G857_LABELS), {"line", "station", "time", "date"}).where("field IS NOT NULL")
    fine = F.lit(True) if min_quality is None else F.col("quality").isNull() | (F.col("quality") >= min_quality)
    if dropped is not None:
        out = out.observe(dropped, F.count(F.when(fine, 1)).alias("n_kept"), F.count(F.when(~fine, 1)).alias("n_dropped"))
    return out.where(fine)


def _cg5_header(line: Column) -> Column:
    """Labels of a dump's header line; "Tilt x" and "Dec. Time+Date" are one label each."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(line, r"^/+\s*", "")), r"tilt\s+([xy])", "tilt$1")
    bare = F.regexp_replace(bare, r"dec\.?\s*time\s*\+\s*date", "dectimedate")
    return F.transform(F.split(F.trim(bare), r"[\s,]+"), lambda x: F.regexp_replace(x, r"[^a-z]", ""))


def read_cg5(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Gravimeter readings: file, row_seq, station, time (of date and clock), grav and the other columns as numbers.

    Columns are those that the file's last header line names, or without one the usual ones in order. Rows without a
    gravity value are left out.
    """
    all_ = lines(spark, path)
    heads = all_.where(F.col("line").rlike(r"(?i)^/.*stat.*grav")).groupBy("file").agg(_cg5_header(F.max_by("line", "line_no")).alias("header"))
    rows = all_.where(~F.col("line").rlike(r"^\s*(/|$)")).select("file", F.col("line_no").alias("row_seq"), fields(F.col("line"), r"[\s,]+").alias("f"))
    out = _by_header(rows, heads, CG5_COLUMNS, {"time", "date"})
    return out.withColumn("station", F.regexp_replace(F.col("station").cast("string"), r"\.0$", "")).withColumn("time", F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace("date", "/", "-"), "time"))).where("grav IS NOT NULL").drop("date")


def cg5_options(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of a dump's header: what the instrument has corrected already."""
    head = lines(spark, path).where(F.col("line").rlike(r"^/.*:")).select("file", F.regexp_replace("line", r"^/+\s*", "").alias("b"))
    return head.select("file", snake_label(F.regexp_replace(F.substring_index("b", ":", 1), r"\.", "")).alias("key"), F.trim(F.expr("substring(b, instr(b, ':') + 1)")).alias("value"))


def read_magnetics_summary(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Station table of a levelled survey: line, station, dist_from_s_ft, n_readings, mean_nt, stddev_nt, correction_nt, leveled_mean_nt.

    Columns are those of the header or, without one, these in order; station_id is line-station, distance in metres.
    """
    names = ["line", "station", "dist_from_s_ft", "n_readings", "mean_nt", "stddev_nt", "correction_nt", "leveled_mean_nt"]
    all_ = lines(spark, path)
    label = lambda x: F.regexp_replace(snake_label(x), "^line_no$", "line")
    heads = all_.where(F.col("line").rlike(r"(?i)station.*|.*line") & ~F.col("line").rlike(r"^\s*-?\d")).groupBy("file").agg(F.transform(F.split(F.min_by("line", "line_no"), sep), label).alias("header"))
    rows = all_.where(F.col("line").rlike(r"^\s*-?\d")).select("file", F.col("line_no").alias("row_seq"), F.split("line", sep).alias("f"))
    short = F.size("header") < 3  # not a list of columns
    out = _by_header(rows, heads.where(~short), names, set())
    whole = lambda c: F.col(c).cast("long").cast("string")
    seen = Window.partitionBy("file", "line", "station").orderBy("row_seq")
    return out.withColumn("station_id", F.concat_ws("-", whole("line"), whole("station"))).withColumn("distance", F.col("dist_from_s_ft") * FEET).withColumn("occupation", F.row_number().over(seen))


def _gem2_heads(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, head_line, header): the first of a file's top 20 lines that labels a channel; units are dropped."""
    channel = lambda c: F.regexp_extract(F.trim(c), r"^([IQ]_\d+)Hz", 1)
    top = lines(spark, path).where("line_no <= 20").withColumn("c", F.split("line", ","))
    label = lambda c: F.when(channel(c) != "", channel(c)).otherwise(snake_label(F.trim(c)))
    return top.where(F.exists("c", lambda c: channel(c) != "")).groupBy("file").agg(F.min("line_no").alias("head_line"), F.transform(F.min_by("c", "line_no"), label).alias("header"))


def gem2_header(spark: SparkSession, path: str | DataFrame) -> list[str]:
    """Columns of all files: channels as I_5310 and Q_5310, others in snake case, in order of their first place."""
    each = _gem2_heads(spark, path).select("file", F.posexplode("header").alias("p", "c"))
    return [r["c"] for r in each.groupBy("c").agg(F.min(F.struct("p", "file")).alias("at")).orderBy("at", "c").select("c").collect()]  # a row per label


def read_gem2(spark: SparkSession, path: str | DataFrame, header: list[str] | None = None) -> DataFrame:
    """EM track samples: file, row_seq and the columns ``header`` (those of all files), each file by its own labels.

    A column that a file doesn't have is null there. Files without a line of channel labels have no rows.
    """
    names = gem2_header(spark, path) if header is None else header
    met = lines(spark, path).where("trim(line) <> ''").join(_gem2_heads(spark, path), "file").where("line_no > head_line")
    at = lambda n: F.get("f", F.array_position("header", F.lit(n)).cast("int") - 1)
    rows = met.select("file", F.col("line_no").alias("row_seq"), "header", F.split("line", ",").alias("f"))
    return rows.select("file", "row_seq", *[number(at(n)).alias(n) for n in names])


#: Labels of GNSS exports.
POSITION_LABELS = {
    "name": ("name", "station", "point", "id", "point_id", "station_id", "pointname"),
    "longitude": ("longitude", "lon", "long"),
    "latitude": ("latitude", "lat"),
    "height": ("ellipsoidal_height", "height", "ellipsoid_height", "hae", "h_ell"),
    "easting": ("easting", "east"),
    "northing": ("northing", "north"),
    "elevation": ("elevation", "ortho_height", "orthometric_height", "msl"),
    "status": ("solution_status", "status", "quality", "fix_type", "solution"),
    "antenna_height": ("antenna_height", "ant_height"),
    "start": ("averaging_start", "start_time", "start"),
    "end": ("averaging_end", "end_time", "end"),
}
_MOST_FIELDS = 64


def read_positions(spark: SparkSession, path: str | DataFrame, heights_are: str, antenna_height: float | None = None, on_duplicate: str = "error") -> DataFrame:
    """GNSS occupations: file, row_seq, name, longitude, latitude, easting, northing, height (at the mark), elevation, status, start_s, end_s (UTC).

    Columns are found by each file's own labels, whatever their spelling and order; a file without names, or without
    longitude and latitude or easting and northing, fails the job. ``heights_are`` is "antenna" (the antenna height,
    given here or in the file, is taken off both heights; the job fails without one) or "ground". ``on_duplicate``:
    "error" raises, "first" keeps the first row of a name, "keep" keeps all. Quoted fields may hold commas, not line feeds.
    """
    if heights_are not in ("antenna", "ground"):
        raise ValueError("heights_are must be 'antenna' or 'ground'")
    if on_duplicate not in ("error", "first", "keep"):
        raise ValueError("on_duplicate must be 'error', 'first' or 'keep'")
    cells = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(_MOST_FIELDS))), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    parsed = lines(spark, path).where("trim(line) <> ''").select("file", F.col("line_no").alias("row_seq"), cells.alias("c"))
    parsed = parsed.select("file", "row_seq", F.array(*[F.col("c")[f"c{i}"] for i in range(_MOST_FIELDS)]).alias("f"))
    label = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"\([^)]*\)", ""), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    heads = parsed.groupBy("file").agg(F.min("row_seq").alias("head_line"), _aliased(F.transform(F.array_compact(F.min_by("f", "row_seq")), label), POSITION_LABELS).alias("header"))
    has = lambda *n: F.forall(F.array(*[F.lit(x) for x in n]), lambda x: F.array_contains("header", x))
    usable = has("name") & (has("longitude", "latitude") | has("easting", "northing"))
    tall = F.lit(True) if heights_are == "ground" or antenna_height is not None else has("antenna_height")
    fail = lambda said: F.raise_error(F.concat("file", F.lit(said))).cast("array<string>")
    heads = heads.withColumn("header", F.when(~usable, fail(": no names, or no longitude and latitude or easting and northing")).when(~tall, fail(": no antenna height, pass antenna_height")).otherwise(F.col("header")))
    rows = parsed.join(heads.select("file", F.col("head_line").alias("_h")), "file").where("row_seq > _h").drop("_h")
    out = _by_header(rows, heads.drop("head_line"), list(POSITION_LABELS), {"name", "status", "start", "end"})
    drop = F.lit(0.0) if heights_are == "ground" else F.coalesce(F.lit(antenna_height).cast("double"), F.col("antenna_height"))
    stamp = lambda c: F.unix_millis(instant(F.col(c))) / 1000
    out = out.select("file", "row_seq", F.trim("name").alias("name"), "longitude", "latitude", "easting", "northing", (F.col("height") - drop).alias("height"), (F.col("elevation") - drop).alias("elevation"), F.trim("status").alias("status"), stamp("start").alias("start_s"), stamp("end").alias("end_s"))
    if on_duplicate == "first":
        return out.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("file", "row_seq"))).where("_k = 1").drop("_k")
    if on_duplicate == "error":
        again = [r[0] for r in out.groupBy("name").count().where("count > 1").select("name").orderBy("name").limit(20).collect()]
        if again:
            raise ValueError(f"names occur more than once: {', '.join(map(str, again))}")
    return out


def read_stg(spark: SparkSession, path: str) -> DataFrame:
    """SuperSting records: record, time, resistance, error, current_ma, rhoa_file, positions ax .. nz in metres, channel.

    The job fails for a file with another number of records than its second line says, if it says one.
    """
    all_ = lines(spark, path)
    said = F.regexp_extract(F.max(F.when(F.col("line_no") == 2, F.col("line"))), r"(?i)records:\s*(\d+)", 1).try_cast("int")
    there = F.count(F.when((F.col("line_no") > 3) & (F.trim("line") != ""), 1))
    feet = F.lower(F.trim(F.substring_index(F.max(F.when(F.col("line_no") == 3, F.col("line"))), ":", -1))).startswith("f")
    unit = all_.groupBy("file").agg(said.alias("said"), there.alias("there"), F.when(feet, FEET).otherwise(1.0).alias("to_m"))
    wrong = F.raise_error(F.concat("file", F.lit(": "), F.col("there").cast("string"), F.lit(" records, its header says "), F.col("said").cast("string"))).cast("double")
    unit = unit.select("file", F.when(F.col("said") != F.col("there"), wrong).otherwise(F.col("to_m")).alias("to_m"))
    rows = all_.where("line_no > 3 AND trim(line) <> ''").select("file", F.col("line_no").alias("row_seq"), F.split("line", ",").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    xyz = [(number(at(9 + i)) * F.col("to_m")).alias(p + q) for i, (p, q) in enumerate((p, q) for p in "abmn" for q in "xyz")]
    return rows.join(unit, "file").select("file", "row_seq", F.trim(at(0)).try_cast("int").alias("record"), F.concat_ws(" ", F.trim(at(2)), F.trim(at(3))).alias("time"), number(at(4)).alias("resistance"), (number(at(5)) / 1000).alias("error"), number(at(6)).alias("current_ma"), number(at(7)).alias("rhoa_file"), *xyz, F.regexp_extract(F.array_join("f", ","), r"Ch=(\d+)", 1).try_cast("int").alias("channel"))


def stg_readings(records: DataFrame) -> DataFrame:
    """Quadrupoles of straight lines: file, record, a, b, m, n as electrode indices, spacing and resistance.

    The spacing is the least gap between distinct positions of a file. The job fails for an electrode beside the line
    (y other than 0), before its start, or farther off the grid than ``SNAP`` of a spacing.
    """
    xs = records.select("file", F.explode(F.array("ax", "bx", "mx", "nx")).alias("x")).select("file", F.round("x", 6).alias("x")).distinct()
    gap = xs.withColumn("g", F.col("x") - F.lag("x").over(Window.partitionBy("file").orderBy("x"))).groupBy("file").agg(F.round(F.min("g"), 6).alias("spacing"))
    fail = lambda said: F.raise_error(F.concat("file", F.lit(": record "), F.col("record").cast("string"), F.lit(said))).cast("int")

    def on(p: str) -> Column:
        grid = F.col(f"{p}x") / F.col("spacing")
        off = F.abs(grid - F.rint(grid)) > SNAP
        return F.when(F.col(f"{p}y") != 0, fail(" has an electrode beside the line")).when(off, fail(" has an electrode off the grid")).when(F.rint(grid) < 0, fail(" has an electrode before the start")).otherwise(F.rint(grid).cast("int")).alias(p)

    return records.join(gap, "file").select("file", "record", *[on(p) for p in "abmn"], "spacing", "resistance")


def read_res2dinv(spark: SparkSession, path: str) -> DataFrame:
    """Readings of a RES2DINV file of types 1 to 7 or 11 (general): a, b, m, n (null if remote), spacing, rhoa.

    Line 2 is the unit spacing, line 3 the type; the number of readings is in line 4, of a general file in line 7. Line 5
    says whether x is the first electrode (0) or the middle of a reading (1). Electrodes are counted from the first.
    """
    on_line = lambda i: number(F.get("lines", F.lit(i - 1)))
    # Each file's header goes with its lines: no join, for which Spark would take exploded lines for as few as the files.
    head = _whole(spark, path).select("file", "lines", on_line(2).alias("spacing"), on_line(3).cast("int").alias("kind"), F.coalesce(on_line(5), F.lit(0.0)).alias("middle"), F.when(on_line(3).cast("int") == 11, on_line(7)).otherwise(on_line(4)).alias("count"))
    rows = head.select("file", "spacing", "kind", "middle", "count", F.posexplode("lines").alias("p", "line")).where("p >= 5")
    rows = rows.select("file", "spacing", "kind", "middle", "count", (F.col("p") + 1).alias("row_seq"), F.transform(fields(F.col("line"), r"[\s,]+"), lambda x: number(x)).alias("f"))
    rows = rows.where("forall(f, v -> v IS NOT NULL)")
    at = lambda i: F.get("f", F.lit(i))
    # A general row names its 2, 3 or 4 electrodes; of three the second current electrode is remote, of two also the second potential one.
    used = at(0)
    general = rows.where("kind = 11 AND f[0] IN (2, 3, 4) AND size(f) >= 2 * f[0] + 2")
    x = {"ax": at(1), "bx": F.when(used == 4, at(3)), "mx": F.when(used == 4, at(5)).otherwise(at(3)), "nx": F.when(used == 4, at(7)).when(used == 3, at(5))}
    general = general.select("file", "row_seq", "spacing", "count", *[v.alias(k) for k, v in x.items()], F.when(used == 4, at(9)).when(used == 3, at(7)).otherwise(at(5)).alias("rhoa"))
    with_n = F.col("kind").isin(3, 6, 7)
    plain = rows.where(F.col("kind").isin(*RES2DINV_KINDS[:-1]) & (F.size("f") >= F.when(with_n, 4).otherwise(3)))
    plain = plain.withColumn("n", F.when(with_n, at(2)).otherwise(1.0)).withColumn("rhoa", F.when(with_n, at(3)).otherwise(at(2)))
    lay = {kind: RES2DINV_LAYOUT[kind](F.col("n")) for kind in RES2DINV_KINDS[:-1]}
    by_kind = lambda get: F.coalesce(*[F.when(F.col("kind") == k, get(v)) for k, v in lay.items()])
    span = by_kind(lambda v: F.greatest(*[c for c in v if c is not None]))
    zero = at(0) - F.when(F.col("middle") == 1, span * at(1) / 2).otherwise(0.0)
    place = [(zero + by_kind(lambda v, i=i: F.lit(None).cast("double") if v[i] is None else v[i]) * at(1)).alias(f"{p}x") for i, p in enumerate("abmn")]
    both = general.unionByName(plain.select("file", "row_seq", "spacing", "count", *place, "rhoa"))
    both = both.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("row_seq"))).where("_k <= count")
    first = F.min(F.least("ax", "bx", "mx", "nx")).over(Window.partitionBy("file"))
    return both.select("file", "row_seq", *[F.rint((F.col(f"{p}x") - first) / F.col("spacing")).cast("int").alias(p) for p in "abmn"], "spacing", "rhoa")


def res2dinv_lines(readings: DataFrame, title: str, spacing: float) -> DataFrame:
    """(pos, line) of a general RES2DINV file of readings (a, b, m, n, rhoa), to be written in order of ``pos`` as one file.

    Readings follow by a, b, m, n; remote electrodes leave their place out. Ranges of a are numbered side by side.
    """
    order = ["a", "b", "m", "n", "rhoa"]
    starts = readings.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))  # a row per electrode
    before = Window.partitionBy(F.lit(0)).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("a", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    top = [F.lit(x) for x in (title, f"{spacing:.5f}", "11", "0", "Type of measurement (0=app. resistivity,1=resistance)", "0")]
    head = starts.groupBy().agg(F.coalesce(F.max("_all"), F.lit(0)).cast("string").alias("n")).select(F.posexplode(F.array(*top, F.col("n"), F.lit("1"), F.lit("0"))).alias("pos", "line"))
    x = lambda c: F.format_string("%.5f 0.0", F.col(c) * F.lit(spacing))
    used = [F.when(F.col(c).isNotNull(), x(c)) for c in "abmn"]
    count = sum((F.col(c).isNotNull().cast("int") for c in "abmn"), F.lit(0)).cast("string")
    numbered = readings.join(starts, "a").withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy(*order[1:])) + F.col("_before"))
    body = numbered.select((F.col("_k") + 100).cast("long").alias("pos"), F.concat_ws(" ", count, *used, F.format_string("%.5f", F.col("rhoa"))).alias("line"))
    return head.select(F.col("pos").cast("long").alias("pos"), "line").unionAll(body)


def read_nmea(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of a log: file, row_seq, time (hhmmss), latitude, longitude, depth.

    RMC sentences with status A and GGA sentences are fixes; a depth (DPT) belongs to the fix before it, the first one
    counts. Of equal times in a file the first fix stays.
    """
    s = lines(spark, path).select("file", F.col("line_no").alias("row_seq"), F.split(F.regexp_extract("line", r"\$(.*)$", 1), ",").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    rmc, gga, dpt = at(0).endswith("RMC") & (at(2) == "A"), at(0).endswith("GGA") & (at(6) != "0"), at(0).endswith("DPT")
    fix = rmc | gga
    pick = lambda i, j: F.when(rmc, at(i)).otherwise(at(j))
    rows = s.where(fix | dpt).withColumn("is_fix", fix.cast("int"))
    order = Window.partitionBy("file").orderBy("row_seq")
    rows = rows.withColumn("g", F.sum("is_fix").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cols = rows.select("file", "row_seq", "g", "is_fix", at(1).alias("time"), nmea_degrees(pick(3, 2), pick(4, 3)).alias("latitude"), nmea_degrees(pick(5, 4), pick(6, 5)).alias("longitude"), F.when(dpt, number(at(1))).alias("depth"))
    one = cols.where("g > 0").groupBy("file", "g").agg(F.min("row_seq").alias("row_seq"), *[F.min_by(c, "row_seq").alias(c) for c in ("time", "latitude", "longitude")], F.min_by("depth", F.when(F.col("depth").isNotNull(), F.col("row_seq"))).alias("depth"))
    return one.withColumn("_k", F.row_number().over(Window.partitionBy("file", "time").orderBy("row_seq"))).where("_k = 1").drop("_k", "g")
