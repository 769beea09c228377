"""Points of a survey: gathers, lines, bounds, repeated and averaged positions, base station shifts, instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalar import haversine
from ..plans.joins import distance


def gather(traces: DataFrame, source: str, which, required: bool = False) -> DataFrame:
    """Traces of one source; with ``required`` the job fails when there are none."""
    found = traces.where(F.col(source) == F.lit(which))
    if not required:
        return found
    n = traces.agg(F.count(F.when(F.col(source) == F.lit(which), 1)).alias("_n"))  # one row
    check = n.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no traces of source {which!r}"))).otherwise(F.col("_n")).alias("_n"))
    return F.broadcast(check.where("_n > 0")).join(found, F.lit(True)).drop("_n")


def points_on_lines(lines: DataFrame, line: str, x0: str, y0: str, azimuth: str, spacing: float, count: int) -> DataFrame:
    """(line, station, x, y): ``count`` points from each line's start on, ``azimuth`` in degrees clockwise from north."""
    each = lines.select(F.col(line).alias("line"), F.col(x0).alias("_x"), F.col(y0).alias("_y"), F.radians(F.col(azimuth)).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")).alias("station"))
    return each.select("line", "station", (F.col("_x") + F.col("station") * spacing * F.sin("_a")).alias("x"), (F.col("_y") + F.col("station") * spacing * F.cos("_a")).alias("y"))


def merged(*points: DataFrame) -> DataFrame:
    """Points of several geometries (the same columns), one after the other."""
    out = points[0]
    for p in points[1:]:
        out = out.unionByName(p)
    return out


def bounds(points: DataFrame, by: list[str]) -> DataFrame:
    """Number and extent of the points of each group."""
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def with_status(points: DataFrame, status: str, allowed: list[str]) -> DataFrame:
    """Points whose status is one of ``allowed``, whatever its case."""
    return points.where(F.upper(F.col(status)).isin([x.upper() for x in allowed]))


def revisits(points: DataFrame, name: str, seq: str, x: str, y: str) -> DataFrame:
    """(name, seq, distance): every occupation of a name but its first, and how far from the first it is."""
    first = points.groupBy(name).agg(F.min_by(F.struct(seq, x, y), seq).alias("_f"))
    d = distance(F.col(x), F.col(y), F.col("_f")[x], F.col("_f")[y])
    return points.join(first, name).where(F.col(seq) > F.col("_f")[seq]).select(name, seq, d.alias("distance"))


def mean_positions(points: DataFrame, name: str, x: str, y: str, value: str) -> DataFrame:
    """Mean position of each name, deviation of ``value`` and number of occupations."""
    return points.groupBy(name).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))


def unmatched(rows: DataFrame, key: str, points: DataFrame, point_key: str, required: bool = False) -> DataFrame:
    """Distinct keys of ``rows`` without a point; with ``required`` the job fails at the first of them and names it."""
    lost = rows.select(key).distinct().join(points.select(F.col(point_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")
    return lost.select(F.raise_error(F.concat(F.lit("no position for "), F.col(key).cast("string"))).cast("string").alias(key)) if required else lost


def base_shifted(points: DataFrame, corrected: tuple[float, float, float], most_metres: float = 50.0) -> DataFrame:
    """longitude, latitude and height moved by the corrected base coordinate less the one the rovers used.

    That is in base_longitude, base_latitude and base_height. The job fails if these aren't the same in all rows, as
    sessions are mixed then, or if the base moves further than ``most_metres``. Null base columns count as a coordinate.
    """
    base = F.struct("base_longitude", "base_latitude", "base_height")
    one = points.agg(F.count_distinct(base).alias("_n"), F.min(base).alias("_b"))  # one row
    far = haversine(F.col("_b.base_latitude"), F.col("_b.base_longitude"), F.lit(corrected[1]), F.lit(corrected[0]))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("different base coordinates: "), F.col("_n").cast("string")))).when(far > most_metres, F.raise_error(F.concat(F.lit("the base moves by metres: "), far.cast("string")))).otherwise(F.col("_b"))
    one = one.select(checked.alias("_b"))
    moved = {c: F.col(c) + (F.lit(float(v)) - F.col("_b")[f"base_{c}"]) for c, v in zip(("longitude", "latitude", "height"), corrected, strict=True)}
    return points.crossJoin(F.broadcast(one)).withColumns(moved).drop("_b")


def rectangle_share(x0: Column, x1: Column, z0: Column, z1: Column, box: tuple[float, float, float, float]) -> Column:
    """Share of a cell's area inside ``box`` (x from, x to, z from, z to)."""
    side = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(b, F.lit(float(hi))) - F.greatest(a, F.lit(float(lo))))
    return side(x0, x1, *box[:2]) * side(z0, z1, *box[2:]) / ((x1 - x0) * (z1 - z0))


def instant(text: Column) -> Column:
    """A local time with its offset ("2026-01-01 10:00:00 UTC-05:00") as an instant; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"\s*UTC(?=[+-])", ""))


def masked(rows: DataFrame, keep: Column, counts: Observation | None = None) -> DataFrame:
    """Rows that ``keep`` (null drops them); ``counts`` observes n_kept and n_dropped in the same pass."""
    flag = F.coalesce(keep, F.lit(False))
    if counts is not None:
        rows = rows.observe(counts, F.count(F.when(flag, 1)).alias("n_kept"), F.count(F.when(~flag, 1)).alias("n_dropped"))
    return rows.where(flag)


def all_null_columns(rows: DataFrame) -> list[str]:
    """Columns without any value, found by one aggregate."""
    one = rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns]).first()
    return [c for c in rows.columns if one[c] == 0]
