"""Towed resistivity lines: readings of a streamer placed by the boat's track, repeats averaged on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import geometric_factor
from ..plans.joins import interpolate
from ..plans.ordered import few, quantiles


def towed_line(readings: DataFrame, track: DataFrame, spacing: float, utc_offset_hours: float = 0.0, lead: float = 0.0, width: float = 60.0) -> DataFrame:
    """(file, a, b, m, n, rhoa, repeats, scatter, time, water_depth, current_ma, record): readings on one electrode grid.

    ``readings``: file, record, t (seconds of the instrument's day), ax, bx, mx, nx (metres along the streamer), r (V/I)
    and current_ma. ``track``: file, t (seconds UTC), s (distance along the track) and water_depth, distinct in t. A
    reading before the track by more than half a day is of the next day; the job fails for readings outside the track,
    as the offset from UTC is wrong then, and for streamers off the grid.

    The streamer lies ``lead`` metres behind the antenna and is shifted, not stretched, to the grid. Of pairs with the
    current ahead both pairs are swapped (reciprocity). Positive repeats on the same electrodes are averaged: geometric
    mean of r, scatter the deviation of its logarithm. Electrodes count from the first of the file.
    """
    span = few(track.groupBy("file").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1")))
    rows = readings.join(span, "file").withColumn("t", F.col("t") + 3600.0 * utc_offset_hours)
    rows = rows.withColumn("t", F.when(F.col("t") < F.col("_t0") - 43200, F.col("t") + 86400).otherwise(F.col("t")))
    outside = F.raise_error(F.concat(F.lit("outside the track, check utc_offset_hours: record "), F.col("record").cast("string"), F.lit(" of "), F.col("file"))).cast("double")
    rows = rows.withColumn("t", F.when((F.col("t") < F.col("_t0")) | (F.col("t") > F.col("_t1")), outside).otherwise(F.col("t"))).drop("_t0", "_t1")
    rows = interpolate(rows, track, "t", "t", "s", "_s", width, by=["file"])
    rows = interpolate(rows, track.where("water_depth IS NOT NULL"), "t", "t", "water_depth", "water_depth", width, by=["file"])
    step = lambda c: F.col(c) / F.lit(float(spacing))
    off = F.raise_error(F.concat(F.lit("the streamer is off the grid in "), F.col("file"))).cast("double")
    anchor = F.rint((F.col("_s") - lead) / spacing)
    rows = rows.withColumns({f"_{p}": anchor + F.when(F.abs(step(f"{p}x") - F.rint(step(f"{p}x"))) > 0.05, off).otherwise(F.rint(step(f"{p}x"))) for p in "abmn"})
    first = few(rows.groupBy("file").agg(F.min(F.least(*[f"_{p}" for p in "abmn"])).alias("_first")))
    rows = rows.join(first, "file").withColumns({f"_{p}": (F.col(f"_{p}") - F.col("_first")).cast("long") for p in "abmn"})
    ahead = F.col("_a") + F.col("_b") > F.col("_m") + F.col("_n")
    for p, q in zip("abmn", "mnab", strict=True):
        rows = rows.withColumn(p, F.when(ahead, F.col(f"_{q}")).otherwise(F.col(f"_{p}")))
    key = ["file", "a", "b", "m", "n"]
    up = rows.where("r > 0")
    out = up.groupBy(*key).agg(F.exp(F.avg(F.ln("r"))).alias("_r"), F.count(F.lit(1)).alias("repeats"), F.stddev_samp(F.ln("r")).alias("scatter"), F.avg("t").alias("time"), F.avg("water_depth").alias("water_depth"), F.min("record").alias("record"))
    out = out.join(quantiles(up, key, "current_ma", {"current_ma": 0.5}), key, "left")
    gap = lambda p, q: F.abs(F.col(p) - F.col(q)) * F.lit(float(spacing))
    return out.withColumn("rhoa", geometric_factor(gap("a", "m"), gap("b", "m"), gap("a", "n"), gap("b", "n")) * F.col("_r")).drop("_r")
