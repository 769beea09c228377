"""Repeat readings at stations: means, base drift, levels, collapsing of repeats, robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lineage
from ..plans.joins import interpolate
from ..plans.ordered import few, quantiles, with_halo, with_next
from ..plans.scratch import deleted, written


def station_means(readings: DataFrame, station: str, value: str) -> DataFrame:
    """Mean, sample deviation (null for one reading) and count of each station."""
    return readings.groupBy(station).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def drift_corrected(readings: DataFrame, base: DataFrame, x: str, value: str, width: float) -> DataFrame:
    """``readings`` with diurnal (base curve at ``x`` less its first value) and corrected.

    Readings with a lineage get a step "diurnal"; the job fails where they have had it.
    """
    readings = lineage.once(readings, "diurnal", at=x) if lineage.LINEAGE in readings.columns else readings
    zero = base.agg(F.min_by(value, x).alias("_zero"))
    curve = interpolate(readings, base, x, x, value, "_curve", width)
    out = curve.crossJoin(F.broadcast(zero))  # one row
    return out.withColumn("diurnal", F.col("_curve") - F.col("_zero")).withColumn("corrected", F.col(value) - F.col("diurnal")).drop("_curve", "_zero")


def midnight_rollover(readings: DataFrame, by: str, seq: str, seconds: str) -> DataFrame:
    """Day number within ``by``: one more each time the clock runs back."""
    order = Window.partitionBy(by).orderBy(seq)
    back = F.when(F.col(seconds) < F.lag(seconds).over(order), 1).otherwise(0)
    return readings.withColumn("_back", back).withColumn("day", F.sum("_back").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_back")


def collapse_repeats(readings: DataFrame, station: str, seq: str, first: list[str], mean: list[str], largest: list[str]) -> DataFrame:
    """A row per station: the first of some columns, means and maxima of others, and the number of occupations."""
    aggs = [F.min_by(c, seq).alias(c) for c in first] + [F.avg(c).alias(c) for c in mean] + [F.max(c).alias(c) for c in largest]
    return readings.groupBy(station).agg(*aggs, F.count(F.lit(1)).alias("occupations"))


def _with_one(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Every row beside the one row of ``one``, or beside nulls where that is empty."""
    return rows.join(F.broadcast(one), F.lit(True), "left")


def remove_regional(readings: DataFrame, value: str, out: str = "anomaly") -> DataFrame:
    """Value less the median of all."""
    return _with_one(readings, quantiles(readings, [], value, {"_m": 0.5})).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def flag_noisy(stations: DataFrame, sigma: str, limit: float) -> DataFrame:
    return stations.withColumn("noisy", F.coalesce(F.col(sigma) > limit, F.lit(False)))


def median_and_mad(readings: DataFrame, by: str, value: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation of each group."""
    mid = few(quantiles(readings, [by], value, {"median": 0.5}))
    off = readings.select(by, F.col(value).alias("_v")).join(mid, by)
    scatter = quantiles(off, [by], F.abs(F.col("_v") - F.col("median")), {"_s": 0.5})
    return mid.join(few(scatter), by).select(by, "median", (1.4826 * F.col("_s")).alias("scatter"))


def noise(readings: DataFrame, line: str, channel: str, seq: str, value: str, expected: float | None = None) -> DataFrame:
    """Per channel: median, P95 - P5 and 1.4826 MAD(differences along lines) / sqrt(2); of ``expected`` also its ratio to the noise, snr."""
    diff = readings.select(F.col(channel).alias("_c"), F.col(value).alias("_v"), (F.col(value) - F.lag(value).over(Window.partitionBy(channel, line).orderBy(seq))).alias("_d"))
    diff = written(diff, "steps")
    mid = quantiles(diff, ["_c"], "_v", {"median": 0.5, "_hi": 0.95, "_lo": 0.05})
    step = few(quantiles(diff, ["_c"], "_d", {"_m": 0.5}))
    mad = quantiles(diff.join(step, "_c"), ["_c"], F.abs(F.col("_d") - F.col("_m")), {"_mad": 0.5})
    held = few(mid), few(mad)
    if held[0] is not mid and held[1] is not mad:
        deleted(diff)
    out = held[0].join(held[1], "_c", "left").select(F.col("_c").alias(channel), "median", (F.col("_hi") - F.col("_lo")).alias("spread"), (1.4826 * F.col("_mad") / F.sqrt(F.lit(2.0))).alias("noise"))
    return out if expected is None else out.withColumn("expected", F.lit(float(expected))).withColumn("snr", F.abs("expected") / F.col("noise"))


def despike(readings: DataFrame, line: str, seq: str, value: str, half: int = 4, threshold: float = 6.0, width: float = 20_000.0) -> DataFrame:
    """Flag and remove values further than ``threshold`` sigma from a centred running median of 2 half + 1 values of their line.

    Sigma is 1.4826 MAD of the differences of the whole column in order of line and ``seq``, line joins included, over
    sqrt(2); where it is 0 or unknown nothing is flagged. Differences and running medians are taken within ranges of
    ``width`` of ``seq`` and a halo of ``half`` rows; a row per line gives the differences across line joins. Adds running, spike and despiked (null at spikes).
    """
    frame = f"(PARTITION BY {line}, _range ORDER BY {seq} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    near = with_halo(readings, [line], seq, half, width).withColumn("_near", F.expr(f"collect_list(double({value})) OVER {frame}")).where("_own")
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    smooth = near.withColumn("running", F.transform(F.array(F.array_sort("_near")), middle)[0]).drop("_range", "_own", "_near")
    rows = readings.select(F.col(line).alias("_line"), F.col(seq).alias("_seq"), F.col(value).alias("_v"))
    inside = with_next(rows, ["_line"], "_seq", ["_v"], width).select((F.col("next__v") - F.col("_v")).alias("d"))
    ends = rows.groupBy("_line").agg(F.min_by("_v", "_seq").alias("_first"), F.max_by("_v", "_seq").alias("_last"))
    joins = ends.select((F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy("_line")) - F.col("_last")).alias("d"))  # a row per line
    d = written(inside.unionAll(joins).where("d IS NOT NULL"), "steps")
    mid = few(quantiles(d, [], "d", {"m": 0.5}))
    sigma = few(quantiles(d.crossJoin(mid), [], F.abs(F.col("d") - F.col("m")), {"_mad": 0.5}).select((1.4826 * F.col("_mad") / F.sqrt(F.lit(2.0))).alias("_sigma")))  # one row
    deleted(d)
    out = _with_one(smooth, sigma)
    spike = F.coalesce((F.col("_sigma") > 0) & (F.abs(F.col(value) - F.col("running")) > threshold * F.col("_sigma")), F.lit(False))
    return out.withColumn("spike", spike).withColumn("despiked", F.when(~F.col("spike"), F.col(value))).drop("_sigma")


def together(readings: DataFrame, flags: list[str], values: list[str]) -> DataFrame:
    """A reading that is a spike (any of ``flags``) on one channel is removed from all of them."""
    bad = F.coalesce(F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0]), F.lit(False))
    return readings.withColumns({v: F.when(~bad, F.col(v)) for v in values})


def level_lines(readings: DataFrame, line: str, value: str) -> DataFrame:
    """Value less the difference of its line's median from the survey's; a lineage gets the step, once."""
    readings = lineage.once(readings, "levelled", by=line) if lineage.LINEAGE in readings.columns else readings
    lines = few(quantiles(readings, [line], value, {"_l": 0.5}))
    total = quantiles(readings, [], value, {"_s": 0.5})
    return _with_one(readings.join(lines, line, "left"), total).withColumn("levelled", F.col(value) - (F.col("_l") - F.col("_s"))).drop("_l", "_s")


def heading_medians(readings: DataFrame, channel: str, forward: Column, value: str, noise_of: DataFrame | None = None) -> DataFrame:
    """Medians of both headings of each channel and their difference; with ``noise_of`` (channel, noise) also noise and the ratio."""
    f = quantiles(readings, [channel], F.when(forward, F.col(value)), {"forward": 0.5})
    r = quantiles(readings, [channel], F.when(~forward, F.col(value)), {"reverse": 0.5})
    out = readings.select(channel).distinct().join(f, channel, "left").join(r, channel, "left").withColumn("difference", F.col("forward") - F.col("reverse"))
    return out if noise_of is None else out.join(noise_of.select(channel, "noise"), channel, "left").withColumn("ratio", F.abs("difference") / F.col("noise"))


def track_summary(readings: DataFrame, line: str, seq: str, x: str, y: str, seconds: str) -> DataFrame:
    """Per line: samples, duration, path length, mean speed and median step."""
    o = Window.partitionBy(line).orderBy(seq)
    dx, dy = F.col(x) - F.lag(x).over(o), F.col(y) - F.lag(y).over(o)
    steps = readings.withColumn("step", F.sqrt(dx * dx + dy * dy))
    out = steps.groupBy(line).agg(F.count(F.lit(1)).alias("samples"), (F.max(seconds) - F.min(seconds)).alias("duration"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))
    out = out.join(few(quantiles(steps, [line], "step", {"median_step": 0.5})), line, "left")
    return out.withColumn("speed", F.when(F.col("duration") > 0, F.col("length") / F.col("duration")))


def path_distance(readings: DataFrame, line: str, seq: str, x: str, y: str) -> DataFrame:
    """Distance along the path of a line from its first sample."""
    o = Window.partitionBy(line).orderBy(seq)
    dx, dy = F.col(x) - F.lag(x).over(o), F.col(y) - F.lag(y).over(o)
    step = readings.withColumn("_s", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return step.withColumn("distance", F.sum("_s").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def line_distance(readings: DataFrame, line: str, seq: str, x: str, y: str) -> DataFrame:
    """Distance along and right of the straight line through each line's samples (principal axis, from first to last)."""
    fit = readings.groupBy(line).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("vxy"), F.min_by(x, seq).alias("x0"), F.min_by(y, seq).alias("y0"), F.max_by(x, seq).alias("x1"), F.max_by(y, seq).alias("y1"))
    angle = F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2
    fit = fit.withColumn("ux", F.cos(angle)).withColumn("uy", F.sin(angle))
    sign = F.when((F.col("x1") - F.col("x0")) * F.col("ux") + (F.col("y1") - F.col("y0")) * F.col("uy") < 0, -1.0).otherwise(1.0)
    fit = fit.withColumns({"ux": F.col("ux") * sign, "uy": F.col("uy") * sign})
    out = readings.join(fit, line)
    along = (F.col(x) - F.col("x0")) * F.col("ux") + (F.col(y) - F.col("y0")) * F.col("uy")
    right = (F.col(x) - F.col("mx")) * F.col("uy") - (F.col(y) - F.col("my")) * F.col("ux")
    return out.withColumn("along", along).withColumn("offset", right).select(*readings.columns, "along", "offset")


def layback(readings: DataFrame, x: str, y: str, heading: str, forward: float, right: float) -> DataFrame:
    """Positions moved from the antenna to the sensor: an offset (forward, right) turned by the heading in degrees."""
    h = F.radians(F.col(heading))
    return readings.withColumn("sensor_x", F.col(x) - (forward * F.sin(h) + right * F.cos(h))).withColumn("sensor_y", F.col(y) - (forward * F.cos(h) - right * F.sin(h)))


def free_air_offsets(readings: DataFrame, mask: Column, channels: list[str]) -> DataFrame:
    """(channel, offset): median of each channel over the samples of ``mask``, those with the sensor lifted off the ground."""
    long = readings.where(mask).select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("_v")) for c in channels])))
    return quantiles(long, ["channel"], "_v", {"offset": 0.5})


def subtract_offsets(readings: DataFrame, offsets: DataFrame, channels: list[str]) -> DataFrame:
    """Each channel less its offset; the job fails where a channel has none, or a row with a lineage has had its offsets taken off."""
    readings = lineage.once(readings, "free-air offsets", channels=",".join(channels)) if lineage.LINEAGE in readings.columns else readings
    one = offsets.agg(*[F.max(F.when(F.col("channel") == c, F.col("offset"))).alias(f"_{c}") for c in channels])  # one row
    less = lambda c: F.col(c) - F.when(F.col(f"_{c}").isNull(), F.raise_error(F.lit(f"no offset of channel {c}")).cast("double")).otherwise(F.col(f"_{c}"))
    return readings.crossJoin(F.broadcast(one)).withColumns({c: less(c) for c in channels}).drop(*[f"_{c}" for c in channels])


def heights_from_altitude(readings: DataFrame, z: str, ground: Column, above: float = 0.0) -> DataFrame:
    """``readings`` with the sensor's height: altitude less the ground's and the antenna's above the sensor; null below the ground."""
    h = F.col(z) - ground - above
    return readings.withColumn("height", F.when(h >= 0, h))
