"""Continuous records: sessions by gaps, coverage, common windows, tumbling and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordered import few, quantiles


def gap_sessions(files: DataFrame, by: str, start: str, max_gap: float) -> DataFrame:
    """Session number within ``by``: a new one where a start is more than ``max_gap`` after the start before."""
    o = Window.partitionBy(by).orderBy(start)
    new = F.when(F.col(start) - F.lag(start).over(o) > max_gap, 1).otherwise(0)
    return files.withColumn("_new", new).withColumn("session", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def deployments(files: DataFrame, by: str, start: str, node: str, max_gap: float) -> DataFrame:
    """Per session: number of files, nodes in order, first and last start."""
    s = gap_sessions(files, by, start, max_gap)
    return s.groupBy(by, "session").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set(node)), ",").alias("nodes"), F.min(start).alias("first"), F.max(start).alias("last"))


def coverage(samples: DataFrame, node: str, time: str, value: str) -> DataFrame:
    """Per node: share of samples with a value, their number, first and last time, deviation and largest size."""
    there = F.col(value).isNotNull()
    return samples.groupBy(node).agg(F.avg(there.cast("double")).alias("coverage"), F.count(value).alias("n"), F.min(F.when(there, F.col(time))).alias("first"), F.max(F.when(there, F.col(time))).alias("last"), F.stddev_pop(value).alias("std"), F.max(F.abs(value)).alias("largest"))


def common_window(samples: DataFrame, index: str, node: str, nodes: int | None = None) -> DataFrame:
    """The longest run of indices at which all ``nodes`` (of the table, if not given) have a row; the first of equal ones.

    A run's ends are the indices without a neighbour, found by joins; only those are ordered.
    """
    total = F.broadcast(samples.agg(F.count_distinct(node).alias("_nodes"))) if nodes is None else None  # one row
    each = samples.groupBy(F.col(index).alias("_i")).agg(F.count_distinct(node).alias("c"))
    full = (each.where(F.col("c") == nodes) if total is None else each.crossJoin(total).where("c = _nodes")).select("_i")
    first = full.join(full.select((F.col("_i") + 1).alias("_i")), "_i", "left_anti").select("_i", F.lit(0).alias("end"))
    last = full.join(full.select((F.col("_i") - 1).alias("_i")), "_i", "left_anti").select("_i", F.lit(1).alias("end"))
    order = Window.partitionBy(F.lit(0)).orderBy("_i", "end")  # two rows per run
    runs = first.unionAll(last).withColumn("last", F.lead("_i").over(order)).where("end = 0").select(F.col("_i").alias("first"), "last", (F.col("last") - F.col("_i") + 1).alias("length"))
    return runs.orderBy(F.desc("length"), "first").limit(1)


def tumbling_events(samples: DataFrame, node: str, window: str, value: str, threshold: float, most: int | None = None, whole: int | None = None) -> DataFrame:
    """Windows whose deviation over each node's own median deviation is at least ``threshold`` at every node; at most ``most``, the highest.

    (window, score, nodes): the score is the least over all nodes of the table, so a node without samples in a window
    vetoes it. ``whole``: samples of a whole window; windows in which a node has fewer are incomplete and left out.
    """
    std = samples.groupBy(node, window).agg(F.stddev_pop(value).alias("s"), F.count(value).alias("c"))
    full = std.where("c > 0" if whole is None else F.col("c") >= whole)
    nodes = samples.agg(F.count_distinct(node).alias("_nodes"))
    own = few(quantiles(full, [node], "s", {"m": 0.5}))
    score = F.col("s") / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    least = full.join(own, node).groupBy(window).agg(F.min(score).alias("score"), F.count(F.lit(1)).alias("nodes"))
    found = least.crossJoin(F.broadcast(nodes)).where((F.col("score") >= threshold) & (F.col("nodes") == F.col("_nodes"))).drop("_nodes")  # one row
    return found if most is None else found.orderBy(F.desc("score"), window).limit(most)


def sliding_gate(samples: DataFrame, node: str, index: str, value: str, length: int, lo: float, hi: float) -> DataFrame:
    """Half-overlapping whole windows whose deviation is between ``lo`` and ``hi`` times the node's median at all nodes.

    ``samples``: a row per node and index. A window counts if every node of the table has all ``length`` values in it
    and none is constant; the median is over those windows. (start, nodes, rms): rms is the mean of the deviations.
    """
    half = length // 2
    start = F.explode(F.array(F.floor(F.col(index) / half) * half, F.floor(F.col(index) / half) * half - half))
    each = samples.withColumn("start", start).groupBy(node, "start").agg(F.stddev_pop(value).alias("s"), F.count(value).alias("c")).where(F.col("c") == length)
    nodes = samples.agg(F.count_distinct(node).alias("_nodes"))
    full = each.groupBy("start").agg(F.count(F.lit(1)).alias("nodes"), F.min("s").alias("least")).crossJoin(F.broadcast(nodes)).where("nodes = _nodes").drop("_nodes")  # one row
    each = each.join(full, "start").where("s > 0")
    mid = few(quantiles(each, [node], "s", {"m": 0.5}))
    ok = (F.col("s") > lo * F.col("m")) & (F.col("s") < hi * F.col("m"))
    return each.where("least > 0").join(mid, node).groupBy("start", "nodes").agg(F.min(ok.cast("int")).alias("ok"), F.avg("s").alias("rms")).where("ok = 1").drop("ok")


def before_after(track: DataFrame, node: str, order: str, value: str, files: int) -> DataFrame:
    """``track`` with the shift between the medians of the ``files`` rows before and of as many from the row on; null at the ends."""
    w = f"(PARTITION BY {node} ORDER BY {order} ROWS BETWEEN"
    full = F.expr(f"count({value}) OVER {w} {files} PRECEDING AND 1 PRECEDING) = {files} AND count({value}) OVER {w} CURRENT ROW AND {files - 1} FOLLOWING) = {files}")
    shift = F.expr(f"percentile({value}, 0.5) OVER {w} CURRENT ROW AND {files - 1} FOLLOWING) - percentile({value}, 0.5) OVER {w} {files} PRECEDING AND 1 PRECEDING)")
    return track.withColumn("shift", F.when(full, shift))


def largest_gap(angles: DataFrame, by: str, angle: str) -> DataFrame:
    """Per group the largest gap of a set of directions in degrees, round the circle, and half the arc that covers them."""
    a = angles.select(by, F.pmod(F.col(angle), F.lit(360.0)).alias("a")).distinct()
    o = Window.partitionBy(by).orderBy("a")
    first = F.first("a").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gaps = a.withColumn("g", F.coalesce(F.lead("a").over(o), first + 360) - F.col("a"))
    return gaps.groupBy(by).agg(F.max("g").alias("gap")).withColumn("half_arc", (360 - F.col("gap")) / 2)


def filled(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``rows`` with missing values taken linearly (by position in the order) between neighbours, at the ends from the nearest."""
    o = Window.partitionBy(by).orderBy(order)
    back, ahead = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(0, Window.unboundedFollowing)
    k = rows.withColumn("_k", F.row_number().over(o))
    at = F.when(F.col(value).isNotNull(), F.col("_k"))
    cols = {"_v0": F.last(value, ignorenulls=True).over(back), "_v1": F.first(value, ignorenulls=True).over(ahead), "_k0": F.last(at, ignorenulls=True).over(back), "_k1": F.first(at, ignorenulls=True).over(ahead)}
    m = k.withColumns(cols)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_k") - F.col("_k0")) / (F.col("_k1") - F.col("_k0"))
    inside = F.when(F.col("_k1") > F.col("_k0"), line).otherwise(F.col("_v0"))
    return m.withColumn("filled", F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(inside)).drop("_k", *cols)


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of one value in the order of each group: by, run (from 0), value, first, last, length. Nulls are a value."""
    o = Window.partitionBy(by).orderBy(order)
    new = F.when(F.row_number().over(o) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(o)), 0).otherwise(1)
    marked = rows.select(by, F.col(order).alias("_o"), F.col(value).alias("_v"), new.alias("_new"))
    numbered = marked.withColumn("run", F.sum("_new").over(Window.partitionBy(by).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "run").agg(F.first("_v").alias("value"), F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("length"))


def shot_windows(samples: DataFrame, shots: DataFrame, node: str, index: str, value: str, shot: str, at: str, length: int, before: int, search: int, factor: float = 3.0) -> DataFrame:
    """(shot, onset, start, end) of windows at known times: index ``at`` of each shot, refined by the amplitudes.

    The onset is the first index within ``search`` of it at which every node is above ``factor`` times its own median
    size, else the time as given. Windows start ``before`` samples earlier; those that leave the record are left out.
    """
    size = samples.select(F.col(node).alias("_n"), F.col(index).alias("_i"), F.abs(F.coalesce(F.col(value), F.lit(0.0))).alias("_a"))
    back = few(quantiles(size, ["_n"], "_a", {"_m": 0.5}))
    extent = size.agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.count_distinct("_n").alias("_nodes"))  # one row
    hot = size.join(back, "_n").where(F.col("_a") > factor * F.col("_m")).groupBy("_i").agg(F.count_distinct("_n").alias("_c"))
    near = shots.select(F.col(shot).alias("shot"), F.col(at).alias("nominal"), F.explode(F.sequence(F.col(at) - search, F.col(at) + search - 1)).alias("_i")) if search else shots.select(F.col(shot).alias("shot"), F.col(at).alias("nominal"), F.lit(None).cast("long").alias("_i"))
    found = near.join(hot, "_i").crossJoin(F.broadcast(extent)).where("_c = _nodes").groupBy("shot", "nominal").agg(F.min("_i").alias("_onset"))
    placed = shots.select(F.col(shot).alias("shot"), F.col(at).alias("nominal")).join(found, ["shot", "nominal"], "left").crossJoin(F.broadcast(extent))
    onset = F.coalesce("_onset", "nominal")
    out = placed.select("shot", onset.alias("onset"), (onset - before).alias("start"), (onset - before + length).alias("end"), "_lo", "_hi")
    return out.where("start >= _lo AND end <= _hi + 1").drop("_lo", "_hi")
