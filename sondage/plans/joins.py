"""Joins that aren't equi-joins, planned as equi-joins on buckets so that they shuffle by a key and never nest loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import few, with_next
from .scratch import written


def interval_match(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, seq: str, width: float, tolerance: float = 0.0, point_key: str = "point_key") -> DataFrame:
    """LEFT join of each point to the first window (by ``seq``) with start - tolerance <= at <= end + tolerance.

    Time is cut into buckets of ``width`` (choose it near a window's length) or of a part of it that few windows begin
    and end in. What covers a bucket whole counts by its least ``seq`` only, found over aligned spans of 1, 2, 4 .. buckets;
    of the windows that begin or end in it those stay that are before that one and that no earlier one covers there. A
    point meets the short list of its bucket, so no pairs are made. ``point_key`` names the unique key of points. Both
    ends are inclusive.
    """
    lo, hi = F.col(start) - F.lit(tolerance), F.col(end) + F.lit(tolerance)
    held = windows.select(F.struct(*windows.columns).alias("_w"), F.col(seq).alias("_seq"), lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi")).where("_lo <= _hi AND _seq IS NOT NULL")
    said = held.agg(F.count(F.lit(1)), F.max("_hi") - F.min("_lo"), F.max(F.col("_hi") - F.col("_lo"))).first()
    span, fine = said[1] or 0.0, float(width)
    while fine * said[0] > 8 * span > 0 and fine > width / 1024:  # four to eight begin, and as many end, in a bucket
        fine /= 2
    bucket = lambda c: F.floor(c / F.lit(fine))
    held = held.withColumns({"_first": bucket(F.col("_lo")), "_last": bucket(F.col("_hi"))})

    # Of buckets first + 1 .. last - 1 the aligned spans: at each level at most one at either end.
    levels = max(0, int((said[2] or 0.0) / fine)).bit_length() + 1
    nodes = []
    for k in range(levels):
        left, right = F.expr(f"shiftright(_first + {2**k}, {k})"), F.expr(f"shiftright(_last, {k})")
        nodes += [F.when((left < right) & (F.abs(n % 2) == 1), F.struct(F.lit(k).alias("k"), (n - back).alias("n"))) for n, back in ((left, 0), (right, 1))]
    whole = held.select("_seq", F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull())).alias("_n")).groupBy("_n.k", "_n.n").agg(F.min("_seq").alias("_least"))
    each = F.explode(F.sequence(F.expr("shiftleft(n, k)"), F.expr("shiftleft(n + 1, k) - 1"))).alias("_bucket")
    cover = whole.select(each, "_least").groupBy("_bucket").agg(F.min("_least").alias("_least"))
    covering = cover.join(held, F.col("_least") == F.col("_seq")).where("_bucket > _first AND _bucket < _last")

    ends = held.withColumn("_bucket", F.explode(F.array_distinct(F.array("_first", "_last")))).join(cover, "_bucket", "left").where("_least IS NULL OR _seq < _least")
    side = F.when(F.col("_first") == F.col("_last"), 0).when(F.col("_bucket") == F.col("_first"), 1).otherwise(2)
    earlier = Window.partitionBy("_bucket", "_side").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_side", side).withColumns({"_from": F.min("_lo").over(earlier), "_to": F.max("_hi").over(earlier)})
    ends = ends.where("_side = 0 OR _from IS NULL OR _side = 1 AND _lo < _from OR _side = 2 AND _hi > _to")

    kept = ["_bucket", "_seq", "_lo", "_hi", "_w"]
    lists = covering.select(*kept).unionByName(ends.select(*kept)).groupBy("_bucket").agg(F.collect_list(F.struct(*kept[1:])).alias("_list"))
    before = lambda a, b: F.when(a["_seq"] < b["_seq"], -1).when(a["_seq"] > b["_seq"], 1).otherwise(0)
    lists = lists.select("_bucket", F.array_sort("_list", before).alias("_list"))
    met = points.withColumn("_bucket", bucket(F.col(at))).join(lists, "_bucket", "left")
    first = F.get(F.filter("_list", lambda w: (F.col(at) >= w["_lo"]) & (F.col(at) <= w["_hi"])), F.lit(0))["_w"]
    return met.withColumn("_w", first).select(*points.columns, *[F.col("_w")[c].alias(c) for c in windows.columns])


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Inner join of spans that overlap strictly: left.end > right.start and left.start < right.end."""
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    spread = lambda df, span, name: df.withColumn(name, F.explode(F.sequence(bucket(F.col(span[0])), F.greatest(bucket(F.col(span[0])), bucket(F.col(span[1]))))))
    a, b = spread(left, left_span, "_a"), spread(right, right_span, "_b")
    both = (F.col(left_span[1]) > F.col(right_span[0])) & (F.col(left_span[0]) < F.col(right_span[1]))
    once = F.col("_a") == F.greatest(bucket(F.col(left_span[0])), bucket(F.col(right_span[0])))  # in the first bucket they share
    return a.join(b, F.col("_a") == F.col("_b")).where(both & once).drop("_a", "_b")


#: Rows of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` rows (counting stops there); else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def interpolate(points: DataFrame, knots: DataFrame, x: str, knot_x: str, knot_y: str, out: str, width: float, by: list[str] | None = None) -> DataFrame:
    """``points`` with ``out``: linear interpolation of the knots at ``x``, clamped outside them, per group ``by``.

    Knots are ordered within ranges of 100 ``width`` only, and points meet the segment they fall in by an equi-join on
    buckets of ``width``. Knots must be distinct in ``knot_x`` within a group. Without knots ``out`` is null.
    """
    by = by or []
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    seg = with_next(knots.select(*by, F.col(knot_x).alias("_x0"), F.col(knot_y).alias("_y0")), by, "_x0", ["_x0", "_y0"], 100.0 * width)
    seg = seg.withColumnsRenamed({"next__x0": "_x1", "next__y0": "_y1"})
    ends = seg.groupBy(*by).agg(F.min("_x0").alias("_lo"), F.max("_x0").alias("_hi"), F.min_by("_y0", "_x0").alias("_ylo"), F.max_by("_y0", "_x0").alias("_yhi"))
    ends = few(ends) if by else ends
    inner = seg.where("_x1 IS NOT NULL").withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_x0")), bucket(F.col("_x1")))))
    ranged = points.join(ends, by, "left") if by else points.crossJoin(F.broadcast(ends))  # one row
    within = (F.col(x) >= F.col("_x0")) & (F.col(x) < F.col("_x1"))
    keyed = ranged.withColumn("_bucket", bucket(F.col(x)))
    on = [keyed["_bucket"] == inner["_bucket"], within, *[keyed[c] == inner[c] for c in by]]
    met = keyed.join(inner, on, "left")
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    value = F.when(F.col(x) <= F.col("_lo"), F.col("_ylo")).when(F.col(x) >= F.col("_hi"), F.col("_yhi")).otherwise(line)
    return met.select(*[keyed[c] for c in points.columns], value.alias(out))


def proximity_pairs(points: DataFrame, seq: str, x: str, y: str, tolerance: float, differ: str | None = None) -> DataFrame:
    """Pairs seq1 < seq2 at a planar distance of ``tolerance`` or less (``differ``: only pairs that differ in it).

    Cells have the side of the tolerance; one side stays in its cell, the other is dealt to the nine around it.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(tolerance)))
    keep = [seq, x, y] + ([differ] if differ else [])
    one = points.select(*[F.col(c).alias(f"{c}1") for c in keep], cell(x).alias("cx"), cell(y).alias("cy"))
    near = F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))")
    two = points.select(*[F.col(c).alias(f"{c}2") for c in keep], cell(x).alias("_x"), cell(y).alias("_y"), F.explode(near).alias("_d"))
    two = two.withColumn("cx", F.col("_x") + F.col("_d.i")).withColumn("cy", F.col("_y") + F.col("_d.j")).drop("_x", "_y", "_d")
    d = distance(F.col(f"{x}1"), F.col(f"{y}1"), F.col(f"{x}2"), F.col(f"{y}2"))
    test = (F.col(f"{seq}1") < F.col(f"{seq}2")) & (d <= tolerance)
    if differ:
        test &= F.col(f"{differ}1") != F.col(f"{differ}2")
    return one.join(two, ["cx", "cy"]).where(test).select(f"{seq}1", f"{seq}2", d.alias("distance"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def nearest_within(points: DataFrame, others: DataFrame, key: str, x: str, y: str, other_key: str, tolerance: float) -> DataFrame:
    """(key, other, distance): of each point the nearest of ``others`` within the tolerance, the least of equal ones.

    Points without one are left out, so an anti join on the result masks what is far from all samples. Cells begin with
    the side, a half, a fourth .. of the tolerance, at which the ``others`` of a cell are two on average, and a point
    meets the list of the nine around it, one row. It is done if its nearest is no farther than the side; the rest is
    written and meets cells twice as wide, up to the tolerance.
    """
    near = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    cell = lambda c, side: F.floor(F.col(c) / F.lit(side))
    left = points.select(F.col(key).alias("key"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    places = others.select(F.col(x).alias("_x2"), F.col(y).alias("_y2"), F.col(other_key).alias("other")).where("_x2 IS NOT NULL AND _y2 IS NOT NULL")
    places = written(places.groupBy("_x2", "_y2").agg(F.min("other").alias("other")), "places")
    sides = [float(tolerance) / 2**k for k in range(11)]
    said = places.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.struct(cell("_x2", s), cell("_y2", s))) for s in sides]).first()
    least = next((k for k, n in enumerate(said[1:]) if said[0] <= 2 * n), len(sides) - 1)
    found = []
    for side in reversed(sides[: least + 1]):
        dealt = places.select("_x2", "_y2", "other", cell("_x2", side).alias("_cx"), cell("_y2", side).alias("_cy"), near.alias("_d"))
        dealt = dealt.groupBy((F.col("_cx") + F.col("_d.i")).alias("_cx"), (F.col("_cy") + F.col("_d.j")).alias("_cy")).agg(F.collect_list(F.struct("_x2", "_y2", "other")).alias("_list"))
        each = F.transform("_list", lambda o: F.struct(distance(F.col("_x1"), F.col("_y1"), o["_x2"], o["_y2"]).alias("distance"), o["other"].alias("other")))
        met = left.withColumns({"_cx": cell("_x1", side), "_cy": cell("_y1", side)}).join(dealt, ["_cx", "_cy"], "inner" if side == tolerance else "left").select("key", "_x1", "_y1", F.array_min(each).alias("b"))
        if side == tolerance:
            found.append(met.where(F.col("b.distance") <= tolerance).select("key", "b"))
        else:
            met = written(met, "nearest")
            done = F.coalesce(F.col("b.distance") < side * (1 - 1e-9), F.lit(False))  # others outside of the nine cells are farther than the side
            found.append(met.where(done).select("key", "b"))
            left = met.where(~done).select("key", "_x1", "_y1")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.groupBy("key").agg(F.min("b").alias("b")).select(F.col("key").alias(key), F.col("b.other").alias("other"), F.col("b.distance").alias("distance"))
