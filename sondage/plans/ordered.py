"""Ranks, quantiles and neighbours in an order, without one task that holds a whole column or a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Accuracy of the sketch that brackets an exact rank: about four in so many rows are then looked at one by one.
ACCURACY = 10_000
#: Groups that are held by every task; more of them are met by a shuffle, which they are enough to share out.
FEW = 10_000


def few(groups: DataFrame, most: int = FEW) -> DataFrame:
    """A table of groups as a broadcast of its rows if it has at most ``most`` (counting stops there), else as it is."""
    held = groups.limit(most + 1).toArrow()
    return groups if held.num_rows > most else F.broadcast(groups.sparkSession.createDataFrame(held, groups.schema))


def quantiles(rows: DataFrame, by: list[str], value: str | Column, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of the values that are neither null nor NaN: a row per group that has any.

    ``wanted``: share of each output column. A mergeable sketch brackets each rank; one aggregate then counts what is
    below the bracket, and only values inside it are ordered, a row per distinct value. Nulls in ``by`` are a group.
    The sketches of few groups go to the rows; the rows aren't shuffled.
    """
    keys = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("k")).alias("_g")
    data = rows.select(keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    shares = sorted(set(wanted.values()))
    edge = 2.0 / ACCURACY
    ends = [x for q in shares for x in (max(0.0, q - edge), min(1.0, q + edge))]
    sketch = data.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_p"))
    met = data.join(few(sketch), "_g")
    low, high = (lambda i: F.get("_p", F.lit(2 * i))), (lambda i: F.get("_p", F.lit(2 * i + 1)))
    side = lambda i: F.when(F.col("_v") < low(i), -1).when(F.col("_v") > high(i), 1).otherwise(0)
    place = F.array(*[F.struct(F.lit(i).alias("_i"), side(i).alias("_side")) for i in range(len(shares))])
    # A row per value inside the bracket, one for all below (with the largest) and one for all above (with the least).
    counted = met.select("_g", "_n", "_v", F.inline(place)).withColumn("_x", F.when(F.col("_side") == 0, F.col("_v")))
    counted = counted.groupBy("_g", "_n", "_i", "_side", "_x").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    counted = counted.withColumn("_x", F.when(F.col("_side") == -1, F.col("_most")).otherwise(F.col("_least")))
    upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_g", "_i").orderBy("_x")))
    share = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("_i") + 1)
    at = share * (F.col("_n") - 1)
    lower, upper = F.floor(at), F.ceil(at)
    found = upto.groupBy("_g", "_i").agg(F.min(F.when(F.col("_upto") > lower, F.col("_x"))).alias("_lo"), F.min(F.when(F.col("_upto") > upper, F.col("_x"))).alias("_hi"), F.first(at - lower).alias("_part"))
    value_ = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")
    out = found.groupBy("_g").agg(*[F.max(F.when(F.col("_i") == shares.index(q), value_)).alias(name) for name, q in wanted.items()])
    return out.select(*[F.col("_g")[f"k{i}"].alias(c) for i, c in enumerate(by)], *wanted)


def _nth(rows: DataFrame, value: str, size: DataFrame, n: str) -> DataFrame:
    """(_at, _less): the ``n``-th smallest value and how many are less; ``size`` is one row with ``n`` and the number of rows, ``all``."""
    edge = 2.0 / ACCURACY
    held = rows.select(F.col(value).alias("_v")).crossJoin(F.broadcast(size))  # one row
    sketch = held.agg(F.percentile_approx("_v", [i / 1000 for i in range(1001)], ACCURACY).alias("_p"), F.max(F.col(n) / F.col("all")).alias("_q"))
    at = lambda x: F.get("_p", F.least(F.greatest(x, F.lit(0)), F.lit(1000)).cast("int"))
    ends = sketch.select(at(F.floor((F.col("_q") - edge) * 1000) - 1).alias("_lo"), at(F.ceil((F.col("_q") + edge) * 1000) + 1).alias("_hi"))
    inside = held.crossJoin(F.broadcast(ends)).where(F.col("_v") <= F.col("_hi"))
    counted = inside.groupBy(F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x"), F.col(n).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy(F.col("_x").asc_nulls_first()))  # a row per value between the ends
    found = counted.withColumn("_upto", upto).where("_upto >= _n AND _x IS NOT NULL")
    return found.agg(F.min(F.struct("_x", (F.col("_upto") - F.col("_c")).alias("_less"))).alias("_b")).select(F.col("_b._x").alias("_at"), F.col("_b._less").alias("_less"))


def lowest(rows: DataFrame, value: str, tie: str | Column, size: DataFrame, n: str) -> DataFrame:
    """The ``n`` rows of least ``value``, equal ones by ``tie``, a number that tells them apart.

    ``size`` is one row with ``n`` and the number of rows, ``all``. Values, then the ties of the last value, are cut at
    exact ranks found by sketches; no rows are ordered.
    """
    kept = rows.withColumn("_tie", (F.col(tie) if isinstance(tie, str) else tie).cast("double"))
    last = F.broadcast(_nth(rows, value, size, n))  # one row
    equal = kept.crossJoin(last).where(F.col(value) == F.col("_at"))
    rest = equal.groupBy("_less").agg(F.count(F.lit(1)).alias("all")).crossJoin(F.broadcast(size.select(F.col(n).alias("_n")))).select("all", (F.col("_n") - F.col("_less")).alias("left"))
    end = F.broadcast(_nth(equal, "_tie", rest, "left").select(F.col("_at").alias("_end")))  # one row
    below = (F.col(value) < F.col("_at")) | (F.col(value) == F.col("_at")) & (F.col("_tie") <= F.col("_end"))
    return kept.crossJoin(last).crossJoin(end).where(below).select(*rows.columns)


def with_next(rows: DataFrame, by: list[str], order: str, columns: list[str], width: float) -> DataFrame:
    """``rows`` with next_<column> of the row that follows in the order of its group; null at the end.

    Rows are dealt to ranges of ``width`` of the order. Only rows of one range are ordered together, and a row per range
    (its first) gives the others what follows their last. The order has no nulls and no ties within a group.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    dealt = rows.withColumns({f"_k{i}": F.col(c) for i, c in enumerate(by)}).withColumn("_range", F.floor(F.col(order) / F.lit(float(width))))
    inside = Window.partitionBy(*names, "_range").orderBy(order)
    dealt = dealt.withColumn("_ahead", F.lead(F.struct(*columns)).over(inside))
    first = rows.groupBy(*keys, F.floor(F.col(order) / F.lit(float(width))).alias("_range")).agg(F.min_by(F.struct(*columns), order).alias("_first"))
    chain = Window.partitionBy(*names).orderBy("_range") if by else Window.partitionBy(F.lit(0)).orderBy("_range")  # a row per range
    after = first.withColumn("_after", F.lead("_first").over(chain)).drop("_first")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*names, "_range"]]
    met = dealt.alias("l").join(after.alias("r"), on, "left")
    then = F.coalesce("l._ahead", "r._after")
    return met.select(*[F.col(f"l.{c}") for c in rows.columns], *[then[c].alias(f"next_{c}") for c in columns])


def with_halo(rows: DataFrame, by: list[str], order: str, halo: int, width: float) -> DataFrame:
    """``rows`` with _range (a range of ``width`` of the order) and _own; and beside each range the ``halo`` rows of its group before and after it.

    Windows of up to ``halo`` rows either side over (by, _range) are then whole for the rows with _own; those of the halo
    are dropped afterwards. Only rows near the borders of ranges are ordered together. The order has no nulls.
    """
    dealt = rows.withColumns({"_range": F.floor(F.col(order) / F.lit(float(width))), "_own": F.lit(True)})
    keys = [F.col(c) for c in by]
    up, down = (Window.partitionBy(*keys, "_range").orderBy(o) for o in (F.col(order).asc(), F.col(order).desc()))
    edge = dealt.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).where((F.col("_up") <= halo) | (F.col("_down") <= halo)).drop("_up", "_down")
    place = Window.partitionBy(*keys).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)  # at most 2 halo rows a range
    ranges = lambda f: F.array(*[f("_range", j).over(place) for j in range(1, halo + 1)])
    # A row goes to the ranges of the rows that have it as one of their neighbours.
    near = edge.withColumn("_to", F.array_distinct(F.filter(F.concat(ranges(F.lag), ranges(F.lead)), lambda r: r.isNotNull())))
    ghosts = near.withColumn("_r", F.explode("_to")).where("_r <> _range").withColumn("_range", F.col("_r")).withColumn("_own", F.lit(False))
    return dealt.unionByName(ghosts.select(*dealt.columns))
