"""Layers from first breaks: the best cut of the travel-time curve into any number of straight branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SUMS = ["w", "x", "t", "xx", "xt", "tt"]


def _line(s: dict[str, Column], origin: bool) -> tuple[Column, Column, Column]:
    """Slope, intercept and squared error of a weighted line from its sums; null where undetermined."""
    if origin:
        slope = F.when(s["xx"] > 0, s["xt"] / s["xx"])
        return slope, F.lit(0.0), s["tt"] - slope * s["xt"]
    den = s["w"] * s["xx"] - s["x"] * s["x"]
    slope = F.when(den > 1e-9, (s["w"] * s["xt"] - s["x"] * s["t"]) / den)
    intercept = (s["t"] - slope * s["x"]) / s["w"]
    return slope, intercept, s["tt"] - slope * s["xt"] - intercept * s["t"]


def thicknesses(velocities: Column, intercepts: Column) -> Column:
    """Thickness of each layer above the last from the velocities of all and the head waves' intercept times."""

    def term(h: Column, v: Column, below: Column) -> Column:
        return 2 * h * F.sqrt(F.greatest(below * below - v * v, F.lit(0.0))) / (below * v)

    def add(done: Column, k: Column) -> Column:
        below, v = F.get(velocities, k + 1), F.get(velocities, k)
        known = F.aggregate(F.transform(done, lambda h, i: term(h, F.get(velocities, i), below)), F.lit(0.0), lambda a, b: a + b)
        h = (F.get(intercepts, k) - known) * below * v / (2 * F.sqrt(below * below - v * v))
        return F.concat(done, F.array(h))

    ks = F.filter(F.sequence(F.lit(0), F.size(velocities)), lambda k: k < F.size(velocities) - 1)
    return F.aggregate(ks, F.array().cast("array<double>"), add)


def fit_layers(picks: DataFrame, shot: str, x: str, t: str, n_layers: int, least: int = 2, origin: bool = True, weight: str | None = None, crossovers: DataFrame | None = None) -> DataFrame:
    """Per shot: cuts, velocities, intercepts, thicknesses (arrays), sse and rms of the best model of ``n_layers``.

    Picks in order of offset are cut into ``n_layers`` branches of ``least`` picks or more, the first through the origin
    (``origin``); velocities must rise from branch to branch and intercepts of all but the first be positive. Of all cuts
    the least weighted squared error wins, then the earliest cuts. It is found branch by branch: the best model that ends
    with a given branch needs only the best ones that end where it begins. ``cuts`` are the picks before each next branch.
    ``crossovers``: (shot, k from 1, at), offsets where branch k takes over, instead of a search; every shot needs all.
    Shots without such a model have no row; picks without offset or time, or with an offset of 0 and below, don't count.
    """
    if n_layers < 1 or least < 2:
        raise ValueError("one layer and two picks a branch are the least")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = picks.where((F.col(x) > 0) & F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))).select(F.col(shot).alias("_s"), F.col(x).cast("double").alias("px"), F.col(t).cast("double").alias("pt"), w.alias("pw"))
    order = Window.partitionBy("_s").orderBy("px", "pt")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    px, pt, pw = F.col("px"), F.col("pt"), F.col("pw")
    each = dict(zip(_SUMS, (pw, pw * px, pw * pt, pw * px * px, pw * px * pt, pw * pt * pt), strict=True))
    sums = used.select("_s", "px", F.row_number().over(order).alias("k"), *[F.sum(e).over(upto).alias(n) for n, e in each.items()])
    zero = used.groupBy("_s").agg(F.count(F.lit(1)).alias("size")).select("_s", F.lit(0).alias("k"), "size", *[F.lit(0.0).alias(n) for n in _SUMS])
    ends = sums.join(zero.select("_s", "size"), "_s")
    starts = zero.unionByName(ends.drop("px"))
    if crossovers is not None:
        fixed = crossovers.select(F.col(shot).alias("_s"), F.col("k").cast("int").alias("branch"), F.col("at").cast("double").alias("at"))
        before = ends.join(fixed, "_s").where("px < at").groupBy("_s", "branch").agg(F.max("k").alias("cut"))
        cuts = before.select("_s", F.col("branch").alias("k"), "cut")

    a = starts.select("_s", "size", F.col("k").alias("i"), *[F.col(n).alias(f"{n}0") for n in _SUMS])
    b = ends.select("_s", F.col("k").alias("j"), *_SUMS)
    spans = a.join(b, "_s").where(F.col("j") - F.col("i") >= least)
    d = {n: F.col(n) - F.col(f"{n}0") for n in _SUMS}

    def branches(number: int) -> DataFrame:
        found = spans.where("i = 0") if number == 0 else spans.where("i > 0")
        found = found.where("j = size") if number == n_layers - 1 else found.where("j < size")
        slope, intercept, sse = _line(d, origin and number == 0)
        out = found.select("_s", "i", "j", slope.alias("p"), intercept.alias("b"), F.greatest(sse, F.lit(0.0)).alias("e"), d["w"].alias("w")).where("p > 0")
        out = out.where("b > 0") if number else out
        if crossovers is not None:
            for end, k in (("i", number), ("j", number + 1)):
                if 0 < k < n_layers:
                    out = out.join(cuts.where(F.col("k") == k).select("_s", F.col("cut").alias(end)), ["_s", end], "left_semi")
        return out

    best = branches(0).select("_s", "j", "p", "e", "w", F.array().cast("array<int>").alias("cuts"), F.array("p").alias("ps"), F.array().cast("array<double>").alias("bs"))
    for number in range(1, n_layers):
        more = branches(number).select("_s", F.col("i").alias("at"), F.col("j").alias("end"), F.col("p").alias("q"), F.col("b").alias("c"), F.col("e").alias("more"), F.col("w").alias("v"))
        last = best.withColumnRenamed("j", "at")
        met = last.join(more, ["_s", "at"]).where("q < p")  # faster below
        total = F.struct(F.round(F.col("e") + F.col("more"), 12).alias("r"), F.concat("cuts", F.array("at")).alias("cuts"))
        whole = F.struct((F.col("e") + F.col("more")).alias("e"), (F.col("w") + F.col("v")).alias("w"), F.concat("cuts", F.array("at")).alias("cuts"), F.concat("ps", F.array("q")).alias("ps"), F.concat("bs", F.array("c")).alias("bs"), F.col("q").alias("p"))
        # A model is told from others by its last branch alone: the later ones need only that.
        best = met.groupBy("_s", "at", "end").agg(F.min_by(whole, total).alias("m")).select("_s", F.col("end").alias("j"), "m.*")
    final = best.groupBy("_s").agg(F.min_by(F.struct("cuts", "ps", "bs", "e", "w"), F.struct(F.round("e", 12), "cuts")).alias("m")).select("_s", "m.*")
    v = F.transform("ps", lambda p: 1 / p)
    out = final.withColumn("velocities", v)
    return out.select(F.col("_s").alias(shot), "cuts", "velocities", F.col("bs").alias("intercepts"), thicknesses(F.col("velocities"), F.col("bs")).alias("thicknesses"), F.col("e").alias("sse"), F.sqrt(F.col("e") / F.col("w")).alias("rms"))
