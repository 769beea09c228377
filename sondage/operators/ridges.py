"""The ridge of a dispersion image, followed from frequency to frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _highest(cells: Column) -> Column:
    """The cell (c, e) of most energy, the lowest velocity of equal ones; null of none."""
    best = F.array_max(F.transform(cells, lambda x: F.struct(F.round(x["e"], 9).alias("r"), (-x["c"]).alias("n"), x["e"].alias("e"))))
    return F.when(F.size(cells) > 0, F.struct((-best["n"]).alias("c"), best["e"].alias("e")))


def _half_width(cells: Column, pick: Column) -> Column:
    """Half the distance between the nearest cells either side that have half the pick's energy or less, or the ends."""
    low = F.array_max(F.transform(F.filter(cells, lambda x: (x["c"] <= pick["c"]) & (x["e"] <= pick["e"] / 2)), lambda x: x["c"]))
    high = F.array_min(F.transform(F.filter(cells, lambda x: (x["c"] >= pick["c"]) & (x["e"] <= pick["e"] / 2)), lambda x: x["c"]))
    ends = F.transform(cells, lambda x: x["c"])
    return (F.coalesce(high, F.array_max(ends)) - F.coalesce(low, F.array_min(ends))) / 2


def pick_track(image: DataFrame, by: str, max_jump: float = 0.15, frequency: tuple[float, float] | None = None, velocity: tuple[float, float] | None = None, min_quality: float = 0.0) -> DataFrame:
    """(by, f, velocity, energy, width, quality): the ridge through an image (by, f, c, energy) of each group.

    It starts at the frequency with the sharpest peak (largest over mean energy, the lowest of equal ones) and is followed
    outwards both ways; from one frequency to the next the velocity changes by a share of ``max_jump`` at most, or not
    at all where the grid has no velocity so near. ``width`` is half the width at half the energy. Only the bands
    ``frequency`` and ``velocity`` (ends included) are looked at; picks sharper than ``min_quality`` are kept.
    A group's image is one row while it is folded: its size is that of the grid. Null energies count as none.
    """
    cells = image.select(F.col(by).alias("_by"), F.col("f").cast("double").alias("f"), F.col("c").cast("double").alias("c"), F.coalesce("energy", F.lit(0.0)).alias("e"))
    if frequency:
        cells = cells.where(F.col("f").between(*frequency))
    if velocity:
        cells = cells.where(F.col("c").between(*velocity))
    lines = cells.groupBy("_by", "f").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("cells"), (F.max("e") / (F.avg("e") + F.lit(1e-30))).alias("quality"))
    whole = lines.groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("f", "quality", "cells"))).alias("lines"))
    sharpest = F.array_max(F.transform("lines", lambda x, i: F.struct(F.round(x["quality"], 9).alias("q"), (-i).alias("n"))))
    whole = whole.withColumn("start", -sharpest["n"])

    none = F.array().cast("array<struct<f:double,velocity:double,energy:double,width:double,quality:double>>")

    def step(state: Column, line: Column) -> Column:
        v = state["v"]
        near = F.filter(line["cells"], lambda x: v.isNull() | (x["c"] >= v * (1 - max_jump)) & (x["c"] <= v * (1 + max_jump)))
        same = F.filter(line["cells"], lambda x: x["c"] == v)
        pick = F.coalesce(_highest(near), _highest(same))
        row = F.struct(line["f"].alias("f"), pick["c"].alias("velocity"), pick["e"].alias("energy"), _half_width(line["cells"], pick).alias("width"), line["quality"].alias("quality"))
        return F.struct(F.coalesce(pick["c"], v).alias("v"), F.when(pick.isNotNull(), F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

    def follow(along: Column, v: Column) -> Column:
        return F.aggregate(along, F.struct(v.cast("double").alias("v"), none.alias("out")), step, lambda s: s["out"])

    size = F.size("lines")
    first = F.expr("lines[start]")
    upward = F.slice("lines", F.col("start") + 1, size)
    downward = F.reverse(F.slice("lines", F.lit(1), F.col("start")))
    peak = _highest(first["cells"])["c"]
    out = whole.select("_by", F.explode(F.concat(follow(upward, F.lit(None)), follow(downward, peak))).alias("p"))
    return out.select(F.col("_by").alias(by), "p.*").where(F.col("quality") >= min_quality)
