"""Passive arrays: window spectra, coherency of node pairs, velocities from spatial autocorrelation, array limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import bessel_j0
from ..plans.joins import distance
from ..plans.ordered import few


def spectra(windows: DataFrame, keys: list[str], array: str, dt: float, fmin: float, fmax: float) -> DataFrame:
    """(keys, f, re, im) of every window: mean removed, Hann taper, real Fourier transform between two frequencies."""

    @F.pandas_udf("array<struct<f:double,re:double,im:double>>")
    def transform(samples: pd.Series) -> pd.Series:
        out = []
        for v in samples:
            v = np.asarray(v, float)
            f = np.fft.rfftfreq(len(v), dt)
            s = np.fft.rfft((v - v.mean()) * np.hanning(len(v)))
            out.append([(float(a), float(b.real), float(b.imag)) for a, b in zip(f, s, strict=True) if fmin <= a <= fmax])
        return pd.Series(out)

    return windows.select(*keys, F.explode(transform(array)).alias("s")).select(*keys, "s.f", "s.re", "s.im")


def coherency(spectrum: DataFrame, node: str, window: str, by: str | None = None) -> DataFrame:
    """Per pair of nodes (of an array ``by``) and frequency: the mean cross-spectrum over the root of both powers, and the number of windows."""
    keys = [by] if by else []
    a = spectrum.select(*keys, F.col(node).alias("i"), window, "f", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = spectrum.select(*keys, F.col(node).alias("j"), window, "f", F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(b, [*keys, window, "f"]).where("i < j")
    power = F.sqrt(F.avg(F.col("ar") ** 2 + F.col("ai") ** 2) * F.avg(F.col("br") ** 2 + F.col("bi") ** 2))
    out = pairs.groupBy(*keys, "i", "j", "f").agg(F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("r"), F.avg(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")).alias("m"), power.alias("p"), F.count(F.lit(1)).alias("windows"))
    return out.where("p > 0").select(*keys, "i", "j", "f", (F.col("r") / F.col("p")).alias("re"), (F.col("m") / F.col("p")).alias("im"), "windows")


#: Nodes of a block of an array; pairs of blocks are shared out.
BLOCK = 1000


def separations(nodes: DataFrame, node: str, x: str, y: str, by: str | None = None) -> DataFrame:
    """(i, j, r) of all pairs of nodes, or with ``by`` (by, i, j, r) of the pairs within each array.

    An array of more than BLOCK nodes is dealt to blocks, and each pair of its blocks is a key of the join.
    """
    keys = [by] if by else []
    many = nodes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    dealt = nodes.join(few(many), by) if by else nodes.crossJoin(F.broadcast(many))  # one row
    dealt = dealt.select(*keys, F.col(node).alias("i"), F.col(x).alias("_x0"), F.col(y).alias("_y0"), "_n", F.pmod(F.xxhash64(node), F.col("_n")).alias("_g"))
    one = dealt.withColumn("_h", F.explode(F.sequence(F.col("_g"), F.col("_n") - 1))).drop("_n")
    two = dealt.select(*keys, F.col("i").alias("j"), F.col("_x0").alias("_x1"), F.col("_y0").alias("_y1"), F.col("_g").alias("_h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g"))).alias("_g"))
    met = one.join(two, [*keys, "_g", "_h"]).where("i < j OR i > j AND _g < _h")  # a pair of two blocks comes once, in either order
    return met.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), distance(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1")).alias("r"))


def rings(pairs: DataFrame, tolerance: float = 0.05, by: str | None = None) -> DataFrame:
    """``pairs`` with ring: sorted distances of an array (``by``), a new ring past the tolerance of its first.

    An array's distinct distances are one row while they are folded: half the square of its nodes at most.
    """
    keys = [by] if by else []
    firsts = F.aggregate(F.array_sort(F.collect_set("r")), F.array().cast("array<double>"), lambda s, r: F.when((F.size(s) == 0) | (r > F.element_at(s, -1) * (1 + tolerance)), F.concat(s, F.array(r))).otherwise(s))
    starts = pairs.groupBy(*keys).agg(firsts.alias("starts"))
    met = pairs.join(few(starts), by) if by else pairs.crossJoin(F.broadcast(starts))
    return met.withColumn("ring", F.size(F.filter("starts", lambda s: s <= F.col("r")))).drop("starts")


def spac_velocity(rho: DataFrame, f: str, r: str, value: str, vmin: float, vmax: float, dv: float) -> DataFrame:
    """Per frequency the velocity whose A J0(2 pi f r / c), A in [0, 1], is nearest to the coherencies, and its residual."""
    n = int(round((vmax - vmin) / dv)) + 1
    grid = rho.select(f, r, value, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * F.lit(float(dv)) + F.lit(float(vmin)))).alias("c"))
    j = grid.withColumn("j", bessel_j0(2 * math.pi * F.col(f) * F.col(r) / F.col("c")))
    sums = j.groupBy(f, "c").agg(F.sum(F.col(value) * F.col("j")).alias("vj"), F.sum(F.col("j") ** 2).alias("jj"), F.sum(F.col(value) ** 2).alias("vv"), F.count(F.lit(1)).alias("n"))
    a = F.least(F.greatest(F.when(F.col("jj") > 0, F.col("vj") / F.col("jj")).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    rms = F.sqrt(F.greatest((F.col("vv") - 2 * F.col("a") * F.col("vj") + F.col("a") ** 2 * F.col("jj")) / F.col("n"), F.lit(0.0)))
    best = sums.withColumn("a", a).withColumn("residual", rms).groupBy(f).agg(F.min_by(F.struct("c", "a", "residual"), F.struct(F.round("residual", 6), F.col("c"))).alias("b"))
    return best.select(f, F.col("b.c").alias("velocity"), F.col("b.a").alias("amplitude"), F.col("b.residual").alias("residual"))


def resolution(pairs: DataFrame, *by: str) -> DataFrame:
    """Shortest and longest wavelength of an array (of each of ``by``) and the depth of the longest: 2 least separation, 2 aperture, a third."""
    return pairs.groupBy(*by).agg((2 * F.min("r")).alias("lambda_min"), (2 * F.max("r")).alias("lambda_max"), (2 * F.max("r") / 3).alias("depth"))


def two_station(coh: DataFrame, pairs: DataFrame, by: list[str], min_coherence: float = 0.3, least_phase: float = 20.0) -> DataFrame:
    """(by, i, j, f, velocity, turns, coherence): phase velocities along the line through each pair of nodes.

    ``coh``: by, i, j, f, re, im; ``pairs``: by, i, j, r. The phase is unwrapped along frequency from the lowest one on: a
    step of more than half a turn is a whole turn the other way, and turns are counted up. Its sign is the direction,
    so its size counts. Frequencies of less coherence, and phases below ``least_phase`` degrees, have no velocity and are
    left out, but take part in the unwrapping. An error of a turn stays in all higher frequencies of a pair.
    """
    order = Window.partitionBy(*by, "i", "j").orderBy("f")
    rows = coh.select(*by, "i", "j", "f", F.atan2("im", "re").alias("p"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("coherence"))
    step = F.col("p") - F.lag("p").over(order)
    turn = F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)
    rows = rows.withColumn("_t", turn).withColumn("turns", F.sum("_t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    phase = F.abs(F.col("p") + 2 * math.pi * F.col("turns"))
    met = rows.withColumn("phase", phase).join(pairs.select(*by, "i", "j", "r"), [*by, "i", "j"]).where(F.col("r") > 0)
    good = met.where((F.col("coherence") >= min_coherence) & (F.col("phase") > math.radians(least_phase)) & (F.col("f") > 0))
    return good.select(*by, "i", "j", "f", (2 * math.pi * F.col("f") * F.col("r") / F.col("phase")).alias("velocity"), "turns", "coherence")


#: Of the fit of a plane wave: slownesses below the least, steps of the fine grid, rise of the misfit at 68 %.
SLOW, FINE, RISE = 5, 20, 2.30


def plane_wave(coh: DataFrame, nodes: DataFrame, by: str, node: str, x: str, y: str, vmin: float = 50.0, vmax: float = 20000.0, n_velocity: int = 60, azimuth_step: float = 10.0, position_error: float = 1.5, timing_error: float = 1e-4, min_coherence: float = 0.3, bins: int = 1) -> DataFrame:
    """Per array and frequency one plane wave: by, f, velocity, velocity_min, velocity_max, azimuth, azimuth_halfwidth, coherence, beam, phase_rms, n_pairs, wavelengths, resolved.

    ``coh`` (by, i, j, f, re, im, windows) is compared with the phases of trial waves: infinite velocity, a few beyond
    ``vmax``, then geometric steps down to ``vmin``, in every direction, and once more on a grid ``FINE`` times as fine
    around the best of these. First the largest beam is sought, then the least phase misfit, each pair weighed by the
    variance of its phase from coherence, ``position_error`` (metres, at the first slowness) and ``timing_error`` (s).
    Waves whose misfit is at most 2.30 (68 %) above the least, inflated if that is poor, are accepted: velocity_max is
    infinite if one of them is beyond ``vmax``, azimuth_halfwidth 180 if infinite velocity is. Azimuths point to where the
    wave comes from. ``wavelengths``: of the best wave, in apertures. ``bins``: independent values per window and frequency.
    Pairs below ``min_coherence`` aren't used; with fewer than three a frequency has no row.
    """
    at = lambda k: nodes.select(by, F.col(node).alias(k), F.col(x).cast("double").alias(f"x{k}"), F.col(y).cast("double").alias(f"y{k}"))
    used = coh.join(at("i"), [by, "i"]).join(at("j"), [by, "j"])
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    used = used.select(by, "f", (F.col("xi") - F.col("xj")).alias("dx"), (F.col("yi") - F.col("yj")).alias("dy"), size.alias("m"), F.atan2("im", "re").alias("p"), (F.col("windows") * bins).alias("n")).where(F.col("m") >= min_coherence)
    used = used.withColumn("pairs", F.count(F.lit(1)).over(Window.partitionBy(by, "f"))).where("pairs >= 3")
    aperture = separations(nodes, node, x, y, by).groupBy(by).agg(F.max("r").alias("aperture"))

    n_az = int(round(360 / azimuth_step))
    last = SLOW + n_velocity - 1
    slowness = lambda i: F.when(i < SLOW, i / (SLOW * vmax)).otherwise(F.pow(F.lit(vmax / vmin), (i - SLOW) / F.lit(float(n_velocity - 1))) / vmax)
    turn = 2 * math.pi
    trial = lambda s, az: F.col("p") + turn * F.col("f") * s * (F.sin(F.radians(az)) * F.col("dx") + F.cos(F.radians(az)) * F.col("dy"))
    wrapped = lambda v: v - turn * F.floor(v / turn + 0.5)

    cell = F.explode(F.sequence(F.lit(0), F.lit((last + 1) * n_az - 1)))
    grid = used.withColumn("cell", cell).where(f"cell = 0 OR cell >= {n_az}")  # infinite velocity has no direction
    grid = grid.withColumns({"s": slowness(F.floor(F.col("cell") / n_az)), "az": F.col("cell") % n_az * F.lit(float(azimuth_step))})
    beams = grid.groupBy(by, "f", "cell", "s").agg(F.avg(F.col("m") * F.cos(trial(F.col("s"), F.col("az")))).alias("beam"))
    first = beams.groupBy(by, "f").agg(F.min_by("s", F.struct(-F.round("beam", 9), "cell")).alias("s1"))
    m2 = F.col("m") * F.col("m")
    variance = (1 - m2) / (2 * F.col("n") * m2) + 2 * (turn * F.col("f") * F.col("s1") * position_error) ** 2 + 2 * (turn * F.col("f") * timing_error) ** 2
    weighed = used.join(first, [by, "f"]).withColumn("v", F.greatest(variance, F.lit(math.radians(0.5) ** 2)))

    def misfit(rows: DataFrame) -> DataFrame:
        r = wrapped(trial(F.col("s"), F.col("az")))
        return rows.groupBy(by, "f", "cell", "s", "az", "pairs").agg(F.sum(r * r / F.col("v")).alias("chi2"), F.avg(r * r).alias("rr"), F.avg(F.col("m") * F.cos(r)).alias("beam"), F.avg("m").alias("coherence"))

    coarse = weighed.withColumn("cell", cell).where(f"cell = 0 OR cell >= {n_az}")
    coarse = misfit(coarse.withColumns({"s": slowness(F.floor(F.col("cell") / n_az)), "az": F.col("cell") % n_az * F.lit(float(azimuth_step))}))
    best = coarse.groupBy(by, "f").agg(F.min_by(F.struct("cell", "az"), F.struct(F.round("chi2", 6), "cell")).alias("b"))
    i = F.floor(F.col("b.cell") / n_az)
    best = best.select(by, "f", slowness(F.greatest(i - 1, F.lit(0))).alias("lo"), slowness(F.least(i + 1, F.lit(last))).alias("hi"), F.col("b.az").alias("mid"))
    fine = weighed.join(best, [by, "f"]).withColumn("cell", F.explode(F.sequence(F.lit(1 << 20), F.lit((1 << 20) + (FINE + 1) ** 2 - 1))))
    k = F.col("cell") - (1 << 20)
    fine = fine.withColumns({"s": F.col("lo") + (F.col("hi") - F.col("lo")) * F.floor(k / (FINE + 1)) / FINE, "az": F.pmod(F.col("mid") + azimuth_step * (k % (FINE + 1) / F.lit(FINE / 2.0) - 1), F.lit(360.0))})
    every = coarse.unionByName(misfit(fine))
    found = every.groupBy(by, "f").agg(F.min_by(F.struct("s", "az", "chi2", "rr", "beam", "coherence", "pairs"), F.struct(F.round("chi2", 6), "cell")).alias("b"))
    scale = F.greatest(F.col("b.chi2") / F.greatest(F.col("b.pairs") - 2, F.lit(1)), F.lit(1.0))
    accepted = every.join(found.withColumn("limit", F.col("b.chi2") + RISE * scale), [by, "f"]).where("chi2 <= limit")
    region = accepted.groupBy(by, "f").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.first("b").alias("b"), F.array_sort(F.collect_set(F.round("az", 6))).alias("azs"))
    ahead = F.transform("azs", lambda a, k: F.coalesce(F.get("azs", k + 1), F.get("azs", F.lit(0)) + 360) - a)
    width = F.when(F.col("s0") == 0, 180.0).otherwise((360 - F.array_max(ahead)) / 2)
    infinite = F.lit(float("inf"))
    speed = lambda s: F.when(s > 0, 1 / s).otherwise(infinite)
    top = F.when(F.col("s0") < 1 / vmax, infinite).otherwise(1 / F.col("s0"))
    resolved = (F.col("s0") >= 1 / vmax) & (F.col("s1") < (1 - 1e-9) / vmin)
    out = region.join(few(aperture), by)
    velocity = speed(F.col("b.s"))
    return out.select(by, "f", velocity.alias("velocity"), speed(F.col("s1")).alias("velocity_min"), top.alias("velocity_max"), F.pmod(F.col("b.az") + 180, F.lit(360.0)).alias("azimuth"), width.alias("azimuth_halfwidth"), F.col("b.coherence").alias("coherence"), F.col("b.beam").alias("beam"), F.degrees(F.sqrt("b.rr")).alias("phase_rms"), F.col("b.pairs").alias("n_pairs"), F.when(F.col("aperture") > 0, velocity / (F.col("f") * F.col("aperture"))).alias("wavelengths"), resolved.alias("resolved"))


#: The first minimum of J0 and where it lies.
J0_LEAST, J0_LEAST_AT = -0.402759395702553, 3.831705970207512


def first_lobe_velocity(rho: Column, f: Column, r: Column, rounds: int = 40) -> Column:
    """The velocity whose J0(2 pi f r / c) is ``rho`` before its first minimum, by bisection; null outside (minimum, 1)."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(J0_LEAST_AT).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = bessel_j0(mid) > rho
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    z = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when((rho < 1) & (rho > J0_LEAST) & (f > 0), 2 * math.pi * f * r / z)


def separation_test(coh: DataFrame, pairs: DataFrame, by: str, ring_tolerance: float = 0.05, tolerance: float = 0.35, max_slope: float = 0.5, min_rings: int = 3, max_residual: float = 0.10, min_amplitude: float = 0.3, min_negative: float = 0.15, min_uniqueness: float = 1.5, max_imaginary: float = 0.6, vmin: float = 50.0, vmax: float = 3000.0, dv: float = 2.0) -> DataFrame:
    """Whether the coherency of an array falls with separation as that of a wave does: per array and frequency
    by, f, slope, velocity_ratio, velocity_slope, first_lobe, multi_lobe, multi_lobe_velocity, usable.

    ``coh``: by, i, j, f, re, im; ``pairs``: by, i, j, r. On the first lobe of J0 the coherency must fall with separation,
    and the velocities that the rings invert to (the median of a ring's pairs; two rings at least) must agree: deviation
    below ``tolerance`` of their mean, and a slope against separation, both as logarithms, below ``max_slope``; a signal
    common to all nodes gives velocities that grow with separation. Past the first zero, with ``min_rings`` rings one of
    which is below -``min_negative``, A J0(2 pi f r / c) is fitted to the rings' means over a grid of velocities: the best
    must lie inside the grid, with little residual, a fair amplitude, the inner ring before the minimum, no other
    velocity (20 % away) nearly as good, and little imaginary part.
    """
    placed = rings(pairs.select(by, "i", "j", "r"), ring_tolerance, by)
    rows = coh.join(placed, [by, "i", "j"]).withColumn("v", first_lobe_velocity(F.col("re"), F.col("f"), F.col("r")))
    whole = rows.groupBy(by, "f").agg(F.regr_slope("re", "r").alias("slope"), F.sqrt(F.avg(F.col("re") ** 2)).alias("real"), F.sqrt(F.avg(F.col("im") ** 2)).alias("imaginary"))
    per_ring = rows.groupBy(by, "f", "ring").agg(F.percentile("v", 0.5).alias("v"), F.avg("r").alias("r"), F.avg("re").alias("rho"))
    enough = F.count("v") >= 2
    spread = per_ring.groupBy(by, "f").agg(F.when(enough, F.stddev_pop("v") / F.avg("v")).alias("velocity_ratio"), F.when(enough, F.regr_slope(F.ln("v"), F.ln("r"))).alias("velocity_slope"), F.count(F.lit(1)).alias("n"), F.min("rho").alias("least"), F.min("r").alias("inner"))

    n = int(round((vmax - vmin) / dv)) + 1
    asked = spread.where((F.col("n") >= min_rings) & (F.col("least") <= -min_negative) & (F.col("f") > 0)).select(by, "f", "inner")
    grid = per_ring.join(asked, [by, "f"]).withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * F.lit(float(dv)) + F.lit(float(vmin)))))
    grid = grid.withColumn("j", bessel_j0(2 * math.pi * F.col("f") * F.col("r") / F.col("c")))
    sums = grid.groupBy(by, "f", "inner", "c").agg(F.sum(F.col("rho") * F.col("j")).alias("vj"), F.sum(F.col("j") ** 2).alias("jj"), F.sum(F.col("rho") ** 2).alias("vv"), F.count(F.lit(1)).alias("k"))
    a = F.least(F.greatest(F.when(F.col("jj") > 0, F.col("vj") / F.col("jj")).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    fit = sums.withColumn("amplitude", a).withColumn("residual", F.round(F.sqrt(F.greatest((F.col("vv") - 2 * F.col("amplitude") * F.col("vj") + F.col("amplitude") ** 2 * F.col("jj")) / F.col("k"), F.lit(0.0))), 9))
    best = fit.groupBy(by, "f", "inner").agg(F.min_by(F.struct("c", "amplitude", "residual"), F.struct("residual", "c")).alias("best"))
    other = fit.join(best.select(by, "f", "best"), [by, "f"]).where(F.abs(F.col("c") / F.col("best.c") - 1) > 0.2).groupBy(by, "f").agg(F.min("residual").alias("other"))
    good = best.join(other, [by, "f"], "left").where((F.col("best.c") > vmin) & (F.col("best.c") < vmin + (n - 1) * dv) & (F.col("best.residual") <= max_residual) & (F.col("best.amplitude") >= min_amplitude))
    good = good.where((F.col("inner") * F.col("f") / F.col("best.c") <= J0_LEAST_AT / (2 * math.pi)) & (F.col("other").isNull() | (F.col("other") >= min_uniqueness * F.greatest("best.residual", F.lit(1e-6)))))
    out = whole.join(spread, [by, "f"]).join(good.select(by, "f", F.col("best.c").alias("lobe")), [by, "f"], "left")
    first = F.coalesce((F.col("slope") < 0) & (F.col("velocity_ratio") < tolerance) & (F.col("velocity_slope") < max_slope), F.lit(False))
    multi = F.col("lobe").isNotNull() & (F.col("imaginary") <= max_imaginary * F.col("real"))
    return out.select(by, "f", "slope", "velocity_ratio", "velocity_slope", first.alias("first_lobe"), multi.alias("multi_lobe"), F.when(multi, F.col("lobe")).alias("multi_lobe_velocity"), (first | multi).alias("usable"))
