"""Closed forms as column expressions; all but the median depth stay in Catalyst."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MU0 = 4e-7 * math.pi
#: Newtonian constant, SI; a milligal is 1e-5 m/s2.
GRAVITY = 6.674e-11


def nmea_degrees(token: Column, hemisphere: Column) -> Column:
    """(d)ddmm.mmmm with N, S, E or W to signed degrees; null if it isn't a number."""
    value = F.expr("try_cast(0 AS DOUBLE)") + token.try_cast("double")
    whole = F.floor(value / 100)
    return (whole + (value - 100 * whole) / 60) * F.when(F.upper(hemisphere).isin("S", "W"), -1).otherwise(1)


def snake_label(label: Column) -> Column:
    """A column label in lower snake case; a unit in brackets is dropped."""
    bare = F.regexp_replace(F.lower(label), r"\([^)]*\)|\[[^\]]*\]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def geometric_factor(am: Column, bm: Column, an: Column, bn: Column) -> Column:
    """2 pi / (1/AM - 1/BM - 1/AN + 1/BN); a null distance (remote electrode) drops out."""
    inv = lambda r: F.coalesce(1 / r, F.lit(0.0))
    total = inv(am) - inv(bm) - inv(an) + inv(bn)
    return F.when(total != 0, 2 * math.pi / total)


def median_depth(am: Column, bm: Column, an: Column, bn: Column, steps: int = 60) -> Column:
    """Depth above which half of the signal of a homogeneous half-space comes from, by bisection; a null distance drops out.

    Bisected for all readings of a batch at once, and once for equal distances.
    """
    inv = lambda r: F.coalesce(1 / r, F.lit(0.0))
    total = inv(am) - inv(bm) - inv(an) + inv(bn)

    @F.pandas_udf("double")
    def bisected(am: pd.Series, bm: pd.Series, an: pd.Series, bn: pd.Series) -> pd.Series:
        r, back = np.unique(np.stack([am, bm, an, bn], axis=1), axis=0, return_inverse=True)
        r = [np.where(c == 0, -1.0, c) for c in r.T]
        summed = lambda f: f(r[0]) - f(r[1]) - f(r[2]) + f(r[3])
        hi = np.maximum.reduce([np.where(c < 0, 0.0, c) for c in r]) * 10
        lo = np.zeros_like(hi)
        with np.errstate(all="ignore"):
            whole = summed(lambda c: np.where(c < 0, 0.0, 1 / c))
            for _ in range(steps):
                mid = (lo + hi) / 2
                low = summed(lambda c, z=mid: np.where(c < 0, 0.0, 1 / c - 1 / np.sqrt(c * c + 4 * z * z))) / whole < 0.5
                lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return pd.Series(((lo + hi) / 2)[back.reshape(-1)])

    remote = lambda r: F.coalesce(r.cast("double"), F.lit(-1.0))
    return F.when(total != 0, bisected(*[remote(r) for r in (am, bm, an, bn)]))


def cumulative_response(height: Column, separation: float, orientation: str = "HCP") -> Column:
    """McNeill's response of the ground below a sensor at ``height``."""
    z = height / separation
    return 1 / F.sqrt(4 * z * z + 1) if orientation == "HCP" else F.sqrt(4 * z * z + 1) - 2 * z


def lin_conductivity(quadrature_ppm: Column, frequency: float, separation: float, height: Column, orientation: str = "HCP") -> Column:
    """Apparent conductivity (S/m) of a quadrature in ppm at low induction number."""
    return quadrature_ppm * 1e-6 * 4 / (2 * math.pi * frequency * MU0 * separation**2 * cumulative_response(height, separation, orientation))


def lin_susceptibility(inphase_ppm: Column, separation: float, height: Column, orientation: str = "HCP") -> Column:
    """Apparent susceptibility (SI) of an in-phase reading in ppm, static limit; null where the response is nothing.

    The response of horizontal coplanar coils changes sign at a height of 0.354 separations.
    """
    z = height / separation
    per_unit = -0.5 * (8 * z * z - 1) / F.pow(4 * z * z + 1, F.lit(2.5)) if orientation == "HCP" else -0.5 / F.pow(4 * z * z + 1, F.lit(1.5))
    return F.when(F.abs(per_unit) > 1e-12, inphase_ppm / (per_unit * 1e6))


def investigation_depth(separation: float, height: Column, orientation: str = "HCP", share: float = 0.7) -> Column:
    """Depth below the ground above which ``share`` of a low-induction-number reading arises."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    c = (1 - share) * cumulative_response(height, separation, orientation)
    z = F.sqrt((1 / (c * c) - 1) / 4) if orientation == "HCP" else (1 - c * c) / (4 * c)
    return z * separation - height


def layered_conductivity(conductivities: list[Column], thicknesses: list[Column], height: Column, separation: float, orientation: str = "HCP") -> Column:
    """Apparent conductivity of layers at low induction number: each weighs by the response of the ground between its faces."""
    if len(thicknesses) != len(conductivities) - 1:
        raise ValueError("a thickness for every layer but the last")
    whole = cumulative_response(height, separation, orientation)
    total, top = F.lit(0.0), height
    for i, sigma in enumerate(conductivities):
        below = cumulative_response(top + thicknesses[i], separation, orientation) if i < len(thicknesses) else F.lit(0.0)
        total = total + sigma * (cumulative_response(top, separation, orientation) - below) / whole
        top = top + thicknesses[i] if i < len(thicknesses) else top
    return total


def skin_depth(conductivity: Column, frequency: Column) -> Column:
    return F.sqrt(2 / (2 * math.pi * frequency * MU0 * conductivity))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    east = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    north = F.radians(lat2 - lat1)
    return radius * F.sqrt(east * east + north * north)


def tangent_plane(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north in metres from a reference point, 111320 m to a degree."""
    return (lon - lon0) * 111320.0 * F.cos(F.radians(lat0)), (lat - lat0) * 111320.0


def _corners(x0: Column, x1: Column, z0: Column, z1: Column, f) -> Column:
    return f(x1, z1) - f(x0, z1) - f(x1, z0) + f(x0, z0)


def gravity_prism(x0: Column, x1: Column, z0: Column, z1: Column) -> Column:
    """Vertical attraction (mGal per kg/m3) at the origin of an endless prism between x0, x1 and depths z0, z1."""

    def f(x: Column, z: Column) -> Column:
        r2 = x * x + z * z
        return F.when(r2 > 0, x / 2 * F.ln(r2) + z * F.atan2(x, z)).otherwise(0.0)

    return _corners(x0, x1, z0, z1, f) * (2 * GRAVITY * 1e5)


def magnetic_prism(x0: Column, x1: Column, z0: Column, z1: Column, inclination: float, intensity: float) -> Column:
    """Total-field anomaly (nT per SI susceptibility) at the origin for induced magnetisation along the profile."""
    angle = lambda x, z: F.atan2(x, z)
    log = lambda x, z: F.when(x * x + z * z > 0, F.ln(x * x + z * z) / 2).otherwise(0.0)
    a, b = _corners(x0, x1, z0, z1, angle), _corners(x0, x1, z0, z1, log)
    c, s = math.cos(math.radians(inclination)), math.sin(math.radians(inclination))
    return intensity / (2 * math.pi) * ((s * s - c * c) * a + 2 * s * c * b)


def bessel_j0(x: Column) -> Column:
    """J0 by the published polynomials (Abramowitz and Stegun 9.4.1 and 9.4.3), to 5e-8."""
    poly = lambda t, c: sum((F.lit(k) * F.pow(t, F.lit(float(i))) for i, k in enumerate(c)), F.lit(0.0))
    a = F.abs(x)
    t = a / 3
    # Fixed values of the two approximations.
    small = poly(t * t, [1.0, -2.2499997, 1.2656208, -0.3163866, 0.0444479, -0.0039444, 0.0002100])
    u = F.lit(3.0) / F.when(a < 3, 3.0).otherwise(a)
    size = poly(u, [0.79788456, -0.00000077, -0.00552740, -0.00009512, 0.00137237, -0.00072805, 0.00014476])
    phase = a + poly(u, [-0.78539816, -0.04166397, -0.00003954, 0.00262573, -0.00054125, -0.00029333, 0.00013558])
    return F.when(a <= 3, small).otherwise(size * F.cos(phase) / F.sqrt(a))


def halfspace_quadrature(conductivity: Column, frequency: float, separation: float) -> Column:
    """Quadrature (ppm) of horizontal coplanar coils on a uniform half-space, the closed form on the ground.

    2 / g2 (9 - (9 + 9 g + 4 g2 + g3) exp(-g)), g = (1 + i) separation / skin depth; the primary field is 1.
    """
    a = separation / skin_depth(conductivity, F.lit(frequency))
    # (9 + 9g + 4g2 + g3) with g = a + ia, g2 = 2i a2, g3 = 2 a3 (i - 1)
    re, im = 9 + 9 * a - 2 * a * a * a, 9 * a + 8 * a * a + 2 * a * a * a
    c, s, e = F.cos(a), F.sin(a), F.exp(-a)
    # times exp(-a)(cos a - i sin a); 2 / (2i a2) = -i / a2
    real = 9 - e * (re * c + im * s)
    return -real / (a * a) * 1e6


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def clock_difference(later: Column, earlier: Column) -> Column:
    """Seconds from one time of day to another; a difference below minus half a day is a step over midnight."""
    d = later - earlier
    return F.when(d < -43200, d + 86400).otherwise(d)


def critical_distance(v1: Column, v2: Column, h: Column) -> Column:
    """Least offset of a head wave from below a layer of thickness ``h``; null if it isn't faster below."""
    return F.when(v2 > v1, 2 * h * F.tan(F.asin(v1 / v2)))


def crossover_distance(v1: Column, v2: Column, h: Column) -> Column:
    """Offset from which on the head wave comes first; null if it isn't faster below."""
    return F.when(v2 > v1, 2 * h * F.sqrt((v2 + v1) / (v2 - v1)))


def depth_from_intercept(v1: Column, v2: Column, intercept: Column) -> Column:
    """Thickness of a layer from the intercept time of the head wave below it; null if it isn't faster below."""
    return F.when(v2 > v1, intercept * v1 * v2 / (2 * F.sqrt(v2 * v2 - v1 * v1)))
