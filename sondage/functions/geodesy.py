"""Positions on an ellipsoid as column expressions: transverse Mercator both ways, UTM zones, geodesic distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)
#: Coefficients of Krüger's series in powers of the third flattening, from the power of their order on.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
INVERSE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]
LATITUDE = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675],
    [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945],
    [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [4279 / 630, -332 / 35, -399572 / 14175],
    [4174 / 315, -144838 / 6237],
    [601676 / 22275],
]


def _third(ellipsoid: tuple[float, float]) -> float:
    return ellipsoid[1] / (2 - ellipsoid[1])


def series(table: list[list[float]], ellipsoid: tuple[float, float]) -> list[float]:
    """The numbers of a series for an ellipsoid."""
    n = _third(ellipsoid)
    return [sum(c * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


def rectifying_radius(ellipsoid: tuple[float, float]) -> float:
    n = _third(ellipsoid)
    return ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def transverse_mercator(longitude: Column, latitude: Column, meridian: Column | float, scale: float = 0.9996, east: float = 500_000.0, north: Column | float = 0.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees; within 40 degrees of the ``meridian`` better than a micrometre."""
    e = 2 * math.sqrt(_third(ellipsoid)) / (1 + _third(ellipsoid))
    wide = F.radians(longitude - meridian)
    s = F.sin(F.radians(latitude))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(wide)), F.atanh(F.sin(wide) / F.sqrt(1 + t * t))
    a = series(FORWARD, ellipsoid)
    x = eta + _sum([c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(a, 1)])
    y = xi + _sum([c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(a, 1)])
    k = scale * rectifying_radius(ellipsoid)
    return east + k * x, north + k * y


def from_transverse_mercator(easting: Column, northing: Column, meridian: Column | float, scale: float = 0.9996, east: float = 500_000.0, north: Column | float = 0.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of metres: the way back."""
    k = scale * rectifying_radius(ellipsoid)
    xi, eta = (northing - north) / k, (easting - east) / k
    b, d = series(INVERSE, ellipsoid), series(LATITUDE, ellipsoid)
    x = xi - _sum([c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(b, 1)])
    y = eta - _sum([c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(b, 1)])
    chi = F.asin(F.sin(x) / F.cosh(y))
    latitude = chi + _sum([c * F.sin(2 * j * chi) for j, c in enumerate(d, 1)])
    return meridian + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(latitude)


def utm_zone(longitude: Column) -> Column:
    """Zones of six degrees, 1 to 60 from the date line on; without the exceptions of Norway and Svalbard."""
    return F.pmod(F.floor((longitude + 180) / 6), F.lit(60)).cast("int") + 1


def utm_epsg(longitude: Column, latitude: Column) -> Column:
    """The number of the zone's system: 326 and the zone, 327 in the south."""
    return F.when(latitude >= 0, 32600).otherwise(32700) + utm_zone(longitude)


def utm(longitude: Column, latitude: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in a zone; the south counts from 10,000 km on."""
    return transverse_mercator(longitude, latitude, zone * 6 - 183, north=F.when(latitude >= 0, 0.0).otherwise(1e7))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ellipsoid: tuple[float, float] = WGS84, rounds: int = 20) -> Column:
    """Shortest distance on the ellipsoid in metres (Vincenty's inverse, ``rounds`` fixed); null for nearly opposite points."""
    a, f = ellipsoid
    b = a * (1 - f)
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    wide = F.radians(lon2 - lon1)
    wide = wide - 2 * math.pi * F.floor(wide / (2 * math.pi) + 0.5)
    given = F.struct(F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2"), wide.alias("wide"))

    def solve(g: Column) -> Column:
        def at(lam: Column) -> dict[str, Column]:
            p, q = g["c2"] * F.sin(lam), g["c1"] * g["s2"] - g["s1"] * g["c2"] * F.cos(lam)
            sin_s, cos_s = F.sqrt(p * p + q * q), g["s1"] * g["s2"] + g["c1"] * g["c2"] * F.cos(lam)
            sin_a = F.when(sin_s > 0, g["c1"] * g["c2"] * F.sin(lam) / sin_s).otherwise(0.0)
            cos2 = 1 - sin_a * sin_a
            mid = F.when(cos2 > 1e-15, cos_s - 2 * g["s1"] * g["s2"] / cos2).otherwise(0.0)
            return {"sin_s": sin_s, "cos_s": cos_s, "s": F.atan2(sin_s, cos_s), "sin_a": sin_a, "cos2": cos2, "mid": mid}

        def step(lam: Column) -> Column:
            def named(v: Column) -> Column:
                c = f / 16 * v["cos2"] * (4 + f * (4 - 3 * v["cos2"]))
                return g["wide"] + (1 - c) * f * v["sin_a"] * (v["s"] + c * v["sin_s"] * (v["mid"] + c * v["cos_s"] * (2 * v["mid"] * v["mid"] - 1)))

            return F.transform(F.array(F.struct(*[c.alias(k) for k, c in at(lam).items()])), named)[0]

        first = F.aggregate(F.sequence(F.lit(1), F.lit(rounds - 1)), g["wide"], lambda lam, _: step(lam))
        return F.transform(F.array(first), lambda lam: F.struct(lam.alias("was"), step(lam).alias("is"), F.struct(*[c.alias(k) for k, c in at(lam).items()]).alias("v")))[0]

    def length(r: Column) -> Column:
        v = r["v"]
        u = v["cos2"] * (a * a - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = v["mid"]
        more = small * v["sin_s"] * (m + small / 4 * (v["cos_s"] * (2 * m * m - 1) - small / 6 * m * (4 * v["sin_s"] * v["sin_s"] - 3) * (4 * m * m - 3)))
        return F.when(F.abs(r["is"] - r["was"]) < 1e-10, b * big * (v["s"] - more))

    return F.transform(F.transform(F.array(given), solve), length)[0]
