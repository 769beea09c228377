"""A query per operator over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geodesy, scalar
from .operators import layers as refraction_layers
from .operators import lineage, passive, potential, records, resistivity, ridges, seismic, stations, survey, tomography, towed
from .plans import joins
from .plans.scratch import shared_folder
from .sources import binary, segy, text
from .streaming import events as stream_events

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str = "ts"):
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: seq, station, line, t (seconds), value, and a planar position."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("station"), F.col("event_type").alias("line"), seconds().alias("t"), "value", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))


EV = "ev AS (SELECT event_id AS seq, user_id AS station, event_type AS line, epoch_us(ts) / 1e6 AS t, value, value AS x, (event_id % 100)::DOUBLE AS y FROM events)"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {EV} SELECT station, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM ev GROUP BY station")
def station_means(spark, sf_dir):
    return r6(stations.station_means(events(spark, sf_dir), "station", "value"), "mean", "std")


@query(f"WITH {EV} SELECT seq, t, value FROM ev WHERE station = 7")
def gather(spark, sf_dir):
    return survey.gather(events(spark, sf_dir), "station", 7).select("seq", "t", "value")


@query("""WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 40) * 5.0 AS x, (s_suppkey // 40) * 3.0 AS y FROM supplier WHERE s_suppkey % 11 <> 0),
q AS (SELECT p_partkey AS id, (p_partkey % 100) * 2.0 AS x, (p_partkey // 100) * 2.0 AS y FROM part)
SELECT l_orderkey, l_linenumber, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS "offset" FROM lineitem LEFT JOIN p ON p.id = l_suppkey LEFT JOIN q ON q.id = l_partkey""")
def offsets_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").selectExpr("s_suppkey AS id", "(s_suppkey % 40) * 5.0D AS x", "(s_suppkey div 40) * 3.0D AS y", "'source' AS role")
    r = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "(p_partkey % 100) * 2.0D AS x", "(p_partkey div 100) * 2.0D AS y", "'receiver' AS role")
    out = seismic.offsets(table(spark, sf_dir, "lineitem"), s.unionAll(r), "l_suppkey", "l_partkey")
    return r6(out.select("l_orderkey", "l_linenumber", "offset"), "offset")


@query("""SELECT s_suppkey AS line, i AS station, round(s_suppkey * 10 + i * 2.0 * sin(radians(s_suppkey * 7)), 6) AS x, round(s_nationkey * 5 + i * 2.0 * cos(radians(s_suppkey * 7)), 6) AS y
FROM supplier, unnest(range(12)) AS t(i)""")
def geometry_from_line(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey * 10 AS x0", "s_nationkey * 5 AS y0", "s_suppkey * 7 AS azimuth")
    return r6(survey.points_on_lines(s, "s_suppkey", "x0", "y0", "azimuth", 2.0, 12), "x", "y")


@query("""WITH p AS (SELECT 'source' AS role, s_acctbal AS x, s_suppkey::DOUBLE AS y FROM supplier UNION ALL SELECT 'station', c_acctbal, c_custkey::DOUBLE FROM customer)
SELECT role, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM p GROUP BY role""")
def geometry_merge_bounds(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").selectExpr("'source' AS role", "s_acctbal AS x", "double(s_suppkey) AS y")
    stations_ = table(spark, sf_dir, "customer").selectExpr("'station' AS role", "c_acctbal AS x", "double(c_custkey) AS y")
    return survey.bounds(survey.merged(sources, stations_), ["role"])


@query(f"WITH {EV} SELECT line, count(*) AS n FROM ev WHERE upper(line) IN ('CLICK', 'PURCHASE', 'VIEW') GROUP BY line")
def require_status(spark, sf_dir):
    return survey.with_status(events(spark, sf_dir), "line", ["click", "purchase", "view"]).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, f AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY station ORDER BY seq))
SELECT station, seq, round(sqrt((x - x0) ** 2 + (y - y0) ** 2), 6) AS distance FROM f WHERE k > 1""")
def duplicates_first(spark, sf_dir):
    return r6(survey.revisits(events(spark, sf_dir), "station", "seq", "x", "y"), "distance")


@query("""WITH p AS (SELECT c_custkey AS seq, c_nationkey AS name, (c_custkey * 37 % 1000)::DOUBLE AS x, (c_custkey * 91 % 1009)::DOUBLE AS y FROM customer)
SELECT a.seq AS seq1, b.seq AS seq2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.seq < b.seq AND a.name <> b.name AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 12""")
def coincident_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey AS seq", "c_nationkey AS name", "double(c_custkey * 37 % 1000) AS x", "double(c_custkey * 91 % 1009) AS y")
    return r6(joins.proximity_pairs(p, "seq", "x", "y", 12.0, differ="name"), "distance")


@query(f"WITH {EV} SELECT station, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(stddev_samp(value), 6) AS std, count(*) AS n FROM ev GROUP BY station")
def mean_positions(spark, sf_dir):
    return r6(survey.mean_positions(events(spark, sf_dir), "station", "x", "y", "value"), "x", "y", "std")


OCC = "occ AS (SELECT seq AS w, station AS name, t - 30 AS t0, t + 60 AS t1 FROM ev WHERE seq % 7 = 0)"
MATCH = "m AS (SELECT ev.seq, min(w) AS w FROM ev LEFT JOIN occ ON t BETWEEN t0 - 90 AND t1 + 90 GROUP BY ev.seq)"


def matched(spark, sf_dir):
    e = events(spark, sf_dir)
    occ = e.where("seq % 7 = 0").selectExpr("seq AS w", "station AS name", "t - 30 AS t0", "t + 60 AS t1")
    return joins.interval_match(e, occ, "t", "t0", "t1", "w", width=300.0, tolerance=90.0, point_key="seq")


@query(f"WITH {EV}, {OCC}, {MATCH} SELECT seq, w FROM m")
def match_occupations(spark, sf_dir):
    return matched(spark, sf_dir).select("seq", "w")


@query(f"WITH {EV}, {OCC}, {MATCH} SELECT m.seq, ev.station = occ.name AS name_agrees FROM m JOIN ev USING (seq) LEFT JOIN occ USING (w)")
def name_agrees(spark, sf_dir):
    return matched(spark, sf_dir).select("seq", (F.col("station") == F.col("name")).alias("name_agrees"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)")
def attach_missing(spark, sf_dir):
    return survey.unmatched(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "supplier"), "s_suppkey")


@query("""SELECT s_suppkey, round(10 + s_suppkey * 1e-5 + (10.00002 - 10), 9) AS longitude, round(45 + s_nationkey * 1e-4 + (44.99997 - 45), 9) AS latitude, round(s_acctbal + (101.25 - 100), 6) AS height FROM supplier""")
def base_shift(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "10 + s_suppkey * 1e-5D AS longitude", "45 + s_nationkey * 1e-4D AS latitude", "s_acctbal AS height", "10D AS base_longitude", "45D AS base_latitude", "100D AS base_height")
    out = survey.base_shifted(s, (10.00002, 44.99997, 101.25))
    return r6(out.select("s_suppkey", F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"), "height"), "height")


def drift_sql(x: str) -> str:
    return f"""WITH {EV}, knots AS (SELECT {x} AS x0, value AS y0, lead({x}) OVER (ORDER BY {x}) AS x1, lead(value) OVER (ORDER BY {x}) AS y1 FROM ev WHERE station = 1),
e AS (SELECT min(x0) AS lo, max(x0) AS hi, arg_min(y0, x0) AS ylo, arg_max(y0, x0) AS yhi FROM knots)
SELECT seq, round(value - (CASE WHEN {x} <= lo THEN ylo WHEN {x} >= hi THEN yhi ELSE y0 + (y1 - y0) * ({x} - x0) / (x1 - x0) END - ylo), 6) AS corrected
FROM ev CROSS JOIN e LEFT JOIN knots ON {x} >= x0 AND {x} < x1"""


@query(drift_sql("t"))
def diurnal_time(spark, sf_dir):
    e = events(spark, sf_dir)
    return r6(stations.drift_corrected(e, e.where("station = 1"), "t", "value", 40000.0).select("seq", "corrected"), "corrected")


@query(drift_sql("seq"))
def diurnal_order(spark, sf_dir):
    e = events(spark, sf_dir)
    return r6(stations.drift_corrected(e, e.where("station = 1"), "seq", "value", 150.0).select("seq", "corrected"), "corrected")


@query(f"""WITH {EV}, c AS (SELECT seq, station, t - floor(t / 86400) * 86400 AS s FROM ev), b AS (SELECT *, CASE WHEN s < lag(s) OVER (PARTITION BY station ORDER BY seq) THEN 1 ELSE 0 END AS k FROM c)
SELECT seq, (sum(k) OVER (PARTITION BY station ORDER BY seq))::BIGINT AS day FROM b""")
def midnight_rollover(spark, sf_dir):
    c = events(spark, sf_dir).withColumn("s", F.col("t") - F.floor(F.col("t") / 86400) * 86400)
    return stations.midnight_rollover(c, "station", "seq", "s").select("seq", F.col("day").cast("long").alias("day"))


SESSION = """g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY station ORDER BY t) > 21600 THEN 1 ELSE 0 END AS k FROM ev),
s AS (SELECT *, (sum(k) OVER (PARTITION BY station ORDER BY t))::BIGINT AS session FROM g)"""


@query(f"""WITH {EV}, {SESSION} SELECT station, session, count(*) AS files, string_agg(DISTINCT line, ',' ORDER BY line) AS nodes, min(t) AS "first", max(t) AS "last" FROM s GROUP BY station, session""")
def group_deployments(spark, sf_dir):
    d = records.deployments(events(spark, sf_dir), "station", "t", "line", 21600.0)
    return d.withColumn("session", F.col("session").cast("long"))


@query(f"""WITH {EV}, v AS (SELECT line, t, CASE WHEN value > 50 THEN value END AS value FROM ev)
SELECT line, round(avg((value IS NOT NULL)::INT), 6) AS coverage, count(value) AS n, min(t) FILTER (WHERE value IS NOT NULL) AS "first", max(t) FILTER (WHERE value IS NOT NULL) AS "last", round(stddev_pop(value), 6) AS std, round(max(abs(value)), 6) AS largest FROM v GROUP BY line""")
def node_coverage(spark, sf_dir):
    v = events(spark, sf_dir).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return r6(records.coverage(v, "line", "t", "value"), "coverage", "std", "largest")


@query(f"""WITH {EV}, n AS (SELECT count(DISTINCT line) AS k FROM ev), f AS (SELECT floor(t / 3600)::BIGINT AS h FROM ev GROUP BY h HAVING count(DISTINCT line) = (SELECT k FROM n)),
i AS (SELECT h, h - row_number() OVER (ORDER BY h) AS g FROM f)
SELECT min(h) AS "first", max(h) AS "last", count(*) AS length FROM i GROUP BY g ORDER BY length DESC, "first" LIMIT 1""")
def common_window(spark, sf_dir):
    return records.common_window(events(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600)), "h", "line")


@query(f"""WITH {EV}, {SESSION}, d AS (SELECT station, session, min(t) AS t0, max(t) AS t1 FROM s GROUP BY station, session), l AS (SELECT DISTINCT floor(t / 86400)::BIGINT AS day FROM ev)
SELECT station, session, day FROM d JOIN l ON t1 > day * 86400 + 28800 AND t0 < day * 86400 + 64800""")
def layout_overlap(spark, sf_dir):
    e = events(spark, sf_dir)
    d = records.deployments(e, "station", "t", "line", 21600.0).select("station", F.col("session").cast("long").alias("session"), F.col("first").alias("t0"), F.col("last").alias("t1"))
    l = e.select(F.floor(F.col("t") / 86400).alias("day")).distinct().selectExpr("day", "day * 86400 + 28800D AS u0", "day * 86400 + 64800D AS u1")
    return joins.overlap_join(d, l, ("t0", "t1"), ("u0", "u1"), 43200.0).select("station", "session", "day")


@query(f"""WITH {EV}, m AS (SELECT station, quantile_cont(value, 0.5) AS median FROM ev GROUP BY station)
SELECT station, round(median, 6) AS median, round(1.4826 * quantile_cont(abs(value - median), 0.5), 6) AS scatter FROM ev JOIN m USING (station) GROUP BY station, median""")
def gps_scatter_mad(spark, sf_dir):
    return r6(stations.median_and_mad(events(spark, sf_dir), "station", "value"), "median", "scatter")


@query(f"""WITH {EV}, d AS (SELECT line, value, value - lag(value) OVER (PARTITION BY line, station ORDER BY seq) AS d FROM ev),
m AS (SELECT line, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS spread, quantile_cont(d, 0.5) AS m FROM d GROUP BY line)
SELECT line, round(median, 6) AS median, round(spread, 6) AS spread, round(1.4826 * quantile_cont(abs(d - m), 0.5) / sqrt(2), 6) AS noise FROM d JOIN m USING (line) GROUP BY line, median, spread""")
def noise_table(spark, sf_dir):
    return r6(stations.noise(events(spark, sf_dir), "station", "line", "seq", "value"), "median", "spread", "noise")


@query(f"""WITH {EV}, r AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS running, value - lag(value) OVER (ORDER BY line, seq) AS d FROM ev),
m AS (SELECT quantile_cont(d, 0.5) AS m FROM r), s AS (SELECT 1.4826 * quantile_cont(abs(d - m), 0.5) / sqrt(2) AS sigma FROM r, m)
SELECT seq, round(running, 6) AS running, abs(value - running) > 1.5 * sigma AS spike FROM r, s""")
def despike(spark, sf_dir):
    return r6(stations.despike(events(spark, sf_dir), "line", "seq", "value", threshold=1.5).select("seq", "running", "spike"), "running")


@query(f"""WITH {EV}, l AS (SELECT line, quantile_cont(value, 0.5) AS l FROM ev GROUP BY line), g AS (SELECT quantile_cont(value, 0.5) AS g FROM ev)
SELECT seq, round(value - (l - g), 6) AS levelled FROM ev JOIN l USING (line), g""")
def level_lines(spark, sf_dir):
    return r6(stations.level_lines(events(spark, sf_dir), "line", "value").select("seq", "levelled"), "levelled")


@query(f"""WITH {EV}, m AS (SELECT line, quantile_cont(value, 0.5) FILTER (WHERE station % 2 = 0) AS f, quantile_cont(value, 0.5) FILTER (WHERE station % 2 <> 0) AS r FROM ev GROUP BY line)
SELECT line, round(f, 6) AS forward, round(r, 6) AS reverse, round(f - r, 6) AS difference FROM m""")
def heading_check(spark, sf_dir):
    return r6(stations.heading_medians(events(spark, sf_dir), "line", F.col("station") % 2 == 0, "value"), "forward", "reverse", "difference")


STEP = "st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM ev WINDOW w AS (PARTITION BY station ORDER BY seq))"


@query(f"""WITH {EV}, {STEP}, a AS (SELECT station, count(*) AS samples, max(t) - min(t) AS duration, coalesce(sum(step), 0) AS length, quantile_cont(step, 0.5) AS median_step FROM st GROUP BY station)
SELECT station, samples, round(duration, 6) AS duration, round(length, 6) AS length, round(median_step, 6) AS median_step, CASE WHEN duration > 0 THEN round(length / duration, 9) END AS speed FROM a""")
def track_summary(spark, sf_dir):
    out = stations.track_summary(events(spark, sf_dir), "station", "seq", "x", "y", "t").withColumn("speed", F.round("speed", 9))
    return r6(out, "duration", "length", "median_step")


@query(f"WITH {EV}, {STEP} SELECT seq, round(sum(coalesce(step, 0)) OVER (PARTITION BY station ORDER BY seq), 6) AS distance FROM st")
def add_distance_path(spark, sf_dir):
    return r6(stations.path_distance(events(spark, sf_dir), "station", "seq", "x", "y").select("seq", "distance"), "distance")


@query(f"""WITH {EV}, f AS (SELECT station, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS a, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1 FROM ev GROUP BY station),
u AS (SELECT *, cos(a) * s AS ux, sin(a) * s AS uy FROM (SELECT *, CASE WHEN (x1 - x0) * cos(a) + (y1 - y0) * sin(a) < 0 THEN -1.0 ELSE 1.0 END AS s FROM f))
SELECT seq, round((x - x0) * ux + (y - y0) * uy, 6) AS along, round((x - mx) * uy - (y - my) * ux, 6) AS "offset" FROM ev JOIN u USING (station)""")
def add_distance_line(spark, sf_dir):
    return r6(stations.line_distance(events(spark, sf_dir), "station", "seq", "x", "y").select("seq", "along", "offset"), "along", "offset")


@query(f"WITH {EV}, h AS (SELECT *, radians(station % 360) AS h FROM ev) SELECT seq, round(x - (1.5 * sin(h) + 0.5 * cos(h)), 6) AS sensor_x, round(y - (1.5 * cos(h) - 0.5 * sin(h)), 6) AS sensor_y FROM h")
def gps_layback(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("heading", F.col("station") % 360)
    return r6(stations.layback(e, "x", "y", "heading", 1.5, 0.5).select("seq", "sensor_x", "sensor_y"), "sensor_x", "sensor_y")


@query(f"""WITH {EV}, z AS (SELECT seq, value, (seq % 30) / 20.0 / 1.66 AS z FROM ev)
SELECT seq, round(1000 * value * 1e-6 * 4 / (2 * pi() * 18030 * 4e-7 * pi() * 1.66 * 1.66 / sqrt(4 * z * z + 1)), 6) AS hcp, round(1000 * value * 1e-6 * 4 / (2 * pi() * 18030 * 4e-7 * pi() * 1.66 * 1.66 * (sqrt(4 * z * z + 1) - 2 * z)), 6) AS vcp FROM z""")
def lin_conductivity(spark, sf_dir):
    e, h = events(spark, sf_dir), F.col("seq") % 30 / 20.0
    return e.select("seq", *[F.round(1000 * scalar.lin_conductivity(F.col("value"), 18030.0, 1.66, h, o), 6).alias(o.lower()) for o in ("HCP", "VCP")])


@query(f"WITH {EV} SELECT station, arg_min(line, seq) AS line, round(avg(value), 6) AS value, max(y) AS y, count(*) AS occupations FROM ev GROUP BY station")
def per_station_collapse(spark, sf_dir):
    return r6(stations.collapse_repeats(events(spark, sf_dir), "station", "seq", ["line"], ["value"], ["y"]), "value")


@query(f"WITH {EV} SELECT seq, round(value - (SELECT quantile_cont(value, 0.5) FROM ev), 6) AS anomaly FROM ev")
def remove_regional(spark, sf_dir):
    return r6(stations.remove_regional(events(spark, sf_dir), "value").select("seq", "anomaly"), "anomaly")


@query(f"WITH {EV} SELECT station, coalesce(stddev_samp(value) > 30, false) AS noisy FROM ev GROUP BY station")
def flag_noisy(spark, sf_dir):
    return stations.flag_noisy(stations.station_means(events(spark, sf_dir), "station", "value"), "std", 30.0).select("station", "noisy")


READING = """rd AS (SELECT l_orderkey * 10 + l_linenumber AS reading, l_suppkey AS line, s + d AS a, CASE WHEN l_quantity % 13 = 0 THEN NULL ELSE s END AS b, s + d + k * d AS m, s + 2 * d + k * d AS n
FROM (SELECT *, l_partkey % 40 AS s, l_linenumber % 3 + 1 AS d, l_orderkey % 6 + 1 AS k FROM lineitem))"""
ELECTRODES = 64


def readings(spark, sf_dir) -> DataFrame:
    """A dipole-dipole reading of each line item, on a line per supplier; some with a remote electrode."""
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS reading", "l_suppkey AS line", "l_quantity", "l_partkey % 40 AS s", "bigint(l_linenumber % 3 + 1) AS d", "l_orderkey % 6 + 1 AS k")
    return l.selectExpr("reading", "line", "s + d AS a", "CASE WHEN l_quantity % 13 <> 0 THEN s END AS b", "s + d + k * d AS m", "s + 2 * d + k * d AS n")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query("""WITH l AS (SELECT s_suppkey AS line, 12 + s_nationkey AS e, s_suppkey % 6 + 1 AS k, s_suppkey % 3 + 1 AS d FROM supplier)
SELECT line, (s + y.d)::BIGINT AS a, s::BIGINT AS b, (s + y.d + z.k * y.d)::BIGINT AS m, (s + 2 * y.d + z.k * y.d)::BIGINT AS n FROM l, range(40) x(s), range(1, 4) y(d), range(1, 7) z(k) WHERE y.d <= l.d AND z.k <= l.k AND s + 2 * y.d + z.k * y.d < e""")
def dipole_dipole_scheme(spark, sf_dir):
    """A scheme for each supplier's line, of its own size and reach."""
    l = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line", "12 + s_nationkey AS e", "s_suppkey % 6 + 1 AS k", "s_suppkey % 3 + 1 AS d")
    return longs(resistivity.dipole_dipole_lines(l, "e", "k", "d", ["line"]), *"abmn")


DIST = "di AS (SELECT reading, a, b, m, n, abs(a - m) * 2.0 AS am, abs(b - m) * 2.0 AS bm, abs(a - n) * 2.0 AS an, abs(b - n) * 2.0 AS bn FROM rd)"


@query(f"""WITH {READING}, {DIST}, t AS (SELECT *, coalesce(1 / am, 0) - coalesce(1 / bm, 0) - coalesce(1 / an, 0) + coalesce(1 / bn, 0) AS s FROM di)
SELECT reading, round(2 * pi() / s, 5) AS k, round(2.0 * (a + coalesce(b, 0) + m + n) / CASE WHEN b IS NULL THEN 3 ELSE 4 END, 6) AS x FROM t""")
def geometric_factor(spark, sf_dir):
    return resistivity.with_geometry(readings(spark, sf_dir), 2.0).select("reading", F.round("k", 5).alias("k"), F.round("x", 6).alias("x"))


@query(f"""WITH RECURSIVE {READING}, {DIST}, t AS (SELECT *, coalesce(1 / am, 0) - coalesce(1 / bm, 0) - coalesce(1 / an, 0) + coalesce(1 / bn, 0) AS s FROM di),
f AS (SELECT reading, am, bm, an, bn, s, 0 AS i, 0.0::DOUBLE AS lo, (10 * greatest(am, coalesce(bm, 0), an, coalesce(bn, 0)))::DOUBLE AS hi FROM t
 UNION ALL SELECT reading, am, bm, an, bn, s, i + 1, CASE WHEN q < 0.5 THEN mid ELSE lo END, CASE WHEN q < 0.5 THEN hi ELSE mid END FROM (
  SELECT *, (coalesce(1 / am - 1 / sqrt(am * am + 4 * mid * mid), 0) - coalesce(1 / bm - 1 / sqrt(bm * bm + 4 * mid * mid), 0) - coalesce(1 / an - 1 / sqrt(an * an + 4 * mid * mid), 0) + coalesce(1 / bn - 1 / sqrt(bn * bn + 4 * mid * mid), 0)) / s AS q
  FROM (SELECT *, (lo + hi) / 2 AS mid FROM f WHERE i < 60)))
SELECT reading, round((lo + hi) / 2, 6) AS depth FROM f WHERE i = 60""")
def median_depth(spark, sf_dir):
    return r6(resistivity.with_geometry(readings(spark, sf_dir), 2.0).select("reading", "depth"), "depth")


CONF = "cf AS (SELECT line, least(a, b, m, n) AS st, a - least(a, b, m, n) AS oa, b - least(a, b, m, n) AS ob, m - least(a, b, m, n) AS om, n - least(a, b, m, n) AS o_n FROM rd)"


@query(f"""WITH {READING}, {CONF}, g AS (SELECT line, oa || '-' || coalesce(ob::VARCHAR, 'R') || '-' || om || '-' || o_n AS code, greatest(oa, coalesce(ob, 0), om, o_n) AS reach, count(DISTINCT st) AS measured FROM cf GROUP BY ALL)
SELECT line, code, measured, greatest({ELECTRODES} - reach, 0)::BIGINT AS possible, (greatest({ELECTRODES} - reach, 0) - measured)::BIGINT AS missing FROM g""")
def ert_coverage(spark, sf_dir):
    return resistivity.coverage(readings(spark, sf_dir), ELECTRODES, ["line"])


@query(f"""WITH {READING}, {CONF}, c AS (SELECT DISTINCT line, oa, ob, om, o_n FROM cf), e AS (SELECT line, oa, ob, om, o_n, s AS st FROM c, range({ELECTRODES}) x(s) WHERE s + greatest(oa, coalesce(ob, 0), om, o_n) < {ELECTRODES}),
g AS (SELECT * FROM e EXCEPT SELECT line, oa, ob, om, o_n, st FROM cf)
SELECT line, (st + oa)::BIGINT AS a, (st + ob)::BIGINT AS b, (st + om)::BIGINT AS m, (st + o_n)::BIGINT AS n FROM g""")
def ert_missing(spark, sf_dir):
    return resistivity.missing(readings(spark, sf_dir), ELECTRODES, ["line"])


@query(f"WITH {READING} SELECT reading, (a - 8)::BIGINT AS a, (b - 8)::BIGINT AS b, (m - 8)::BIGINT AS m, (n - 8)::BIGINT AS n FROM rd WHERE a BETWEEN 8 AND 27 AND (b IS NULL OR b BETWEEN 8 AND 27) AND m BETWEEN 8 AND 27 AND n BETWEEN 8 AND 27")
def ert_trim(spark, sf_dir):
    return resistivity.trim(readings(spark, sf_dir), 8, 20).drop("line")


@query("""SELECT l_suppkey % 25 AS a, l_linenumber AS b, l_returnflag AS m, l_linestatus AS n, round(exp(avg(ln(l_extendedprice))), 6) AS geometric, count(*) AS count, round(stddev_samp(ln(l_extendedprice)), 6) AS std_ln, round(avg(l_extendedprice), 8) AS mean,
round(quantile_cont(l_extendedprice, 0.5), 6) AS median, min(l_extendedprice) AS least FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL""")
def crp_group(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 25 AS a", "l_linenumber AS b", "l_returnflag AS m", "l_linestatus AS n", "l_extendedprice")
    out = resistivity.grouped(l.withColumnRenamed("n", "q"), ["a", "b", "m", "q"], "l_extendedprice").withColumnRenamed("n", "count").withColumnRenamed("q", "n")
    return r6(out, "geometric", "std_ln", "median").withColumn("mean", F.round("mean", 8))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS i, l_orderkey // 100 AS line, l_suppkey % 60 AS s, l_partkey % 60 AS r, l_quantity / 1000 AS t, l_orderkey::VARCHAR AS shot FROM lineitem WHERE l_suppkey % 60 <> l_partkey % 60)
SELECT x.i, y.i AS j, x.shot AS shot_ab, y.shot AS shot_ba, x.s::DOUBLE AS x_a, x.r::DOUBLE AS x_b, abs(x.r - x.s)::DOUBLE AS "offset", round(x.t, 6) AS t_ab, round(y.t, 6) AS t_ba, round(x.t - y.t, 6) AS dt FROM t x JOIN t y ON x.line = y.line AND x.s = y.r AND x.r = y.s AND x.i < y.i""")
def reciprocity(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS i", "l_orderkey div 100 AS line", "l_orderkey AS shot", "double(l_suppkey % 60) AS s", "double(l_partkey % 60) AS r", "l_quantity / 1000 AS t")
    return r6(seismic.reciprocity(l, "i", "s", "r", "t", 1.0, "shot", "line"), "t_ab", "t_ba", "dt")


@query("""WITH u AS (SELECT l_quantity AS d, l_orderkey * 10 + l_linenumber AS k, l_quantity / l_tax AS v FROM lineitem WHERE l_quantity > 0 AND l_tax > 0),
r AS (SELECT v, row_number() OVER (ORDER BY d, k) AS a, row_number() OVER (ORDER BY d DESC, k DESC) AS z, greatest(3, count(*) OVER () // 10) AS n FROM u),
m AS (SELECT quantile_cont(v, 0.5) FILTER (WHERE a <= n) AS v_top, quantile_cont(v, 0.5) FILTER (WHERE z <= n) AS v_far FROM r)
SELECT round(v_top, 6) AS v_top, round(greatest(1.1 * v_far, 1.5 * v_top), 6) AS v_bottom FROM m""")
def apparent_gradient(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return r6(seismic.apparent_gradient(l, "k", "l_quantity", "l_tax"), "v_top", "v_bottom")


LAYERS = "la AS (SELECT s_suppkey AS model, i AS layer, 300.0 * (i + 1) + s_suppkey * 3 + CASE WHEN i = 2 THEN s_nationkey * 20 ELSE 0 END AS v, 2.0 + i * 3 + s_nationkey * 0.1 AS h FROM supplier, unnest(range(4)) t(i))"
INTERCEPT = """ic AS (SELECT l.model, l.layer, l.v, CASE WHEN l.layer = 0 THEN 0.0 WHEN bool_and(l.v > u.v) THEN sum(2 * u.h * sqrt(greatest(l.v * l.v - u.v * u.v, 0)) / (u.v * l.v)) END AS intercept
FROM la l LEFT JOIN la u ON u.model = l.model AND u.layer < l.layer GROUP BY l.model, l.layer, l.v)"""


def layers(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("layer"))
    return s.selectExpr("s_suppkey AS model", "layer", "300D * (layer + 1) + s_suppkey * 3 + CASE WHEN layer = 2 THEN s_nationkey * 20 ELSE 0 END AS v", "2D + layer * 3 + s_nationkey * 0.1D AS h")


@query(f"WITH {LAYERS}, {INTERCEPT} SELECT model, layer, round(intercept, 9) AS intercept FROM ic")
def intercept_times(spark, sf_dir):
    return seismic.intercept_times(layers(spark, sf_dir)).select("model", "layer", F.round("intercept", 9).alias("intercept"))


@query(f"WITH {LAYERS}, {INTERCEPT} SELECT model, x * 4.0::DOUBLE AS \"offset\", round(min(intercept + x * 4.0 / v), 9) AS time FROM ic, range(20) t(x) WHERE intercept IS NOT NULL GROUP BY model, x")
def traveltimes_min(spark, sf_dir):
    l = layers(spark, sf_dir)
    at = l.select("model").distinct().select("model", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i * F.lit(4.0))).alias("offset"))
    return seismic.first_arrivals(l, at).select("model", "offset", F.round("time", 9).alias("time"))


FIT = "pk AS (SELECT s_suppkey AS shot, x * 4.0::DOUBLE AS x, least(x * 4.0 / (300 + s_suppkey), 0.02 + s_nationkey * 0.001 + x * 4.0 / (1200 + s_suppkey * 2)) + ((x * 7 + s_suppkey) % 5) * 0.0001 AS t FROM supplier, range(1, 25) q(x))"


@query(f"""WITH {FIT}, s AS (SELECT a.shot, a.x AS cut_x, b.x, b.t, b.x <= a.x AS near FROM pk a JOIN pk b USING (shot)),
g AS (SELECT shot, cut_x, count(*) FILTER (WHERE near) AS n1, sum(x * x) FILTER (WHERE near) AS xx1, sum(x * t) FILTER (WHERE near) AS xt1, sum(t * t) FILTER (WHERE near) AS tt1, count(*) FILTER (WHERE NOT near) AS n2, sum(x) FILTER (WHERE NOT near) AS x2, sum(t) FILTER (WHERE NOT near) AS t2,
 sum(x * x) FILTER (WHERE NOT near) AS xx2, sum(x * t) FILTER (WHERE NOT near) AS xt2, sum(t * t) FILTER (WHERE NOT near) AS tt2 FROM s GROUP BY shot, cut_x),
p AS (SELECT *, xt1 / xx1 AS p1, (n2 * xt2 - x2 * t2) / (n2 * xx2 - x2 * x2) AS p2 FROM g WHERE n1 >= 2 AND n2 >= 2), i AS (SELECT *, (t2 - p2 * x2) / n2 AS i2 FROM p),
e AS (SELECT *, round(tt1 - p1 * xt1 + tt2 - p2 * xt2 - i2 * t2, 9) AS sse FROM i WHERE p1 > 0 AND p2 > 0 AND p2 < p1 AND i2 > 0), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY shot ORDER BY sse, n1) = 1)
SELECT shot, n1 AS cut, round(1 / p1, 4) AS v1, round(1 / p2, 4) AS v2, round(i2 / p1 / p2 / (2 * sqrt(1 / p2 / p2 - 1 / p1 / p1)), 4) AS depth FROM b""")
def fit_layers_2(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shot"), "s_nationkey", F.explode(F.sequence(F.lit(1), F.lit(24)).cast("array<bigint>")).alias("i"))
    p = s.selectExpr("shot", "i * 4D AS x", "least(i * 4D / (300 + shot), 0.02D + s_nationkey * 0.001D + i * 4D / (1200 + shot * 2)) + ((i * 7 + shot) % 5) * 0.0001D AS t")
    out = seismic.fit_two_layers(p, "shot", "x", "t").drop("sse")
    return out.withColumns({c: F.round(c, 4) for c in ("v1", "v2", "depth")})


PRISM = "pr AS (SELECT p.s_suppkey AS station, q.p_partkey AS cell, (q.p_partkey % 40) * 2.5 - p.s_suppkey AS x0, (q.p_partkey % 40) * 2.5 - p.s_suppkey + 2.5 AS x1, 1.0 + q.p_size AS z0, 3.5 + q.p_size AS z1 FROM supplier p, part q)"


def _sum_over_parts(spark, sf_dir, prism) -> DataFrame:
    """(station, s): sum over all parts as cells."""
    cells = table(spark, sf_dir, "part").selectExpr("p_partkey AS cell", "p_partkey % 40 * 2.5D AS x0", "p_partkey % 40 * 2.5D + 2.5D AS x1", "p_size + 1D AS z0", "p_size + 3.5D AS z1")
    at = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS station", "double(s_suppkey) AS x", "0D AS z")
    return potential.effect(at, cells, "station", "x", "z", prism).withColumnRenamed("value", "s")


def _corner(f: str) -> str:
    at = lambda x, z: f.replace("X", x).replace("Z", z)
    return f"({at('x1', 'z1')}) - ({at('x0', 'z1')}) - ({at('x1', 'z0')}) + ({at('x0', 'z0')})"


@query(f"WITH {PRISM} SELECT station, round(sum(200 * 2 * 6.674e-11 * 1e5 * ({_corner('X / 2 * ln(X * X + Z * Z) + Z * atan2(X, Z)')})), 9) AS gz FROM pr GROUP BY station")
def gravity_kernel(spark, sf_dir):
    return _sum_over_parts(spark, sf_dir, scalar.gravity_prism).select("station", F.round(200 * F.col("s"), 9).alias("gz"))


_C, _S = math.cos(math.radians(60)), math.sin(math.radians(60))


@query(f"WITH {PRISM} SELECT station, round(sum(0.01 * 50000 / (2 * pi()) * ({_S * _S - _C * _C!r} * ({_corner('atan2(X, Z)')}) + {2 * _S * _C!r} * ({_corner('ln(X * X + Z * Z) / 2')}))), 6) AS field FROM pr GROUP BY station")
def magnetic_kernel(spark, sf_dir):
    return _sum_over_parts(spark, sf_dir, lambda *d: scalar.magnetic_prism(*d, 60.0, 50000.0)).select("station", F.round(0.01 * F.col("s"), 6).alias("field"))


@query("""SELECT p_partkey AS cell, round(greatest(0, least(i * 2.0 + 2, 23.5) - greatest(i * 2.0, 5.5)) * greatest(0, least(j * 1.0 + 1, 7.25) - greatest(j * 1.0, 2.5)) / 2, 6) AS overlap FROM (SELECT p_partkey, p_partkey % 20 AS i, p_size % 10 AS j FROM part)""")
def mesh_rectangle(spark, sf_dir):
    cells = table(spark, sf_dir, "part").selectExpr("p_partkey AS cell", "p_partkey % 20 * 2D AS x0", "p_size % 10 * 1D AS z0")
    share = survey.rectangle_share(F.col("x0"), F.col("x0") + 2, F.col("z0"), F.col("z0") + 1, (5.5, 23.5, 2.5, 7.25))
    return cells.select("cell", F.round(share, 6).alias("overlap"))


@query("""WITH p AS (SELECT s_suppkey AS i, s_nationkey AS array, (s_suppkey * 17 % 101)::DOUBLE AS x, (s_suppkey * 29 % 97)::DOUBLE AS y FROM supplier)
SELECT a.array, a.i, b.i AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS separation FROM p a JOIN p b ON a.array = b.array AND a.i < b.i""")
def array_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS i", "s_nationkey AS array", "double(s_suppkey * 17 % 101) AS x", "double(s_suppkey * 29 % 97) AS y")
    rounded = F.floor(F.col("r") * 1e6 + 0.5) / 1e6  # as F.round for these distances, without a decimal for each of the pairs
    return passive.separations(p, "i", "x", "y", "array").select("array", "i", "j", rounded.alias("separation"))


HOURLY = "hr AS (SELECT line, floor(t / 3600)::BIGINT AS i, avg(value) AS value FROM ev GROUP BY line, i)"


def hourly(spark, sf_dir) -> DataFrame:
    """A sample per line and hour with events."""
    return events(spark, sf_dir).groupBy("line", F.floor(F.col("t") / 3600).alias("i")).agg(F.avg("value").alias("value"))


@query(f"""WITH {EV}, {HOURLY}, s AS (SELECT line, i // 6 AS w, stddev_pop(value) AS s FROM hr GROUP BY line, w HAVING count(value) >= 6), o AS (SELECT line, quantile_cont(s, 0.5) AS m FROM s GROUP BY line)
SELECT w, round(min(s / CASE WHEN m > 0 THEN m ELSE 1 END), 6) AS score, count(*) AS nodes FROM s JOIN o USING (line) GROUP BY w HAVING count(*) = (SELECT count(DISTINCT line) FROM ev) AND min(s / CASE WHEN m > 0 THEN m ELSE 1 END) >= 0.5""")
def tumbling_events(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("w", F.expr("i div 6"))
    return r6(records.tumbling_events(h, "line", "w", "value", 0.5, whole=6), "score")


@query(f"""WITH {EV}, {HOURLY}, w AS (SELECT line, value, unnest([i // 6 * 6, i // 6 * 6 - 6]) AS start FROM hr), r AS (SELECT line, start, stddev_pop(value) AS s FROM w GROUP BY line, start HAVING count(value) = 12),
f AS (SELECT start FROM r GROUP BY start HAVING count(*) = (SELECT count(DISTINCT line) FROM ev) AND min(s) > 0), m AS (SELECT line, quantile_cont(s, 0.5) AS m FROM r WHERE start IN (SELECT start FROM f) GROUP BY line)
SELECT start, count(*) AS nodes, round(avg(s), 6) AS rms FROM r JOIN m USING (line) WHERE start IN (SELECT start FROM f) GROUP BY start HAVING bool_and(s > 0.4 * m AND s < 1.8 * m)""")
def sliding_gate(spark, sf_dir):
    return r6(records.sliding_gate(hourly(spark, sf_dir), "line", "i", "value", 12, 0.4, 1.8), "rms")


TRACE = "tr AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"""WITH {TRACE}, e AS (SELECT vec_id, i, sum(v * v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS t, count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ct, sum(v * v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS l, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS cl FROM tr WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
r AS (SELECT vec_id, i, l / (t + 1e-9 * max(t + l) OVER (PARTITION BY vec_id) + 1e-30) AS r FROM e WHERE ct = 5 AND cl = 5)
SELECT vec_id, arg_min(i, (-round(r, 9), i))::INT AS pick, round(max(r), 6) AS ratio FROM r GROUP BY vec_id""")
def energy_ratio(spark, sf_dir):
    return r6(seismic.energy_ratio(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5), "ratio")


@query(f"""WITH {TRACE}, e AS (SELECT vec_id, i, avg(v * v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / (avg(v * v) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 1e-30) AS r FROM tr WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, min(CASE WHEN r >= 1.5 THEN i END)::INT AS pick, round(max(r), 6) AS most FROM e WHERE i >= 2 GROUP BY vec_id""")
def sta_lta(spark, sf_dir):
    return r6(seismic.sta_lta(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, 20, 1.5), "most")


@query(f"""WITH {TRACE}, e AS (SELECT vec_id, i + 1 AS k, 64 AS n, greatest(var_pop(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-30) AS a, greatest(var_pop(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1e-30) AS b FROM tr)
SELECT vec_id, arg_min(k, (round(k * ln(a) + (n - k - 1) * ln(b), 6), k))::INT AS pick FROM e WHERE k <= n - 2 GROUP BY vec_id""")
def aic_pick(spark, sf_dir):
    return seismic.aic_pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


IMAGE = f"""{TRACE}, sh AS (SELECT vec_id, vec_id // 12 AS shot, (vec_id % 12) * 2.0 + 3 AS x FROM embeddings), sp AS (SELECT shot, x, f, sum(v * cos(2 * pi() * f * 0.002 * i)) AS re, -sum(v * sin(2 * pi() * f * 0.002 * i)) AS im FROM tr JOIN sh USING (vec_id), (VALUES (15.0), (30.0), (45.0), (60.0)) q(f) GROUP BY shot, x, f),
un AS (SELECT shot, x, f, CASE WHEN re * re + im * im > 0 THEN re / sqrt(re * re + im * im) ELSE 0 END AS ur, CASE WHEN re * re + im * im > 0 THEN im / sqrt(re * re + im * im) ELSE 0 END AS ui FROM sp),
su AS (SELECT shot, f, c, sum(ur * cos(2 * pi() * f / c * x) - ui * sin(2 * pi() * f / c * x)) AS r, sum(ur * sin(2 * pi() * f / c * x) + ui * cos(2 * pi() * f / c * x)) AS i, count(*) AS n FROM un, (VALUES (100.0), (150.0), (200.0), (250.0), (300.0), (400.0)) z(c) GROUP BY shot, f, c),
im AS (SELECT shot, f::DOUBLE AS f, c::DOUBLE AS c, sqrt(r * r + i * i) / n AS energy FROM su)"""


def image(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 12 AS shot", "(vec_id % 12) * 2D + 3 AS x", "embedding")
    return seismic.dispersion_image(e, "shot", "x", "embedding", 0.002, [15, 30, 45, 60], [100, 150, 200, 250, 300, 400])


@query(f"WITH {IMAGE} SELECT shot, f, c, round(energy, 6) AS energy FROM im")
def phase_shift_dft(spark, sf_dir):
    return r6(image(spark, sf_dir), "energy")


@query(f"WITH {IMAGE} SELECT shot, f, arg_min(c, (-round(energy, 9), c)) AS velocity, round(max(energy), 6) AS energy FROM im GROUP BY shot, f")
def dispersion_pick_max(spark, sf_dir):
    return r6(seismic.pick_max(image(spark, sf_dir), ["shot", "f"]), "energy")


@query(f"""WITH {TRACE}, s AS (SELECT vec_id, i * 0.5 AS f, abs(v) AS v FROM tr), p AS (SELECT a.vec_id, a.f AS fc, b.v, 40 * log10(b.f / a.f) AS x FROM s a JOIN s b USING (vec_id) WHERE a.f > 0 AND b.f > 0),
w AS (SELECT vec_id, fc, v, CASE WHEN x = 0 THEN 1 ELSE (sin(x) / x) ** 4 END AS w FROM p)
SELECT vec_id, fc::DOUBLE AS fc, round(sum(w * v) / sum(w), 6) AS smooth FROM w GROUP BY vec_id, fc UNION ALL SELECT vec_id, f::DOUBLE, round(v, 6) FROM s WHERE f <= 0""")
def konno_ohmachi(spark, sf_dir):
    s = seismic.samples(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").selectExpr("vec_id", "i * 0.5D AS f", "abs(v) AS v")
    return r6(seismic.konno_ohmachi(s, "vec_id", "f", "v"), "smooth")


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' (' || p_brand || ') [m] ' || p_name), '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM part")
def label_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.snake_label(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(") [m] "), "p_name")).alias("label"))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'void' ELSE (s_suppkey % 90 * 100 + s_suppkey % 60 + 0.25)::VARCHAR END AS tok, ['N', 's', 'E', 'W'][s_suppkey % 4 + 1] AS h FROM supplier)
SELECT s_suppkey, round((floor(try_cast(tok AS DOUBLE) / 100) + (try_cast(tok AS DOUBLE) - 100 * floor(try_cast(tok AS DOUBLE) / 100)) / 60) * CASE WHEN upper(h) IN ('S', 'W') THEN -1 ELSE 1 END, 9) AS degrees FROM t""")
def nmea_degrees(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 9 = 0 THEN 'void' ELSE string(s_suppkey % 90 * 100 + s_suppkey % 60 + 0.25) END AS tok", "array('N', 's', 'E', 'W')[s_suppkey % 4] AS h")
    return t.select("s_suppkey", F.round(scalar.nmea_degrees(F.col("tok"), F.col("h")), 9).alias("degrees"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 - (event_id % 25 - 12) * 3600 AS utc FROM events""")
def offset_times(spark, sf_dir):
    """Local times with an offset of their own, read as instants."""
    e = table(spark, sf_dir, "events").withColumn("o", F.col("event_id") % 25 - 12)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"), F.when(F.col("o") < 0, "-").otherwise("+"), F.lpad(F.abs("o").cast("string"), 2, "0"), F.lit(":00"))
    return e.select("event_id", F.unix_seconds(survey.instant(text)).alias("utc"))


@query(f"""WITH {EV}, a AS (SELECT seq, 1.66 * sqrt(2 * pi() * 18030 * 4e-7 * pi() * greatest(abs(value), 1) / 1000 / 2) AS a FROM ev)
SELECT seq, round(-(9 - exp(-a) * ((9 + 9 * a - 2 * a * a * a) * cos(a) + (9 * a + 8 * a * a + 2 * a * a * a) * sin(a))) / (a * a) * 1e6, 2) AS ppm FROM a""")
def halfspace_quadrature(spark, sf_dir):
    s = F.greatest(F.abs("value"), F.lit(1.0)) / 1000
    return events(spark, sf_dir).select("seq", F.round(scalar.halfspace_quadrature(s, 18030.0, 1.66), 2).alias("ppm"))


J0 = """CASE WHEN abs(Z) <= 3 THEN 1 - 2.2499997 * pow(Z / 3, 2) + 1.2656208 * pow(Z / 3, 4) - 0.3163866 * pow(Z / 3, 6) + 0.0444479 * pow(Z / 3, 8) - 0.0039444 * pow(Z / 3, 10) + 0.00021 * pow(Z / 3, 12)
ELSE (0.79788456 - 0.00000077 * (3 / abs(Z)) - 0.0055274 * pow(3 / abs(Z), 2) - 0.00009512 * pow(3 / abs(Z), 3) + 0.00137237 * pow(3 / abs(Z), 4) - 0.00072805 * pow(3 / abs(Z), 5) + 0.00014476 * pow(3 / abs(Z), 6)) / sqrt(abs(Z))
 * cos(abs(Z) - 0.78539816 - 0.04166397 * (3 / abs(Z)) - 0.00003954 * pow(3 / abs(Z), 2) + 0.00262573 * pow(3 / abs(Z), 3) - 0.00054125 * pow(3 / abs(Z), 4) - 0.00029333 * pow(3 / abs(Z), 5) + 0.00013558 * pow(3 / abs(Z), 6)) END"""


@query(f"""WITH p AS (SELECT s_nationkey AS f0, 2.0 + s_nationkey * 0.5 AS f, 10.0 + s_suppkey % 9 * 5 AS r, cos(s_suppkey * 0.7) * 0.5 + 0.4 AS v FROM supplier), g AS (SELECT f, r, v, 100.0 + c * 10 AS c FROM p, unnest(range(41)) t(c)),
z AS (SELECT f, c, v, 2 * pi() * f * r / c AS z FROM g), j AS (SELECT f, c, v, {J0.replace('Z', 'z')} AS j FROM z),
s AS (SELECT f, c, sum(v * j) AS vj, sum(j * j) AS jj, sum(v * v) AS vv, count(*) AS n FROM j GROUP BY f, c), a AS (SELECT *, least(greatest(CASE WHEN jj > 0 THEN vj / jj ELSE 0 END, 0), 1) AS a FROM s),
e AS (SELECT *, sqrt(greatest((vv - 2 * a * vj + a * a * jj) / n, 0)) AS residual FROM a), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(residual, 6), c) = 1)
SELECT f::DOUBLE AS f, c::DOUBLE AS velocity, round(a, 6) AS amplitude, round(residual, 6) AS residual FROM b""")
def spac_velocity(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").selectExpr("2D + s_nationkey * 0.5D AS f", "10D + s_suppkey % 9 * 5 AS r", "cos(s_suppkey * 0.7D) * 0.5D + 0.4D AS v")
    return r6(passive.spac_velocity(p, "f", "r", "v", 100.0, 500.0, 10.0), "amplitude", "residual")


@query("""WITH p AS (SELECT s_suppkey AS i, s_nationkey AS array, (s_suppkey * 17 % 101)::DOUBLE AS x, (s_suppkey * 29 % 97)::DOUBLE AS y FROM supplier),
q AS (SELECT a.array, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS r FROM p a JOIN p b ON a.array = b.array AND a.i < b.i)
SELECT q."array", round(2 * min(r), 6) AS lambda_min, round(2 * max(r), 6) AS lambda_max, round(2 * max(r) / 3, 6) AS depth FROM q GROUP BY 1""")
def resolution_limits(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS i", "s_nationkey AS array", "double(s_suppkey * 17 % 101) AS x", "double(s_suppkey * 29 % 97) AS y")
    return r6(passive.resolution(passive.separations(p, "i", "x", "y", "array"), "array"), "lambda_min", "lambda_max", "depth")


@query("""WITH m AS (SELECT quantile_cont(l_discount - l_tax, 0.5) AS m FROM lineitem), s AS (SELECT 1.4826 * quantile_cont(abs(l_discount - l_tax - m), 0.5) AS s FROM lineitem, m)
SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax - m) > 1.7 * s AND abs(l_discount - l_tax) > 0.001 AS outlier FROM lineitem, m, s""")
def residual_outliers(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount - l_tax AS residual")
    return tomography.outliers(l, "residual", 1.7, 0.001).select("l_orderkey", "l_linenumber", "outlier")


@query()
def grid_travel_times(spark, sf_dir):
    """First arrivals from one source per region through a grid whose slowness follows the parts' sizes."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey - 1 AS node", "0.001D + p_size * 0.00002D AS s")
    k = max(1, math.ceil(math.sqrt(((p.agg(F.max("node")).first()[0] or 0) + 1) / 200)))  # a grid of 2 by 1 that holds all parts
    nodes = tomography.grid(spark, 20 * k, 10 * k, 2.0).join(p, "node")
    sources = table(spark, sf_dir, "region").selectExpr("r_name AS source", "bigint(r_regionkey * 4) AS node")
    return tomography.grid_times(nodes, sources, 2.0, 3).select("source", "node", F.round("time", 9).alias("time"))


@query(f"""WITH {TRACE}, m AS (SELECT vec_id, avg(v) AS mean FROM tr GROUP BY vec_id), x AS (SELECT vec_id, i, (v - mean) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM tr JOIN m USING (vec_id)),
s AS (SELECT vec_id % 4 AS node, vec_id // 4 AS w, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM x, range(2, 26) q(k) GROUP BY vec_id, k),
c AS (SELECT a.node AS i, b.node AS j, a.k, avg(a.re * b.re + a.im * b.im) AS r, avg(a.im * b.re - a.re * b.im) AS m, sqrt(avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2)) AS p, count(*) AS windows FROM s a JOIN s b ON a.w = b.w AND a.k = b.k AND a.node < b.node GROUP BY a.node, b.node, a.k)
SELECT i, j, round(k / 0.128, 6)::DOUBLE AS f, round(r / p, 6) AS re, round(m / p, 6) AS im, windows FROM c WHERE p > 0""")
def window_coherency(spark, sf_dir):
    """Coherency of node pairs: vectors of one label are the windows of four nodes in turn."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id % 4 AS node", "vec_id div 4 AS w", "embedding")
    out = passive.coherency(passive.spectra(e, ["node", "w"], "embedding", 0.002, 10.0, 200.0), "node", "w")
    return r6(out, "re", "im", "f")


@query(f"""WITH {EV}, s AS (SELECT seq, CASE WHEN count(value) OVER b = 5 AND count(value) OVER a = 5 THEN quantile_cont(value, 0.5) OVER a - quantile_cont(value, 0.5) OVER b END AS shift FROM ev
WINDOW b AS (PARTITION BY station ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY station ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT seq, round(shift, 6) AS shift FROM s""")
def node_moves(spark, sf_dir):
    return r6(records.before_after(events(spark, sf_dir), "station", "seq", "value", 5).select("seq", "shift"), "shift")


@query(f"""WITH {EV}, a AS (SELECT DISTINCT station, seq * 37 % 360 + 0.0 AS a FROM ev), g AS (SELECT station, coalesce(lead(a) OVER (PARTITION BY station ORDER BY a), min(a) OVER (PARTITION BY station) + 360) - a AS g FROM a)
SELECT station, max(g)::DOUBLE AS gap, ((360 - max(g)) / 2)::DOUBLE AS half_arc FROM g GROUP BY station""")
def azimuth_gap(spark, sf_dir):
    return records.largest_gap(events(spark, sf_dir).selectExpr("station", "double(seq * 37 % 360) AS a"), "station", "a")


@query(f"""WITH {EV}, k AS (SELECT seq, station, CASE WHEN seq % 3 = 0 THEN value END AS v, row_number() OVER (PARTITION BY station ORDER BY seq) AS k FROM ev),
f AS (SELECT seq, k, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k0, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER a AS k1 FROM k
WINDOW b AS (PARTITION BY station ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY station ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT seq, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN k1 > k0 THEN v0 + (v1 - v0) * (k - k0) / (k1 - k0) ELSE v0 END, 6) AS filled FROM f""")
def fill_positions(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("seq") % 3 == 0, F.col("value")))
    return r6(records.filled(e, "station", "seq", "v").select("seq", "filled"), "filled")


@query("""SELECT l.l_orderkey, l.l_linenumber, coalesce(o.o_totalprice, l.l_quantity) AS time, o.o_orderkey IS NOT NULL AS edited FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 17 = 0) o ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1""")
def picks_with_edits(spark, sf_dir):
    picks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS time")
    edits = table(spark, sf_dir, "orders").where("o_orderkey % 17 = 0").selectExpr("o_orderkey AS l_orderkey", "1 AS l_linenumber", "o_totalprice AS time")
    return seismic.with_edits(picks, edits, ["l_orderkey", "l_linenumber"], ["time"])


@query(f"""WITH {TRACE}, c AS (SELECT vec_id, 5.0 + i AS f, 200 + 50 * v AS v FROM tr), s AS (SELECT vec_id, f AS f0, v AS v0, lead(f) OVER w AS f1, lead(v) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY f)), a AS (SELECT vec_id, 3.0 + k * 2.5 AS f FROM embeddings, unnest(range(30)) t(k))
SELECT vec_id, f::DOUBLE AS f, round(CASE WHEN f1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (f - f0) / (f1 - f0) END, 6) AS v FROM a JOIN s USING (vec_id) WHERE f >= f0 AND (f < f1 OR (f = f0 AND f1 IS NULL))""")
def dispersion_resample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    curve = seismic.samples(e, "vec_id", "embedding").selectExpr("vec_id", "5D + i AS f", "200 + 50 * v AS v")
    at = e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: k * F.lit(2.5) + F.lit(3.0))).alias("f"))
    return r6(seismic.resample(curve, "vec_id", "f", "v", at), "v")


def as_files(df: DataFrame, file, line: str, order: str, head: str = "") -> DataFrame:
    """(file, text): the lines of each file in order, below ``head``."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return df.groupBy(file.alias("file")).agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


@query("SELECT 'u' || user_id AS file, event_type AS line, 'S' || event_id AS station, strftime(ts, '%H:%M:%S') AS time, value AS field, event_id % 10 / 2.0 AS quality FROM events WHERE event_id % 10 / 2.0 >= 1")
def source_magnetometer(spark, sf_dir):
    """Events written as magnetometer text, a file per user, and read back above a quality."""
    e = table(spark, sf_dir, "events")
    row = F.concat_ws(" ", "event_type", F.concat(F.lit("S"), "event_id"), F.date_format("ts", "HH:mm:ss"), F.col("value").cast("string"), (F.col("event_id") % 10 / 2).cast("string"))
    files = as_files(e.withColumn("row", row), F.concat(F.lit("u"), "user_id"), "row", "event_id", "# line station time field quality\n")
    return text.read_g857(spark, files, min_quality=1.0).select("file", "line", "station", "time", "field", "quality")


@query("SELECT 'r' || (s_suppkey // 16) AS file, (s_nationkey || '-' || s_suppkey) AS station_id, s_acctbal AS mean_nt, round((s_suppkey * 0.5 * 0.3048)::DOUBLE, 6) AS distance FROM supplier")
def source_magnetics_summary(spark, sf_dir):
    """Station tables with their columns in another order, found by the header."""
    s = table(spark, sf_dir, "supplier")
    row = F.concat_ws(",", "s_suppkey", F.col("s_acctbal").cast("string"), "s_nationkey", (F.col("s_suppkey") * 0.5).cast("string"))
    files = as_files(s.withColumn("row", row), F.concat(F.lit("r"), F.expr("s_suppkey div 16")), "row", "s_suppkey", "Station,Mean_nT,Line_No,Dist_from_S_ft\n")
    return r6(text.read_magnetics_summary(spark, files).select("file", "station_id", "mean_nt", "distance"), "distance")


@query("SELECT 'd' || (c_custkey // 60) AS file, c_custkey::VARCHAR AS station, round(c_acctbal, 3) AS grav, c_custkey % 5 + 0.5 AS tiltx FROM customer")
def source_gravimeter(spark, sf_dir):
    """Gravimeter dumps with spaced labels in their header."""
    c = table(spark, sf_dir, "customer")
    row = F.concat_ws("\t", F.lit("1.0"), F.concat(F.col("c_custkey").cast("string"), F.lit(".0")), (F.col("c_custkey") % 5 + 0.5).cast("string"), F.round("c_acctbal", 3).cast("string"), F.lit("10:00:00"), F.lit("2026/03/12"))
    files = as_files(c.withColumn("row", row), F.concat(F.lit("d"), F.expr("c_custkey div 60")), "row", "c_custkey", "/\tCG-5 SURVEY\n/ Line\tStation\tTilt x\tGrav.\tTime\tDate\n")
    return text.read_cg5(spark, files).select("file", "station", "grav", "tiltx")


@query("SELECT 'n' || (s_suppkey // 16) AS file, lpad((s_suppkey % 240000)::VARCHAR, 6, '0') AS time, round((s_suppkey % 60) + 30 / 60.0, 9) AS latitude, round(-((s_suppkey % 170) + 15 / 60.0), 9) AS longitude, CASE WHEN s_suppkey % 2 = 0 THEN 1.5 END AS depth FROM supplier")
def source_nmea(spark, sf_dir):
    """Logs of fixes, every other one followed by a depth."""
    s = table(spark, sf_dir, "supplier")
    fix = F.format_string("$GPRMC,%06d,A,%02d30.0,N,%03d15.0,W,,,,", F.col("s_suppkey") % 240000, F.col("s_suppkey") % 60, F.col("s_suppkey") % 170)
    row = F.when(F.col("s_suppkey") % 2 == 0, F.concat(fix, F.lit("\n$SDDPT,1.5,0.0"))).otherwise(fix)
    out = text.read_nmea(spark, as_files(s.withColumn("row", row), F.concat(F.lit("n"), F.expr("s_suppkey div 16")), "row", "s_suppkey"))
    return out.select("file", "time", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "depth")


@query("""WITH k AS (SELECT unnest([1, 2, 4, 5, 6, 7, 3]) AS kind), p AS (SELECT kind, p_partkey // 50 AS line, p_partkey - min(p_partkey) OVER (PARTITION BY p_partkey // 50) AS s, CASE WHEN kind IN (3, 6, 7) THEN p_size % 4 + 1 ELSE 1 END AS n, p_retailprice AS rhoa FROM part, k)
SELECT 'k' || kind || '-' || line AS file, (s + CASE kind WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END)::INT AS a, (CASE kind WHEN 1 THEN s + 3 WHEN 3 THEN s WHEN 4 THEN s WHEN 5 THEN s + 2 WHEN 7 THEN s + 2 * n + 1 END)::INT AS b,
(s + CASE kind WHEN 3 THEN n + 1 WHEN 4 THEN 2 WHEN 6 THEN n WHEN 7 THEN n ELSE 1 END)::INT AS m, (CASE kind WHEN 1 THEN s + 2 WHEN 3 THEN s + n + 2 WHEN 4 THEN s + 3 WHEN 5 THEN s + 3 WHEN 6 THEN s + n + 1 WHEN 7 THEN s + n + 1 END)::INT AS n, rhoa FROM p""")
def source_res2dinv(spark, sf_dir):
    """Resistivity files of every standard array, by first electrode: one for each array and 50 parts, a reading of each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.expr("p_partkey div 50").alias("line"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4, 5, 6, 7)])).alias("kind"))
    n = F.when(F.col("kind").isin(3, 6, 7), (F.col("p_size") % 4 + 1).cast("string"))
    row = F.concat_ws(" ", ((F.col("p_partkey") - 1) * 2.0).cast("string"), F.lit("2.0"), n, F.col("p_retailprice").cast("string"))
    files = as_files(p.withColumn("row", row), F.concat_ws("-", "kind", "line"), "row", "p_partkey")
    head = F.concat(F.lit("line\n2.0\n"), F.substring_index("file", "-", 1), F.lit("\n"), F.size(F.split("text", "\n")) - 1, F.lit("\n0\n0\n"))
    files = files.select(F.concat(F.lit("k"), "file").alias("file"), F.concat(head, "text").alias("text"))
    return text.read_res2dinv(spark, files).select("file", "a", "b", "m", "n", "rhoa")


@query(f"WITH {TRACE}, s AS (SELECT vec_id, sum(v) AS total, max(abs(v)) AS most, count(*) AS n FROM tr GROUP BY vec_id) SELECT 'shot' || vec_id // 12 AS file, vec_id % 12 AS trace, round((vec_id % 12) * 2.0, 6) AS receiver_x, n, round(total, 5) AS total, round(most, 5) AS most FROM s")
def source_shot_records(spark, sf_dir):
    """Vectors written as big-endian SEG-2 shot records in tasks, decoded again."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 12").alias("shot")).agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("k"), "embedding"))).alias("t"))

    @F.pandas_udf("binary")
    def encode(shots: pd.Series) -> pd.Series:
        return shots.map(lambda t: binary.encode_seg2([(x["embedding"], {"RECEIVER_LOCATION": f"{x['k'] % 12 * 2.0}", "SAMPLE_INTERVAL": "0.002"}) for x in t]))

    files = e.select(F.concat(F.lit("shot"), "shot").alias("path"), encode("t").alias("content"))
    out = binary.read_seg2(spark, files).withColumn("v", F.col("samples"))
    return out.select("file", (F.col("receiver_x") / 2).cast("long").alias("trace"), "receiver_x", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.round(F.array_max(F.transform("v", F.abs)), 5).alias("most"))


@query("""WITH r AS (SELECT l_suppkey AS g, l_extendedprice AS x, l_quantity AS y, l_linenumber::DOUBLE AS w FROM lineitem), s AS (SELECT g, count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM r GROUP BY g),
l AS (SELECT *, CASE WHEN s * xx - sx * sx > 1e-12 * s * xx THEN (s * xy - sx * sy) / (s * xx - sx * sx) END AS slope FROM s) SELECT g, n, round(slope, 9) AS slope, round((sy - slope * sx) / s, 6) AS intercept, round(xy / xx, 9) AS through_origin FROM l""")
def weighted_regression(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS g", "l_extendedprice AS x", "l_quantity AS y", "double(l_linenumber) AS w")
    free = seismic.regression(l, ["g"], "x", "y", "w")
    fixed = seismic.regression(l, ["g"], "x", "y", "w", origin=True).select("g", F.round("slope", 9).alias("through_origin"))
    return r6(free, "intercept").withColumn("slope", F.round("slope", 9)).join(fixed, "g")


@query("""WITH p AS (SELECT c_custkey AS k, (c_custkey * 37 % 1000)::DOUBLE AS x, (c_custkey * 91 % 1009)::DOUBLE AS y FROM customer), o AS (SELECT s_suppkey AS j, (s_suppkey * 53 % 1000)::DOUBLE AS x, (s_suppkey * 29 % 1009)::DOUBLE AS y FROM supplier),
d AS (SELECT k, j, sqrt((p.x - o.x) ** 2 + (p.y - o.y) ** 2) AS d FROM p JOIN o ON abs(p.x - o.x) <= 40 AND abs(p.y - o.y) <= 40)
SELECT k, j AS other, round(d, 6) AS distance FROM d WHERE d <= 40 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, j) = 1""")
def nearest_sample(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "double(c_custkey * 37 % 1000) AS x", "double(c_custkey * 91 % 1009) AS y")
    o = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS j", "double(s_suppkey * 53 % 1000) AS x", "double(s_suppkey * 29 % 1009) AS y")
    return r6(joins.nearest_within(p, o, "k", "x", "y", "j", 40.0), "distance")


@query(f"""WITH {EV}, c AS (SELECT station, seq, line, CASE WHEN line IS DISTINCT FROM lag(line) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY station ORDER BY seq)),
r AS (SELECT *, (sum(new) OVER (PARTITION BY station ORDER BY seq))::BIGINT AS run FROM c) SELECT station, run, min(line) AS value, min(seq) AS "first", max(seq) AS "last", count(*) AS length FROM r GROUP BY station, run""")
def run_lengths(spark, sf_dir):
    return records.runs(events(spark, sf_dir), "station", "seq", "line").withColumn("run", F.col("run").cast("long"))


@query(f"""WITH {EV}, o AS (SELECT quantile_cont(value, 0.5) AS ov, quantile_cont(y, 0.5) AS oy FROM ev WHERE station % 10 = 0) SELECT seq, round(value - ov, 6) AS value, round(y - oy, 6) AS y FROM ev, o""")
def free_air(spark, sf_dir):
    e = events(spark, sf_dir)
    zero = stations.free_air_offsets(e, F.col("station") % 10 == 0, ["value", "y"])
    return r6(stations.subtract_offsets(e.select("seq", "value", "y"), zero, ["value", "y"]), "value", "y")


@query(f"""WITH {EV}, {HOURLY}, b AS (SELECT line, quantile_cont(abs(value), 0.5) AS m FROM hr GROUP BY line), x AS (SELECT min(i) AS lo, max(i) AS hi, count(DISTINCT line) AS k FROM hr),
h AS (SELECT i FROM hr JOIN b USING (line) WHERE abs(value) > 1.1 * m GROUP BY i HAVING count(DISTINCT line) >= (SELECT k FROM x)), s AS (SELECT DISTINCT i // 24 AS shot, i // 24 * 24 + 12 AS nominal FROM hr),
o AS (SELECT shot, coalesce((SELECT min(i) FROM h WHERE i >= nominal - 6 AND i < nominal + 6), nominal) AS onset FROM s)
SELECT shot, onset, onset - 2 AS start, onset + 6 AS "end" FROM o, x WHERE onset - 2 >= lo AND onset + 6 <= hi + 1""")
def shot_windows(spark, sf_dir):
    h = hourly(spark, sf_dir)
    shots = h.select(F.expr("i div 24").alias("shot")).distinct().withColumn("at", F.col("shot") * 24 + 12)
    return records.shot_windows(h, shots, "line", "i", "value", "shot", "at", 8, 2, 6, factor=1.1)


@query("""WITH c AS (SELECT s_suppkey, 300.0 + s_suppkey AS v1, 900.0 + s_nationkey * 40 - CASE WHEN s_suppkey % 9 = 0 THEN 700 ELSE 0 END AS v2, 2.0 + s_suppkey % 7 AS h FROM supplier)
SELECT s_suppkey, round(CASE WHEN v2 > v1 THEN 2 * h * tan(asin(v1 / v2)) END, 6) AS critical, round(CASE WHEN v2 > v1 THEN 2 * h * sqrt((v2 + v1) / (v2 - v1)) END, 6) AS crossover, round(CASE WHEN v2 > v1 THEN 0.01 * v1 * v2 / (2 * sqrt(v2 * v2 - v1 * v1)) END, 6) AS depth FROM c""")
def refraction_distances(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "300D + s_suppkey AS v1", "900D + s_nationkey * 40 - CASE WHEN s_suppkey % 9 = 0 THEN 700 ELSE 0 END AS v2", "2D + s_suppkey % 7 AS h")
    v1, v2, h = F.col("v1"), F.col("v2"), F.col("h")
    return r6(c.select("s_suppkey", scalar.critical_distance(v1, v2, h).alias("critical"), scalar.crossover_distance(v1, v2, h).alias("crossover"), scalar.depth_from_intercept(v1, v2, F.lit(0.01)).alias("depth")), "critical", "crossover", "depth")


@query("""WITH t AS (SELECT p_partkey % 3 AS file, p_partkey::DOUBLE AS t, p_size / 10.0 AS d FROM part), x AS (SELECT file, min(t) AS t0, max(t) AS t1 FROM t GROUP BY file),
r AS (SELECT l_orderkey * 10 + l_linenumber AS record, l_orderkey % 3 AS file, t0 + (t1 - t0) * ((l_orderkey * 7 + l_linenumber) % 1000) / 1000.0 AS t, l_quantity - 5 AS r, l_tax AS c, l_linenumber % 2 AS lay FROM lineitem JOIN x ON x.file = l_orderkey % 3),
g AS (SELECT *, round_even((t * 1.5 - 4.0) / 2.0, 0) AS z FROM r),
p AS (SELECT *, z AS a, z - 1 AS b, z - 3 - lay AS m, z - 4 - lay AS n FROM g), f AS (SELECT file, min(n) AS first FROM p GROUP BY file),
e AS (SELECT file, record, r, (m - first)::BIGINT AS a, (n - first)::BIGINT AS b, (a - first)::BIGINT AS m, (b - first)::BIGINT AS n FROM p JOIN f USING (file)),
k AS (SELECT file, a, b, m, n, count(*) AS repeats, min(record) AS record, avg(ln(r)) AS lr, stddev_samp(ln(r)) AS scatter FROM e WHERE r > 0 GROUP BY file, a, b, m, n)
SELECT file::VARCHAR AS file, a, b, m, n, repeats, record, round(scatter, 6) AS scatter, round(2 * pi() / (1 / (2.0 * abs(a - m)) - 1 / (2.0 * abs(b - m)) - 1 / (2.0 * abs(a - n)) + 1 / (2.0 * abs(b - n))) * exp(lr), 4) AS rhoa FROM k""")
def towed_line(spark, sf_dir):
    track = table(spark, sf_dir, "part").selectExpr("string(p_partkey % 3) AS file", "double(p_partkey) AS t", "p_partkey * 1.5D AS s", "p_size / 10D AS water_depth")
    span = track.groupBy("file").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    l = table(spark, sf_dir, "lineitem").withColumn("file", (F.col("l_orderkey") % 3).cast("string")).join(span, "file")
    r = l.selectExpr("file", "l_orderkey * 10 + l_linenumber AS record", "t0 + (t1 - t0) * ((l_orderkey * 7 + l_linenumber) % 1000) / 1000D AS t", "l_quantity - 5 AS r", "l_tax AS current_ma", "0D AS ax", "-2D AS bx", "-6D - l_linenumber % 2 * 2 AS mx", "-8D - l_linenumber % 2 * 2 AS nx")
    out = towed.towed_line(r, track, 2.0, lead=4.0)
    return r6(out.select("file", "a", "b", "m", "n", "repeats", "record", "scatter", F.round("rhoa", 4).alias("rhoa")), "scatter")


@query(f"""WITH {EV} SELECT seq, CASE WHEN value - y * 0.5 - 1.2 >= 0 THEN round(value - y * 0.5 - 1.2, 6) END AS height FROM ev""")
def height_above_ground(spark, sf_dir):
    return r6(stations.heights_from_altitude(events(spark, sf_dir), "value", F.col("y") * 0.5, 1.2).select("seq", "height"), "height")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity / 1000 AS time FROM lineitem), s AS (SELECT s_suppkey AS id, s_suppkey * 5.0 AS x FROM supplier WHERE s_suppkey % 11 <> 0), r AS (SELECT p_partkey AS id, p_partkey * 2.0 AS x FROM part)
SELECT l_orderkey, l_linenumber, time, s.x::DOUBLE AS source_x, r.x::DOUBLE AS receiver_x FROM p LEFT JOIN s ON s.id = l_suppkey LEFT JOIN r ON r.id = l_partkey""")
def traveltime_table(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").where("s_suppkey % 11 <> 0").selectExpr("'source' AS role", "s_suppkey AS id", "s_suppkey * 5D AS x").unionAll(table(spark, sf_dir, "part").selectExpr("'receiver' AS role", "p_partkey AS id", "p_partkey * 2D AS x"))
    picks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity / 1000 AS time")
    return seismic.traveltime_table(picks, points, "l_suppkey", "l_partkey").select("l_orderkey", "l_linenumber", "time", "source_x", "receiver_x")


@query("""SELECT 'u' || user_id AS file, CASE WHEN user_id % 3 < 2 THEN event_type END AS line, 'S' || event_id AS station, strftime(ts, '%H:%M:%S') AS time, value AS field, CASE user_id % 3 WHEN 0 THEN event_id % 10 / 2.0 WHEN 1 THEN event_id % 7 / 2.0 END AS quality
FROM events WHERE user_id % 3 = 2 OR CASE user_id % 3 WHEN 0 THEN event_id % 10 / 2.0 ELSE event_id % 7 / 2.0 END >= 1""")
def source_magnetometer_layouts(spark, sf_dir):
    """Magnetometer text of three layouts in one run: labels in two orders, and three columns without labels."""
    e = table(spark, sf_dir, "events")
    kind, station, clock, v = F.col("user_id") % 3, F.concat(F.lit("S"), "event_id"), F.date_format("ts", "HH:mm:ss"), F.col("value").cast("string")
    half = lambda n: (F.col("event_id") % n / 2).cast("string")
    row = F.when(kind == 0, F.concat_ws(",", station, "event_type", clock, v, half(10))).when(kind == 1, F.concat_ws(" ", half(7), v, clock, station, "event_type")).otherwise(F.concat_ws("\t", station, clock, v))
    files = as_files(e.withColumn("row", row), F.concat(F.lit("u"), "user_id"), "row", "event_id")
    kind = F.expr("int(substring(file, 2)) % 3")
    head = F.when(kind == 0, "Stn,Line_ID,Time(HH:MM:SS),Total_Field(nT),Quality/Signal\n").when(kind == 1, "# SQ nT Clock Point L\n").otherwise("")
    return text.read_g857(spark, files.select("file", F.concat(head, "text").alias("text")), min_quality=1.0).select("file", "line", "station", "time", "field", "quality")


@query("""SELECT 'e' || user_id AS file, event_id AS sample, value AS "I_5310", CASE WHEN event_id % 4 <> 0 THEN event_id % 100 / 4.0 END AS "Q_5310", CASE WHEN user_id % 2 = 1 THEN event_id % 10 + 0.5 END AS powerln FROM events""")
def source_em_tracks(spark, sf_dir):
    """EM tracks of two exporters in one run: channels in another order, a column more, empty cells."""
    e = table(spark, sf_dir, "events")
    i, n = F.col("value").cast("string"), F.col("event_id").cast("string")
    q = F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 100 / 4).cast("string")).otherwise(" ")
    row = F.when(F.col("user_id") % 2 == 1, F.concat_ws(",", q, n, (F.col("event_id") % 10 + 0.5).cast("string"), i)).otherwise(F.concat_ws(",", n, i, q))
    files = as_files(e.withColumn("row", row), F.concat(F.lit("e"), "user_id"), "row", "event_id")
    odd = F.expr("int(substring(file, 2)) % 2") == 1
    head = F.when(odd, "#File:x\n\nQ_5310Hz(ppm),Sample,PowerLn,I_5310Hz(ppm)\n").otherwise("#File:y\nSample ,I_5310Hz(ppm) ,Q_5310Hz(ppm)\n")
    return text.read_gem2(spark, files.select("file", F.concat(head, "text").alias("text"))).select("file", F.col("sample").cast("long").alias("sample"), "I_5310", "Q_5310", "powerln")


@query("""SELECT 'p' || (c_custkey // 50) AS file, c_name AS name, CASE WHEN c_custkey // 50 % 2 = 0 THEN c_custkey % 170 + 0.25 END AS longitude, CASE WHEN c_custkey // 50 % 2 = 0 THEN c_custkey % 80 + 0.5 END AS latitude,
CASE WHEN c_custkey // 50 % 2 = 1 THEN c_custkey * 2.5 END AS easting, CASE WHEN c_custkey // 50 % 2 = 1 THEN c_custkey * 1.5 END AS northing, CASE WHEN c_custkey // 50 % 2 = 0 THEN round(c_acctbal - 2, 6) END AS height, CASE WHEN c_custkey // 50 % 2 = 1 THEN round(c_acctbal - 1.5, 6) END AS elevation,
CASE WHEN c_custkey // 50 % 2 = 0 THEN 'FIX, good' ELSE c_mktsegment END AS status, CASE WHEN c_custkey // 50 % 2 = 0 THEN 1778778030 + c_custkey % 60 END::DOUBLE AS start_s FROM customer""")
def source_positions(spark, sf_dir):
    """GNSS exports of two receivers in one run: degrees or metres, other labels, quoted fields."""
    c = table(spark, sf_dir, "customer").withColumn("odd", F.expr("c_custkey div 50 % 2") == 1)
    k, t = F.col("c_custkey"), lambda x: x.cast("string")
    even = F.concat_ws(",", "c_name", t(k % 170 + 0.25), t(k % 80 + 0.5), t(F.col("c_acctbal")), F.lit("2.0"), F.lit('"FIX, good"'), F.format_string("2026-05-14 12:00:%02d.0 UTC-05:00", (k % 60 + 30) % 60))
    even = F.when(k % 60 < 30, even).otherwise(F.regexp_replace(even, "12:00:", "12:01:"))
    other = F.concat_ws(",", t(F.col("c_acctbal")), t(k * 1.5), t(k * 2.5), F.lit("1.5"), "c_mktsegment", "c_name")
    files = as_files(c.withColumn("row", F.when(F.col("odd"), other).otherwise(even)), F.concat(F.lit("p"), F.expr("c_custkey div 50")), "row", "c_custkey")
    head = F.when(F.expr("int(substring(file, 2)) % 2 = 1"), "MSL,North (m),East (m),Ant height,Fix type,Point ID\n").otherwise("Name,Lon,Lat,Ellipsoidal height,Antenna height,Solution status,Averaging start\n")
    out = text.read_positions(spark, files.select("file", F.concat(head, "text").alias("text")), "antenna")
    return r6(out, "height", "elevation").select("file", "name", "longitude", "latitude", "easting", "northing", "height", "elevation", "status", "start_s")


@query(f"WITH {TRACE}, s AS (SELECT vec_id, sum(v) AS total, max(abs(v)) AS most, count(*) AS n FROM tr GROUP BY vec_id) SELECT vec_id, vec_id // 12 AS shot, (vec_id % 12) * 2.5::DOUBLE AS receiver_x, (vec_id // 12 * 0.5)::DOUBLE AS source_x, 0.0005::DOUBLE AS dt, n, round(total, 4) AS total, round(most, 5) AS most FROM s")
def source_segy(spark, sf_dir):
    """Vectors written as SEG-Y by tasks, a file each, and read back in ranges of traces by more tasks."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS receiver_id", "vec_id div 12 AS source_id", "vec_id % 12 * 2.5D AS receiver_x", "vec_id div 12 * 0.5D AS source_x", "0.0005D AS dt", "embedding AS samples")
    folder = f"{shared_folder(spark)}/segy-{uuid.uuid4().hex}"
    segy.register(spark)
    e.write.format("segy").mode("append").save(folder)
    t = segy.read_segy(spark, folder, rangebytes=64_000)
    v = F.col("samples")
    total = F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    return t.select(F.col("receiver_id").cast("long").alias("vec_id"), F.col("source_id").cast("long").alias("shot"), "receiver_x", "source_x", "dt", F.size(v).cast("long").alias("n"), F.round(total, 4).alias("total"), F.round(F.array_max(F.transform(v, F.abs)), 5).alias("most"))


@query("""WITH t AS (SELECT vec_id, vec_id // 12 AS shot, vec_id % 12 AS k, max(vec_id % 12) OVER (PARTITION BY vec_id // 12) AS last FROM embeddings)
SELECT vec_id, CASE WHEN k IN (3, 7) AND k = last THEN k - 1 ELSE k END * 2.0::DOUBLE AS receiver_x, shot * 0.5::DOUBLE AS source_x, round(sqrt((CASE WHEN k IN (3, 7) AND k = last THEN k - 1 ELSE k END * 2.0 - shot * 0.5) ** 2 + 2.25), 6) AS "offset" FROM t""")
def spread_records(spark, sf_dir):
    """Shot records of one file: a source of its own for each, receivers that headers lack between their neighbours."""
    e = table(spark, sf_dir, "embeddings").selectExpr("'line.sgy' AS file", "int(vec_id) AS trace", "string(vec_id div 12) AS source_id", "CASE WHEN vec_id % 12 = 0 THEN vec_id div 12 * 0.5D END AS source_x", "CASE WHEN vec_id % 12 NOT IN (3, 7) THEN vec_id % 12 * 2D END AS receiver_x", "0D AS delay", "string(null) AS error")
    out = seismic.spread(e, standoff=1.5)
    return r6(out.select(F.col("trace").cast("long").alias("vec_id"), "receiver_x", "source_x", "offset"), "offset")


@query(f"""WITH RECURSIVE {IMAGE}, n AS (SELECT shot, f, c, energy, dense_rank() OVER (PARTITION BY shot ORDER BY f) AS k, round(max(energy) OVER (PARTITION BY shot, f) / (avg(energy) OVER (PARTITION BY shot, f) + 1e-30), 9) AS q FROM im),
s AS (SELECT shot, arg_min(k, (-q, k)) AS k0 FROM n GROUP BY shot),
t AS (SELECT n.shot, n.k, 0 AS dir, arg_min(c, (-round(energy, 9), c)) AS c FROM n JOIN s ON n.shot = s.shot AND n.k = s.k0 GROUP BY n.shot, n.k
 UNION ALL SELECT p.shot, n.k, d.dir, arg_min(n.c, (-round(n.energy, 9), n.c)) FROM t p JOIN (VALUES (1), (-1)) d(dir) ON p.dir = 0 OR p.dir = d.dir JOIN n ON n.shot = p.shot AND n.k = p.k + d.dir AND n.c BETWEEN p.c * 0.5 AND p.c * 1.5 GROUP BY p.shot, n.k, d.dir),
p AS (SELECT n.* FROM t JOIN n USING (shot, k, c)),
w AS (SELECT p.shot, p.k, coalesce(min(n.c) FILTER (WHERE n.c >= p.c AND n.energy <= p.energy / 2), max(n.c)) - coalesce(max(n.c) FILTER (WHERE n.c <= p.c AND n.energy <= p.energy / 2), min(n.c)) AS w FROM p JOIN n USING (shot, k) GROUP BY p.shot, p.k)
SELECT shot, f, c AS velocity, round(energy, 6) AS energy, round(w / 2, 6) AS width, round(q, 5) AS quality FROM p JOIN w USING (shot, k)""")
def dispersion_pick_track(spark, sf_dir):
    out = ridges.pick_track(image(spark, sf_dir), "shot", max_jump=0.5)
    return r6(out, "energy", "width").withColumn("quality", F.round("quality", 5))


@query(f"""WITH {FIT}, o AS (SELECT shot, row_number() OVER w AS k, sum(1.0) OVER w AS n, sum(x) OVER w AS x, sum(t) OVER w AS t, sum(x * x) OVER w AS xx, sum(x * t) OVER w AS xt, sum(t * t) OVER w AS tt FROM pk WINDOW w AS (PARTITION BY shot ORDER BY x)),
z AS (SELECT * FROM o UNION ALL SELECT DISTINCT shot, 0, 0, 0, 0, 0, 0, 0 FROM pk), i AS (SELECT a.shot, a.k AS i, b.k AS j, b.n - a.n AS n, b.x - a.x AS x, b.t - a.t AS t, b.xx - a.xx AS xx, b.xt - a.xt AS xt, b.tt - a.tt AS tt FROM z a JOIN o b ON a.shot = b.shot AND b.k - a.k >= 3),
f AS (SELECT *, CASE WHEN i = 0 THEN xt / xx ELSE (n * xt - x * t) / (n * xx - x * x) END AS p FROM i), g AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (t - p * x) / n END AS b FROM f),
e AS (SELECT shot, i, j, p, b, greatest(tt - p * xt - b * t, 0) AS e FROM g WHERE p > 0 AND (i = 0 OR b > 0)),
m AS (SELECT a.shot, a.j AS c1, b.j AS c2, a.p AS p1, b.p AS p2, c.p AS p3, b.b AS b2, c.b AS b3, a.e + b.e + c.e AS sse FROM e a JOIN e b ON a.shot = b.shot AND a.j = b.i AND b.p < a.p JOIN e c ON c.shot = b.shot AND c.i = b.j AND c.p < b.p WHERE a.i = 0 AND c.j = 24),
q AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY shot ORDER BY round(sse, 12), c1, c2) = 1), h AS (SELECT *, b2 / p1 / p2 / (2 * sqrt(1 / p2 / p2 - 1 / p1 / p1)) AS h1 FROM q)
SELECT shot, c1::INT AS cut1, c2::INT AS cut2, round(1 / p1, 3) AS v1, round(1 / p2, 3) AS v2, round(1 / p3, 3) AS v3, round(h1, 3) AS h1, round((b3 - 2 * h1 * sqrt(1 / p3 / p3 - 1 / p1 / p1) * p1 * p3) / p2 / p3 / (2 * sqrt(1 / p3 / p3 - 1 / p2 / p2)), 3) AS h2 FROM h""")
def fit_layers_n(spark, sf_dir):
    """Three layers for each shot's picks, by the best of all cuts."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shot"), "s_nationkey", F.explode(F.sequence(F.lit(1), F.lit(24)).cast("array<bigint>")).alias("i"))
    p = s.selectExpr("shot", "i * 4D AS x", "least(i * 4D / (300 + shot), 0.02D + s_nationkey * 0.001D + i * 4D / (1200 + shot * 2)) + ((i * 7 + shot) % 5) * 0.0001D AS t")
    m = refraction_layers.fit_layers(p, "shot", "x", "t", 3, least=3)
    at = lambda c, i: F.col(c)[i]
    return m.select("shot", at("cuts", 0).alias("cut1"), at("cuts", 1).alias("cut2"), *[F.round(at("velocities", i), 3).alias(f"v{i + 1}") for i in range(3)], *[F.round(at("thicknesses", i), 3).alias(f"h{i + 1}") for i in range(2)])


ARRAY = f"""{TRACE}, ax AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS x FROM tr),
asp AS (SELECT vec_id // 80 AS a, vec_id % 4 AS node, vec_id // 4 AS w, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM ax, range(2, 8) q(k) GROUP BY vec_id, k),
aco AS (SELECT l.a, l.node AS i, r.node AS j, l.k / 0.128 AS f, avg(l.re * r.re + l.im * r.im) AS re, avg(l.im * r.re - l.re * r.im) AS im, sqrt(avg(l.re ** 2 + l.im ** 2) * avg(r.re ** 2 + r.im ** 2)) AS p, count(*) AS n FROM asp l JOIN asp r ON l.a = r.a AND l.w = r.w AND l.k = r.k AND l.node < r.node GROUP BY l.a, l.node, r.node, l.k),
coh AS (SELECT a, i, j, f, re / p AS re, im / p AS im, n FROM aco WHERE p > 0)"""


def array_coherency(spark, sf_dir) -> DataFrame:
    """Coherency of the pairs of four nodes per array: 80 vectors are 20 windows of an array's nodes in turn."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 80 AS a", "vec_id % 4 AS node", "vec_id div 4 AS w", "embedding")
    return passive.coherency(passive.spectra(e, ["a", "node", "w"], "embedding", 0.002, 10.0, 60.0), "node", "w", "a")


@query(f"""WITH {ARRAY}, ph AS (SELECT a, i, j, f, atan2(im, re) AS p, sqrt(re * re + im * im) AS c FROM coh), st AS (SELECT *, p - lag(p) OVER w AS d FROM ph WINDOW w AS (PARTITION BY a, i, j ORDER BY f)),
tu AS (SELECT *, sum(CASE WHEN d > pi() THEN -1 WHEN d < -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY a, i, j ORDER BY f) AS turns FROM st)
SELECT a, i, j, round(f, 6)::DOUBLE AS f, round(2 * pi() * f * (j - i) * 12.5 / abs(p + 2 * pi() * turns), 4) AS velocity, turns::BIGINT AS turns, round(c, 6) AS coherence FROM tu WHERE c >= 0.15 AND abs(p + 2 * pi() * turns) > radians(20)""")
def two_station_dispersion(spark, sf_dir):
    """Phase velocities of all node pairs of all arrays, nodes in a line."""
    coh = array_coherency(spark, sf_dir)
    pairs = coh.select("a", "i", "j").distinct().withColumn("r", (F.col("j") - F.col("i")) * 12.5)
    out = passive.two_station(coh, pairs, ["a"], min_coherence=0.15)
    return r6(out.withColumn("velocity", F.round("velocity", 4)).withColumn("turns", F.col("turns").cast("long")), "f", "coherence")


_SLOWNESS = "CASE WHEN I < 5 THEN I / (5 * 5000.0) ELSE pow(100.0, (I - 5) / 19.0) / 5000 END"
_WAVE = "p + 2 * pi() * f * s * (sin(radians(az)) * dx + cos(radians(az)) * dy)"
_TURNED = "(W - 2 * pi() * floor(W / (2 * pi()) + 0.5))".replace("W", f"({_WAVE})")
_MISFIT = f"SELECT a, f, cell, s, az, np, sum({_TURNED} ** 2 / v) AS chi2, avg({_TURNED} ** 2) AS rr, avg(m * cos({_WAVE})) AS beam, avg(m) AS co FROM"


@query(f"""WITH {ARRAY}, nd AS (SELECT n AS node, [0.0, 30.0, -12.0, 9.0][n + 1] AS x, [0.0, 4.0, 25.0, -21.0][n + 1] AS y FROM range(4) t(n)),
us AS (SELECT c.a, c.f, k.x - l.x AS dx, k.y - l.y AS dy, sqrt(re * re + im * im) AS m, atan2(im, re) AS p, n, count(*) OVER (PARTITION BY c.a, c.f) AS np FROM coh c JOIN nd k ON k.node = c.i JOIN nd l ON l.node = c.j WHERE sqrt(re * re + im * im) >= 0.05 QUALIFY np >= 3),
gr AS (SELECT cell, {_SLOWNESS.replace('I', '(cell // 18)')} AS s, cell % 18 * 20.0 AS az FROM range(450) t(cell) WHERE cell = 0 OR cell >= 18),
be AS (SELECT a, f, cell, s, avg(m * cos({_WAVE})) AS beam FROM us, gr GROUP BY a, f, cell, s), fi AS (SELECT a, f, arg_min(s, (-round(beam, 9), cell)) AS s1 FROM be GROUP BY a, f),
we AS (SELECT us.*, greatest((1 - m * m) / (2 * n * m * m) + 2 * (2 * pi() * f * s1 * 1.5) ** 2 + 2 * (2 * pi() * f * 1e-4) ** 2, radians(0.5) ** 2) AS v FROM us JOIN fi USING (a, f)),
co AS ({_MISFIT} we, gr GROUP BY a, f, cell, s, az, np), bc AS (SELECT a, f, arg_min(cell, (round(chi2, 6), cell)) AS cell FROM co GROUP BY a, f),
bn AS (SELECT a, f, {_SLOWNESS.replace('I', 'greatest(cell // 18 - 1, 0)')} AS lo, {_SLOWNESS.replace('I', 'least(cell // 18 + 1, 24)')} AS hi, cell % 18 * 20.0 AS mid FROM bc),
fg AS (SELECT we.*, 1048576 + k AS cell, lo + (hi - lo) * (k // 21) / 20 AS s, (mid + 20.0 * (k % 21 / 10.0 - 1) + 360) % 360 AS az FROM we JOIN bn USING (a, f), range(441) t(k)),
ev AS (SELECT * FROM co UNION ALL {_MISFIT} fg GROUP BY a, f, cell, s, az, np), bb AS (SELECT a, f, arg_min(struct_pack(s := s, az := az, chi2 := chi2, rr := rr, beam := beam, co := co, np := np), (round(chi2, 6), cell)) AS b FROM ev GROUP BY a, f),
rg AS (SELECT a, f, min(s) AS s0, max(s) AS s1, any_value(b) AS b, list_sort(list_distinct(list(round(az, 6)))) AS azs FROM ev JOIN bb USING (a, f) WHERE chi2 <= b.chi2 + 2.30 * greatest(b.chi2 / greatest(b.np - 2, 1), 1) GROUP BY a, f),
hw AS (SELECT *, CASE WHEN s0 = 0 THEN 180 ELSE (360 - list_max(list_transform(range(len(azs)), lambda k: coalesce(azs[k + 2], azs[1] + 360) - azs[k + 1]))) / 2 END AS half FROM rg)
SELECT a, round(f, 6)::DOUBLE AS f, CASE WHEN b.s > 0 THEN round(1 / b.s, 4) END AS velocity, CASE WHEN s1 > 0 THEN round(1 / s1, 4) END AS velocity_min, CASE WHEN s0 >= 1 / 5000.0 THEN round(1 / s0, 4) END AS velocity_max, round((b.az + 180) % 360, 6)::DOUBLE AS azimuth, round(half, 6)::DOUBLE AS azimuth_halfwidth,
round(b.beam, 6) AS beam, round(degrees(sqrt(b.rr)), 5) AS phase_rms, b.np::BIGINT AS n_pairs, s0 >= 1 / 5000.0 AND s1 < (1 - 1e-9) / 50 AS resolved FROM hw""")
def plane_wave_fit(spark, sf_dir):
    """A plane wave for each array and frequency of all windows; infinite velocities are null."""
    nodes = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate([(0.0, 0.0), (30.0, 4.0), (-12.0, 25.0), (9.0, -21.0)])], "node long, x double, y double")
    coh = array_coherency(spark, sf_dir)
    placed = coh.select("a").distinct().crossJoin(F.broadcast(nodes))  # four rows
    out = passive.plane_wave(coh, placed, "a", "node", "x", "y", vmin=50.0, vmax=5000.0, n_velocity=20, azimuth_step=20.0, min_coherence=0.05)
    finite = lambda c: F.when(F.col(c) < float("inf"), F.round(c, 4)).alias(c)
    return r6(out.select("a", "f", finite("velocity"), finite("velocity_min"), finite("velocity_max"), "azimuth", "azimuth_halfwidth", "beam", F.round("phase_rms", 5).alias("phase_rms"), "n_pairs", "resolved"), "f", "azimuth", "azimuth_halfwidth", "beam")


def _tm_sql() -> tuple[str, str]:
    """The series as SQL: easting and northing of lon, lat (radians from the meridian: w; conformal tangent: t)."""
    a = geodesy.series(geodesy.FORWARD, geodesy.WGS84)
    x = " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, 1))
    y = " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, 1))
    return x, y


_E = 2 * math.sqrt(geodesy.WGS84[1] / (2 - geodesy.WGS84[1])) / (1 + geodesy.WGS84[1] / (2 - geodesy.WGS84[1]))
_K = 0.9996 * geodesy.rectifying_radius(geodesy.WGS84)


@query(f"""WITH p AS (SELECT c_custkey, c_custkey * 7 % 359 - 179.25 AS lon, c_custkey * 13 % 160 - 79.5 AS lat FROM customer), z AS (SELECT *, floor((lon + 180) / 6) % 60 + 1 AS zone FROM p),
s AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (zone * 6 - 183)) AS w FROM z), t AS (SELECT *, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) AS t FROM s), u AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey, zone::INTEGER AS zone, round(500000 + {_K!r} * (eta + {_tm_sql()[0]}), 4) AS easting, round(CASE WHEN lat >= 0 THEN 0 ELSE 1e7 END + {_K!r} * (xi + {_tm_sql()[1]}), 4) AS northing, round(lon, 9)::DOUBLE AS longitude, round(lat, 9)::DOUBLE AS latitude FROM u""")
def utm_projection(spark, sf_dir):
    """Customers' places in their UTM zone, and back in degrees."""
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey", "double(c_custkey * 7 % 359 - 179.25) AS lon", "double(c_custkey * 13 % 160 - 79.5) AS lat")
    zone = geodesy.utm_zone(F.col("lon"))
    e, n = geodesy.utm(F.col("lon"), F.col("lat"), zone)
    out = p.select("c_custkey", "lat", zone.alias("zone"), e.alias("e"), n.alias("n"))
    lon, lat = geodesy.from_transverse_mercator(F.col("e"), F.col("n"), F.col("zone") * 6 - 183, north=F.when(F.col("lat") >= 0, 0.0).otherwise(1e7))
    return out.select("c_custkey", "zone", F.round("e", 4).alias("easting"), F.round("n", 4).alias("northing"), F.round(lon, 9).alias("longitude"), F.round(lat, 9).alias("latitude"))


_F = geodesy.WGS84[1]


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, radians((c_custkey * 7 % 340) - 170.25) AS lam1, atan({1 - _F!r} * tan(radians(c_custkey * 13 % 150 - 75.0))) AS u1, radians((c_nationkey * 3) + 5.5) AS lam2, atan({1 - _F!r} * tan(radians(c_nationkey + 20.25))) AS u2 FROM customer),
g AS (SELECT id, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, (lam2 - lam1) - 2 * pi() * floor((lam2 - lam1) / (2 * pi()) + 0.5) AS w FROM p),
r AS (SELECT *, w AS lam, w AS was, 0 AS k FROM g UNION ALL SELECT id, s1, c1, s2, c2, w, w + (1 - c) * {_F!r} * sa * (sg + c * ss * (m + c * cs * (2 * m * m - 1))), lam, k + 1 FROM (
 SELECT *, {_F!r} / 16 * cc * (4 + {_F!r} * (4 - 3 * cc)) AS c, CASE WHEN cc > 1e-15 THEN cs - 2 * s1 * s2 / cc ELSE 0 END AS m FROM (SELECT *, 1 - sa * sa AS cc, atan2(ss, cs) AS sg FROM (SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (
 SELECT *, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM r WHERE k < 20))))),
e AS (SELECT id, lam, was, s1, c1, s2, c2, sqrt((c2 * sin(was)) ** 2 + (c1 * s2 - s1 * c2 * cos(was)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(was) AS cs FROM r WHERE k = 20),
f AS (SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(was) / ss ELSE 0 END AS sa FROM e), h AS (SELECT *, 1 - sa * sa AS cc FROM f), i AS (SELECT *, CASE WHEN cc > 1e-15 THEN cs - 2 * s1 * s2 / cc ELSE 0 END AS m, cc * {(1 / (1 - _F) ** 2 - 1)!r} AS u FROM h),
j AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS a, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS b FROM i)
SELECT id AS c_custkey, CASE WHEN abs(lam - was) < 1e-10 THEN round({geodesy.WGS84[0] * (1 - _F)!r} * a * (atan2(ss, cs) - b * ss * (m + b / 4 * (cs * (2 * m * m - 1) - b / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))), 3) END AS distance FROM j""")
def geodesic_distance(spark, sf_dir):
    """Distance on the ellipsoid of each customer from a place of its nation."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "double(c_custkey * 7 % 340 - 170.25) AS a", "double(c_custkey * 13 % 150 - 75) AS b", "double(c_nationkey * 3 + 5.5) AS c", "double(c_nationkey + 20.25) AS d")
    return c.select("c_custkey", F.round(geodesy.geodesic(*[F.col(x) for x in "abcd"]), 3).alias("distance"))


@query(f"""WITH c AS ({drift_sql('t')}), v AS (SELECT seq, event_type AS line FROM events JOIN c ON seq = event_id)
SELECT c.seq, corrected, '[{{"step":"read","parameters":{{"file":"u' || user_id || '"}}}},{{"step":"diurnal","parameters":{{"at":"t"}}}}]' AS lineage FROM c JOIN events ON event_id = c.seq""")
def corrected_once(spark, sf_dir):
    """Diurnal correction of readings that carry their lineage."""
    e = lineage.with_step(events(spark, sf_dir), "read", file=F.concat(F.lit("u"), "station"))
    out = lineage.to_json(stations.drift_corrected(e, e.where("station = 1"), "t", "value", 40000.0))
    return r6(out.select("seq", "corrected", "lineage"), "corrected")


@query(f"""WITH {TRACE}, e AS (SELECT vec_id, i, sum(v * v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS t, count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ct, sum(v * v) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS l, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS cl FROM tr WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
r AS (SELECT vec_id, i, l / (t + 1e-9 * max(t + l) OVER (PARTITION BY vec_id) + 1e-30) AS r FROM e WHERE ct = 5 AND cl = 5), x AS (SELECT vec_id, 10.0 + vec_id % 40 AS x FROM embeddings WHERE vec_id % 13 <> 0),
b AS (SELECT vec_id, arg_min(i, (-round(r, 9), abs(i - x), i)) AS pick, max(r) AS ratio FROM r JOIN x USING (vec_id) WHERE abs(i - x) <= 6 AND r >= 1.2 GROUP BY vec_id)
SELECT vec_id, x::DOUBLE AS expected, CASE WHEN vec_id % 17 = 0 THEN (vec_id % 64)::INT ELSE pick::INT END AS pick, round(ratio, 6) AS ratio, vec_id % 17 = 0 AS edited FROM embeddings LEFT JOIN x USING (vec_id) LEFT JOIN b USING (vec_id)""")
def guided_picks(spark, sf_dir):
    """Picks near the samples of a table of predictions; some made by hand."""
    e = table(spark, sf_dir, "embeddings")
    expected = e.where("vec_id % 13 <> 0").selectExpr("vec_id", "10D + vec_id % 40 AS expected")
    edits = e.where("vec_id % 17 = 0").selectExpr("vec_id", "int(vec_id % 64) AS pick")
    return r6(seismic.guided_pick(e, "vec_id", "embedding", 5, expected, 6, edits, least=1.2), "ratio")


_PI2 = "2 * pi() * f"


@query(f"""WITH RECURSIVE {ARRAY}, nd AS (SELECT n AS node, [0.0, 30.0, -12.0, 9.0][n + 1] AS x, [0.0, 4.0, 25.0, -21.0][n + 1] AS y FROM range(4) t(n)),
pr AS (SELECT k.node AS i, l.node AS j, sqrt((k.x - l.x) ** 2 + (k.y - l.y) ** 2) AS r FROM nd k JOIN nd l ON k.node < l.node), ro AS (SELECT a, i, j, f, re, im, r, dense_rank() OVER (PARTITION BY a, f ORDER BY r) AS ring FROM coh JOIN pr USING (i, j)),
bi AS (SELECT a, i, j, f, re, 0.0::DOUBLE AS lo, {passive.J0_LEAST_AT!r}::DOUBLE AS hi, 0 AS k FROM ro UNION ALL SELECT a, i, j, f, re, CASE WHEN jz > re THEN z ELSE lo END, CASE WHEN jz > re THEN hi ELSE z END, k + 1 FROM (SELECT *, {J0.replace('Z', 'z')} AS jz FROM (SELECT *, (lo + hi) / 2 AS z FROM bi WHERE k < 40))),
ve AS (SELECT ro.*, CASE WHEN ro.re < 1 AND ro.re > {passive.J0_LEAST!r} THEN 2 * pi() * ro.f * r / ((lo + hi) / 2) END AS v FROM ro JOIN bi ON ro.a = bi.a AND ro.i = bi.i AND ro.j = bi.j AND ro.f = bi.f AND k = 40),
wh AS (SELECT a, f, regr_slope(re, r) AS slope, sqrt(avg(re ** 2)) AS rr, sqrt(avg(im ** 2)) AS ii FROM ve GROUP BY a, f), ri AS (SELECT a, f, ring, quantile_cont(v, 0.5) AS v, avg(r) AS r, avg(re) AS rho FROM ve GROUP BY a, f, ring),
sp AS (SELECT a, f, CASE WHEN count(v) >= 2 THEN stddev_pop(v) / avg(v) END AS ratio, CASE WHEN count(v) >= 2 THEN regr_slope(ln(v), ln(r)) END AS trend, count(*) AS n, min(rho) AS least, min(r) AS inner_r FROM ri GROUP BY a, f),
gz AS (SELECT a, f, inner_r, c, rho, 2 * pi() * f * r / c AS z FROM ri JOIN sp USING (a, f), (SELECT 100.0 + k * 50 AS c FROM range(39) t(k)) WHERE n >= 3 AND least <= -0.15), gj AS (SELECT *, {J0.replace('Z', 'z')} AS j FROM gz),
su AS (SELECT a, f, inner_r, c, sum(rho * j) AS vj, sum(j * j) AS jj, sum(rho * rho) AS vv, count(*) AS k FROM gj GROUP BY a, f, inner_r, c), am AS (SELECT *, least(greatest(CASE WHEN jj > 0 THEN vj / jj ELSE 0 END, 0), 1) AS am FROM su),
re AS (SELECT *, round(sqrt(greatest((vv - 2 * am * vj + am * am * jj) / k, 0)), 9) AS res FROM am), be AS (SELECT * FROM re QUALIFY row_number() OVER (PARTITION BY a, f ORDER BY res, c) = 1),
ot AS (SELECT r.a, r.f, min(r.res) AS other FROM re r JOIN be b ON r.a = b.a AND r.f = b.f WHERE abs(r.c / b.c - 1) > 0.2 GROUP BY r.a, r.f),
go AS (SELECT be.a, be.f, c FROM be LEFT JOIN ot ON ot.a = be.a AND ot.f = be.f WHERE c > 100 AND c < 2000 AND res <= 0.4 AND am >= 0.3 AND inner_r * be.f / c <= {passive.J0_LEAST_AT / (2 * math.pi)!r} AND (other IS NULL OR other >= 1.05 * greatest(res, 1e-6)))
SELECT wh.a, round(wh.f, 6)::DOUBLE AS f, round(slope, 6) AS slope, round(ratio, 5) AS velocity_ratio, round(trend, 5) AS velocity_slope, coalesce(slope < 0 AND ratio < 0.35 AND trend < 0.5, false) AS first_lobe, c IS NOT NULL AND ii <= 1.5 * rr AS multi_lobe, CASE WHEN ii <= 1.5 * rr THEN c END::DOUBLE AS multi_lobe_velocity
FROM wh JOIN sp USING (a, f) LEFT JOIN go ON go.a = wh.a AND go.f = wh.f""")
def separation_test(spark, sf_dir):
    """Coherency against separation for each array and frequency of all windows; limits wide enough for noise to pass some."""
    coh = array_coherency(spark, sf_dir)
    nodes = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate([(0.0, 0.0), (30.0, 4.0), (-12.0, 25.0), (9.0, -21.0)])], "node long, x double, y double")
    pairs = passive.separations(coh.select("a").distinct().crossJoin(F.broadcast(nodes)), "node", "x", "y", "a")  # four rows
    out = passive.separation_test(coh, pairs, "a", ring_tolerance=0.0, max_residual=0.4, min_uniqueness=1.05, max_imaginary=1.5, vmin=100.0, vmax=2000.0, dv=50.0).drop("usable")
    return r6(out, "f", "slope").withColumns({c: F.round(c, 5) for c in ("velocity_ratio", "velocity_slope")})


@query(f"""WITH w AS (SELECT event_type AS node, epoch_us(ts) // 86400000000 AS d, stddev_pop(value) AS rms FROM events GROUP BY node, d), s AS (SELECT *, avg(rms) OVER (PARTITION BY node ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS level FROM w)
SELECT d, round(min(rms / level), 6) AS score, count(*) AS nodes FROM s WHERE level > 0 GROUP BY d HAVING count(*) >= 5 AND min(rms / level) >= 0.9""")
def event_windows(spark, sf_dir):
    """Days on which the deviation of every node's values is near its running level or above; the table of ``event_stream``."""
    out = stream_events.events(table(spark, sf_dir, "events"), "event_type", "ts", "value", "1 day", 5, 0.9)
    return r6(out.select(F.floor(seconds("start") / 86400).alias("d"), "score", "nodes"), "score")


@query(f"WITH {PRISM}, pq AS (SELECT pr.*, p_retailprice AS w FROM pr JOIN part ON p_partkey = cell) SELECT station, round(sum(w * ({_corner('X / 2 * ln(X * X + Z * Z) + Z * atan2(X, Z)')}) * {2 * 6.674e-11 * 1e5!r}), 9) AS gz FROM pq GROUP BY station")
def gravity_forward(spark, sf_dir):
    """Gravity of all parts as cells whose density is their price."""
    p = table(spark, sf_dir, "part")
    cells = p.selectExpr("p_partkey AS cell", "p_partkey % 40 * 2.5D AS x0", "p_partkey % 40 * 2.5D + 2.5D AS x1", "p_size + 1D AS z0", "p_size + 3.5D AS z1")
    at = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS station", "double(s_suppkey) AS x", "0D AS z")
    out = potential.effect(at, cells, "station", "x", "z", scalar.gravity_prism, p.selectExpr("p_partkey AS cell", "p_retailprice AS property"))
    return out.select("station", F.round("value", 9).alias("gz"))


@query(f"""WITH {IMAGE}, b AS (SELECT shot, f, arg_min(c, (-round(energy, 9), c)) AS velocity FROM im GROUP BY shot, f) SELECT shot, f, velocity FROM b WHERE f BETWEEN 20 AND 60 AND velocity / f BETWEEN 3 AND 8""")
def dispersion_clipped(spark, sf_dir):
    """Picks within a band of frequencies and of wavelengths."""
    picks = seismic.pick_max(image(spark, sf_dir), ["shot", "f"])
    return seismic.clipped(picks, "f", "velocity", (20.0, 60.0), (3.0, 8.0)).select("shot", "f", "velocity")


_R = {"hcp": "1 / sqrt(4 * Z * Z + 1)", "vcp": "(sqrt(4 * Z * Z + 1) - 2 * Z)"}
_RS = {k: (lambda z, r=r: "(" + r.replace("Z", f"({z})") + ")") for k, r in _R.items()}


@query(f"""WITH {EV}, e AS (SELECT seq, value, seq % 40 / 20.0 AS h, seq % 40 / 20.0 / 1.66 AS z, 0.5 + seq % 7 AS t FROM ev)
SELECT seq, round(value / (-0.5 * (8 * z * z - 1) / pow(4 * z * z + 1, 2.5) * 1e6), 9) AS hcp_susceptibility, round(value / (-0.5 / pow(4 * z * z + 1, 1.5) * 1e6), 9) AS vcp_susceptibility,
round(1.66 * sqrt((1 / pow(0.3 * {_RS['hcp']('z')}, 2) - 1) / 4) - h, 6) AS hcp_depth, round(1.66 * (1 - pow(0.3 * {_RS['vcp']('z')}, 2)) / (4 * 0.3 * {_RS['vcp']('z')}) - h, 6) AS vcp_depth,
round((0.02 * ({_RS['hcp']('z')} - {_RS['hcp']('(h + t) / 1.66')}) + 0.1 * {_RS['hcp']('(h + t) / 1.66')}) / {_RS['hcp']('z')}, 9) AS hcp_layered, round((0.02 * ({_RS['vcp']('z')} - {_RS['vcp']('(h + t) / 1.66')}) + 0.1 * {_RS['vcp']('(h + t) / 1.66')}) / {_RS['vcp']('z')}, 9) AS vcp_layered FROM e""")
def em_closed_forms(spark, sf_dir):
    """Susceptibility, depth of investigation and the reading over two layers, for both orientations of the coils."""
    h, t = F.col("seq") % 40 / 20.0, F.col("seq") % 7 + 0.5
    out = {}
    for o in ("HCP", "VCP"):
        out[f"{o.lower()}_susceptibility"] = F.round(scalar.lin_susceptibility(F.col("value"), 1.66, h, o), 9)
        out[f"{o.lower()}_depth"] = F.round(scalar.investigation_depth(1.66, h, o), 6)
        out[f"{o.lower()}_layered"] = F.round(scalar.layered_conductivity([F.lit(0.02), F.lit(0.1)], [t], h, 1.66, o), 9)
    return events(spark, sf_dir).select("seq", *[v.alias(k) for k, v in out.items()])
