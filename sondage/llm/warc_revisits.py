"""WARC: not-modified revisits resolved to the latest earlier full response of the same canonical URL.

The as-of join is two-level, so that a URL with a third of all captures doesn't meet in one task: within a URL captures
are dealt to buckets of time; a bucket's last response is an aggregate, the last response before a bucket is a window
over the few bucket rows, and only captures of one bucket are ordered together. A response goes to each bucket that has
revisits of it, where it meets them. Validators (ETag, Last-Modified) of
the revisit are checked against the response, and the headers that a 304 may update are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query parameters that name a campaign or a session, and default ports and index pages: not part of a canonical URL.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)"
#: Headers that describe the stored payload or the connection; a 304 must not change them.
KEPT_FROM_RESPONSE = ["content-length", "content-encoding", "content-type", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization", "proxy-connection", "set-cookie"]


def canonical_url(url: Column) -> Column:
    """Scheme, user, www or m prefix, default port, fragment, tracking parameters, index page and last slash dropped; host in lower case, parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^[^@]*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^((www\d*|m)\.)+", ""), r"\.$", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/(index|default)\.(html?|php|aspx?)$", "/"), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def latest_before(records: DataFrame, key: str, at: str, record: str, is_response: str, bucket: float) -> DataFrame:
    """(record, key, at, response, response_at): for each row that isn't a response the last response of its key that is earlier.

    Ties in time: a response at the same time isn't earlier; of responses at one time the largest record counts.
    """
    r = records.withColumn("_b", F.floor(F.col(at) / F.lit(float(bucket))))
    last = F.struct(F.col(at).alias("at"), F.col(record).alias("response"))
    ends = r.where(is_response).groupBy(key, "_b").agg(F.max(last).alias("_end"))
    asked = r.where(f"NOT {is_response}").select(key, "_b").distinct()
    marks = ends.select(key, "_b", "_end").unionByName(asked.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    marks = marks.groupBy(key, "_b").agg(F.max("_end").alias("_end"))
    before = marks.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_b", "_before")
    inside = Window.partitionBy(key, "_b").orderBy(F.col(at)).rangeBetween(Window.unboundedPreceding, -1)
    own = r.withColumn("_own", F.max(F.when(F.col(is_response), last)).over(inside)).where(f"NOT {is_response}")
    found = F.coalesce("_own", "_before")
    return own.join(before, [key, "_b"], "left").select(record, key, at, found["response"].alias("response"), found["at"].alias("response_at")).distinct()


def resolve(records: DataFrame, bucket: float = 1000.0, with_payload: bool = False) -> DataFrame:
    """One row per revisit: record_id, url_key, response_id, outcome, headers (merged) and, if asked for, payload.

    ``records``: record_id (any type that has an order), url, ts (bigint), kind ("response" or "revisit"), status (int),
    headers (map of strings) and payload; others aren't read, whatever their names. Full responses have kind "response"
    and status 200. Rows that repeat a revisit each get a row; of responses that repeat id, URL and time the one with
    the largest headers and payload counts. outcome:
    "etag" or "modified" (that validator agrees; the strong one decides), "mismatch", "no validator" (nothing to
    compare) or "no response". Headers are merged for all but mismatches and missing responses, which keep their own.
    Header names don't depend on case; of names that differ in case only, the last in order counts. Null urls, times
    and ids never match; revisits of null ids are left out; null and empty headers are none. Payloads of any length
    are whole. Empty tables give empty results.
    """
    names = F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    merged = F.aggregate(names, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    base = records.where("record_id IS NOT NULL").select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("kind"), merged.alias("h"), ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"), *(["payload"] if with_payload else []))
    used = base.where("full OR kind = 'revisit'")
    light = used.where("url_key IS NOT NULL AND ts IS NOT NULL").select("record_id", "url_key", "ts", "full")
    found = latest_before(light, "url_key", "ts", "record_id", "full", bucket)
    revisits = used.where("NOT full").select("record_id", "url_key", "ts", F.col("h").alias("rh")).join(found, ["record_id", "url_key", "ts"], "left")
    stored = F.max(F.struct(F.array_sort(F.map_entries("h")).alias("h"), *(["payload"] if with_payload else []))).alias("stored")
    target = used.where("full").groupBy(F.col("record_id").alias("response"), "url_key", F.col("ts").alias("response_at")).agg(stored)
    target = target.select("response", "url_key", "response_at", F.map_from_entries("stored.h").alias("h"), *([F.col("stored.payload")] if with_payload else []))
    # A response with a third of all revisits meets them bucket by bucket of their time, once for each.
    one = ["response", "url_key", "response_at"]
    revisits = revisits.withColumn("_b", F.floor(F.col("ts") / F.lit(float(bucket))))
    spread = target.join(revisits.where("response IS NOT NULL").select(*one, "_b").distinct(), one)
    both = revisits.join(spread, [*one, "_b"], "left")
    tag = lambda m: F.regexp_replace(F.col(m)["etag"], "^W/", "")
    e1, e2, m1, m2 = tag("rh"), tag("h"), F.col("rh")["last-modified"], F.col("h")["last-modified"]
    checked = F.when(F.col("response").isNull(), "no response").when(e1.isNotNull() & e2.isNotNull(), F.when(e1 == e2, "etag").otherwise("mismatch")).when(m1.isNotNull() & m2.isNotNull(), F.when(m1 == m2, "modified").otherwise("mismatch")).otherwise("no validator")
    allowed = F.map_filter("rh", lambda k, _: ~k.isin(KEPT_FROM_RESPONSE))
    kept = F.map_filter("h", lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    out = both.withColumn("outcome", checked)
    headers = F.when(F.col("outcome").isin("mismatch", "no response"), F.col("rh")).otherwise(F.map_concat(kept, allowed))
    good = ~F.col("outcome").isin("mismatch", "no response")
    return out.select("record_id", "url_key", F.col("response").alias("response_id"), "outcome", headers.alias("headers"), *([F.when(good, F.col("payload")).alias("payload")] if with_payload else []))
