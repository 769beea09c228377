"""One query per operator, over whole tables with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, chat_format, decontamination, fingerprints, html_blocks, importance_resampling, jaccard_join, license_scan, lm_scoring, quality_bayes, quality_rules, sp_tokens, warc_revisits
from ._common import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat_format.format_turns(rows.unionAll(control))
    turns = chat_format.read_turns(F.col("formatted"))
    loss = chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = out.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["family"]))), ",")
    return out.select("doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_found"), families.alias("families"), F.size(F.filter("findings", lambda f: f["confirmed"])).cast("long").alias("n_confirmed"), F.coalesce(F.array_max(F.transform("findings", lambda f: f["probability"])), F.lit(0.0)).alias("probability"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: a full response at page_id * 10 and a not-modified revisit of another scheme and tracking tag.

    Revisits of one in seven pages come before their response, one in five has another ETag, one in three no ETag but a
    date, one in eleven neither; one in thirteen responses is an error.
    """
    p = pages.select("page_id", "url", "html")
    tag, date = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.concat(F.lit("day "), (F.col("page_id") % 100).cast("string"))
    full = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    other = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    new = F.create_map(F.lit("Cache-Control"), F.lit("max-age=120"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), (F.col("page_id") * 10).cast("string"))
    sent = F.when(F.col("page_id") % 11 == 0, new).when(F.col("page_id") % 3 == 0, F.map_concat(new, F.create_map(F.lit("last-modified"), date))).otherwise(F.map_concat(new, F.create_map(F.lit("etag"), other)))
    a = p.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 13 == 0, 500).otherwise(200).alias("status"), full.alias("headers"))
    again = F.concat(F.regexp_replace("url", "^https?://", "https://WWW."), F.when(F.col("url").contains("?"), F.lit("&utm_medium=x")).when(F.col("url").contains("#"), F.lit("")).otherwise(F.lit("?utm_medium=x")))
    later = F.when(F.col("page_id") % 7 == 0, -5).otherwise(25)
    b = p.select((F.col("page_id") * 2 + 1).alias("record_id"), again.alias("url"), (F.col("page_id") * 10 + later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent.alias("headers"))
    return a.unionAll(b)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisits.resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return out.select("record_id", "url_key", "response_id", "outcome", lines.alias("headers"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_bayes.quality_posterior(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)
    return scored.select("doc_id", "source", "lang", "evidence", "host_prior", "path_prior", "quality", "kept")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encoded(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: jaccard_join.jaccard_components(table(spark, sf_dir, "documents")), "op8")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: lm_scoring.scores(table(spark, sf_dir, "documents")), "op9")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 9).alias("containment"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(lambda: importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "op11")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: fingerprints.edited(table(spark, sf_dir, "documents")), "op13")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, text AS raw, {WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw_lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, host, raw, l, len(string_split(l, ' ')) AS words FROM (
  SELECT doc_id, host, raw, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l
  FROM (SELECT doc_id, host, raw, unnest(string_split(text, chr(10))) AS l FROM d)) WHERE l <> ''),
hosts AS (SELECT host, count(DISTINCT coalesce(raw, chr(1))) AS n FROM d GROUP BY host),
often AS (SELECT host, l FROM norm JOIN hosts USING (host) GROUP BY host, l, n HAVING count(DISTINCT raw) > {quality_rules.MIN_DOCS} AND count(DISTINCT raw) > {quality_rules.MIN_SHARE} * n),
gone AS (SELECT doc_id, sum(words) AS n FROM norm JOIN often USING (host, l) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, least(coalesce(gone.n, 0), len(w))::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - removed_words AS rest FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND rest >= {quality_rules.MIN_LEFT_SHARE} * n_words AND rest >= {quality_rules.MIN_LEFT_WORDS} AS kept FROM f
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(array_to_string(g, ' '), chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM sig),
rs AS (SELECT s.* FROM s JOIN cls USING (doc_id) WHERE doc_id = rep),
ov AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM ov JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT rep AS x, rep AS y FROM cls UNION SELECT x, b FROM reach JOIN e2 ON y = a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.x = cls.rep
"""

SETS_SQL = r"""{t} AS (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {src}),
{t}_s AS (SELECT DISTINCT {id}, g FROM (
  SELECT {id}, w[i:i+4] AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 3)) AS i FROM {t} WHERE len(w) >= 5)
  UNION ALL SELECT {id}, w FROM {t} WHERE len(w) BETWEEN 1 AND 4))"""

OP10_SQL = f"""
WITH {SETS_SQL.format(t='dd', id='doc_id', src='documents')}, {SETS_SQL.format(t='bb', id='item_id', src='benchmark')},
size AS (SELECT item_id, count(*) AS n FROM bb_s GROUP BY item_id)
SELECT doc_id, item_id, size.n AS n_item, count(*) AS n_shared, round(count(*) / size.n, 9) AS containment
FROM dd_s JOIN bb_s USING (g) JOIN size USING (item_id) GROUP BY doc_id, item_id, size.n HAVING count(*) / size.n >= 0.8
"""

#: Length of a formatted conversation: markers of 8 code points, and a backslash for each escaped character or control string.
OP2_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
  24 + length(role) + length(text) + length(role || text) - length(replace(role || text, chr(92), ''))
  + len(regexp_extract_all(text, '<\||</s>|<s>|\[/?INST\]|<</?SYS>>')) + len(regexp_extract_all(role, '<\||</s>|<s>|\[/?INST\]|<</?SYS>>')) AS size FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || page_id % 100 AS day, length(coalesce(html, '')) AS len FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www[0-9]*|m)\.', '') AS host, regexp_extract(u, '^[^/?]*([^?]*)', 1) AS path, string_split(regexp_extract(u, '\?(.*)$', 1), '&') AS q FROM k),
f AS (SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN len(list_filter(q, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)'))) > 0 THEN '?' || array_to_string(list_sort(list_filter(q, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)'))), '&') ELSE '' END AS key FROM c),
v AS (SELECT page_id * 2 + 1 AS record_id, page_id, tag, day, page_id * 10 + CASE WHEN page_id % 7 = 0 THEN -5 ELSE 25 END AS ts, key FROM f),
r AS (SELECT page_id * 2 AS response_id, page_id * 10 AS ts, tag, day, len, key FROM f WHERE page_id % 13 <> 0),
m AS (SELECT v.*, r.response_id, r.tag AS rtag, r.day AS rday, r.len FROM v LEFT JOIN (SELECT * FROM r) r ON r.key = v.key AND r.ts < v.ts QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY r.ts DESC NULLS LAST, response_id DESC NULLS LAST) = 1),
o AS (SELECT *, CASE WHEN page_id % 11 = 0 THEN 'n' WHEN page_id % 3 = 0 THEN 'd' ELSE 't' END AS has FROM m),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no response' WHEN has = 't' THEN CASE WHEN page_id % 5 <> 0 AND tag = rtag THEN 'etag' ELSE 'mismatch' END WHEN has = 'd' THEN CASE WHEN day = rday THEN 'modified' ELSE 'mismatch' END ELSE 'no validator' END AS outcome,
  CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END AS sent FROM o)
SELECT record_id, key AS url_key, response_id, outcome, CASE WHEN outcome IN ('mismatch', 'no response')
  THEN 'cache-control: max-age=120; content-length: 0; date: ' || page_id * 10 || CASE has WHEN 't' THEN '; etag: ' || sent WHEN 'd' THEN '; last-modified: ' || day ELSE '' END
  ELSE 'cache-control: max-age=120; content-length: ' || len || '; content-type: text/html; date: ' || page_id * 10 || '; etag: ' || CASE has WHEN 't' THEN sent ELSE rtag END || '; last-modified: ' || CASE has WHEN 'd' THEN day ELSE rday END END AS headers
FROM s
"""

#: crc32 of UTF-8 bytes: the table of 256 remainders by its rule (reflected polynomial), then a step per byte.
OP11_SQL = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t),
feat AS (SELECT doc_id AS id, true AS raw, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
  UNION ALL SELECT item_id, false, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
h AS (SELECT f, xor(list_reduce(range(strlen(f)::BIGINT), lambda c, i: xor(c >> 8, t[xor(c & 255, ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT) + 1]), 4294967295::BIGINT), 4294967295) % {importance_resampling.BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM feat), tab),
fb AS (SELECT id, raw, b FROM feat JOIN h USING (f)),
n AS (SELECT b, count(*) FILTER (WHERE raw)::DOUBLE AS s, count(*) FILTER (WHERE NOT raw)::DOUBLE AS t, sum(count(*) FILTER (WHERE raw)) OVER ()::DOUBLE AS big_s, sum(count(*) FILTER (WHERE NOT raw)) OVER ()::DOUBLE AS big_t FROM fb GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((t + 1) * (big_s + {importance_resampling.BUCKETS})) / ((s + 1) * (big_t + {importance_resampling.BUCKETS}))))::BIGINT AS gain FROM n),
w AS (SELECT id, count(*) AS n_features, sum(gain) AS weight FROM fb JOIN g USING (b) WHERE raw GROUP BY id),
x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{importance_resampling.SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w ON id = doc_id),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= {importance_resampling.LEAST_WORDS} AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY able) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {importance_resampling.PERCENT} * n // 100 THEN r END AS rank FROM z
"""


def _op12_sql() -> str:
    """A pair of CTEs per round: every distance, then the floor of every mean."""
    cc = centroid_clustering
    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda v: floor({cc.SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {cc.DIM} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {cc.DIM})""", f"""v AS (SELECT vec_id, unnest(x) AS x, unnest(range({cc.DIM})) AS i FROM kept)""", f"""c0 AS (SELECT j, unnest(x) AS x, unnest(range({cc.DIM})) AS i FROM (SELECT x, row_number() OVER (ORDER BY sha256('{cc.SEED}:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {cc.CLUSTERS}))"""]
    for r in range(cc.ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT vec_id, j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY vec_id, j)")
        parts.append(f"a{r} AS (SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{r} GROUP BY vec_id)")
        if r < cc.ROUNDS:
            parts.append(f"m{r} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY j, i)")
            parts.append(f"c{r + 1} AS (SELECT c.j, c.i, coalesce(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j, i))")
    last = cc.ROUNDS
    return f"""WITH {", ".join(parts)},
s AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY j)
SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{last} JOIN s USING (j)"""


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_chat_formatting, op3_license_scan, op4_warc_revisits, op5_quality_classifier, op6_html_extraction, op7_sentencepiece, op8_jaccard_join, op9_lm_scoring, op10_decontamination, op11_importance_resampling, op12_centroid_clustering, op13_document_fingerprints)}
ORACLE = {"op1_quality_rules": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op4_warc_revisits": OP4_SQL, "op8_jaccard_join": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_centroid_clustering": _op12_sql()}
