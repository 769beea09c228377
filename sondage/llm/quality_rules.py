"""Quality rules: surface rules on each text, and the frequency of its lines across the documents of its host.

Lines are normalised (A-Z lowered, white space collapsed and trimmed) and hashed; for each host the distinct
documents of a line are counted, where exact copies are one document. Lines above the limit are removed
and a document that loses most of its words is rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, discard, fresh, let, lower_ascii, materialise, small, words_of

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line is removed if more than max(MIN_DOCS, MIN_SHARE * documents of the host) documents have it.
MIN_DOCS, MIN_SHARE = 20, 0.001
#: A document is depleted if fewer than this share of its words, or of this number of them, is left.
MIN_LEFT_SHARE, MIN_LEFT_WORDS = 0.2, 20


def _covered(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array, the first occurrence included."""

    def count(w):
        def starts(hashes):
            def repeated(order):
                same = lambda i, j: F.get(order, i)["h"].eqNullSafe(F.get(order, j)["h"])
                hit = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
                at = F.array_sort(F.transform(hit, lambda i: F.get(order, i)["i"]))
                zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
                step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).cast("long").alias("n"), (p + 3).alias("end"))
                return F.aggregate(at, zero, step, lambda a: a["n"])

            order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(order, repeated)).otherwise(F.lit(0).cast("long"))

        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, let(windows, starts)).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    full = F.length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _covered(w).alias("r")))
    return {
        "n_words": counted["n"],
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (full - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": counted["r"],
    }


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(line), SPACE, " "))


def _lines(text: Column) -> Column:
    """(h, words) of the distinct normalised lines that have a word; words counts all their occurrences."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normal_line), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("words")))


def _host(host_col: str) -> Column:
    """The host as a key: null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host")


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, document_col: str | None = None) -> DataFrame:
    """(host, h, n_docs): lines that more documents of a host have than the limit; none of an empty table.

    Documents are told apart by their text: exact copies are one document, or else a text with a thousand copies would
    count against its own lines and go with all of them. With ``document_col`` they are told apart by that column.
    """
    document = F.xxhash64(F.col(document_col or text_col))
    first = docs.groupBy(_host(host_col), document.alias("t")).agg(F.first(F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: x["h"]))).alias("hs"))
    kept = materialise(first, "rules-lines")
    sizes = kept.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = kept.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    out = materialise(counts.join(sizes, "host").where(F.col("n_docs") > F.lit(min_share) * F.col("host_docs")).select("host", "h", "n_docs"), "rules-frequent")
    discard(kept)
    return out


def removed_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, **limits) -> DataFrame:
    """(id, t, removed_words, removed array<bigint>) of the texts (hash t) with a line above the limit; repeated rows are one, an empty table has none."""
    often = frequent_lines(docs, text_col, host_col, **limits)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), _host(host_col), F.posexplode(_lines(F.col(text_col))).alias("at", "l")).select("id", "t", "host", "at", "l.h", "l.words")
    hits = lines.join(small(often.select("host", "h")), ["host", "h"])
    each = hits.groupBy("id", "t").agg(F.collect_set(F.struct("at", "words")).alias("w"), F.collect_set("h").alias("removed"))
    out = materialise(each.select("id", "t", F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("removed_words"), "removed"), "rules-removed")
    discard(often)
    return out


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Per row of ``docs``: id, n_words, the four base columns, base_failed, removed_words, kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept is false if base_failed,
    else unless lines above the limit take more than 1 - MIN_LEFT_SHARE of the words or leave fewer than
    MIN_LEFT_WORDS. A null or empty text has no words and fails; texts of any length are read whole. Null hosts are one
    host. Rows that repeat an id each get a row and the verdict of their own text; a row with a null id loses no line.
    Ids of any type stay; other columns aren't read, whatever their names. Empty tables give empty results.
    """
    gone = removed_lines(docs, id_col, text_col, host_col, **limits).select("id", "t", "removed_words")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), *[c.alias(n) for n, c in base_columns(F.col(text_col)).items()])
    out = base.join(gone, ["id", "t"], "left").withColumn("removed_words", F.least(F.coalesce("removed_words", F.lit(0)), "n_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    rich = (left >= MIN_LEFT_SHARE * F.col("n_words")) & (left >= MIN_LEFT_WORDS)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words", (~failed & rich).alias("kept"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` without rejected documents and without the removed lines; all columns as they were but the text.

    Documents that lose no line are unchanged to the character. The verdict is that of ``verdicts``, with the same
    results for nulls, repeated rows, long texts and empty tables; columns of any name stay.
    """
    k, h, r, w = (fresh(docs, x) for x in ("_id", "_t", "_removed", "_removed_words"))
    gone = removed_lines(docs, id_col, text_col, host_col, **limits).select(F.col("id").alias(k), F.col("t").alias(h), F.col("removed_words").alias(w), F.col("removed").alias(r))
    base = base_columns(F.col(text_col))
    n, rep = base["n_words"], base["n_repeat_words"]
    passed = docs.where((n >= 50) & (100 * rep <= 50 * n))
    joined = passed.join(small(gone), (F.col(id_col) == F.col(k)) & (F.xxhash64(F.col(text_col)) == F.col(h)), "left")
    left = n - F.coalesce(F.col(w), F.lit(0))
    text = F.when(F.col(r).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains(F.col(r), F.xxhash64(normal_line(x)))), "\n"))
    return joined.where(F.col(r).isNull() | ((left >= MIN_LEFT_SHARE * n) & (left >= MIN_LEFT_WORDS))).select(*[(text.alias(c) if c == text_col else F.col(c)) for c in docs.columns])
