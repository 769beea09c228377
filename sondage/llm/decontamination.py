"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The benchmark items are the indexed sets, the documents the queries; items of equal sets are one entry. Entries fall into
partitions by the power of two of their number of shingles. In a partition an entry's sketch is its s smallest shingle
hashes (bottom-k MinHash), shingles that more than ``COMMON`` entries have after all others; s is twice what a single
sure match takes, 2 (upper - ceil(t upper) + 1) for the partition's largest size. A document's sketch is those of its
hashes that are in the sketch of an entry. A document that holds a share t or more of an entry of n shingles misses
n - ceil(t n) of them at most, so it shares at least s less that many of the sketch: pairs that share fewer, such as
documents with a prompt that many items begin with, aren't candidates, and none that counts is lost. Candidates are
verified on all shingles of their entry. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, lower_ascii, materialise, small, word_shingles, words_of

#: Rows of sketch or item tokens that are broadcast (16 bytes each); beyond it the join shuffles.
MOST_TOKENS = 1_000_000
#: Entries that share a shingle before the sketches put it last.
COMMON = 8


def _tokens(text, k: int):
    return F.array_distinct(word_shingles(words_of(lower_ascii(text)), k))


def item_sets(items: DataFrame, item_id: str, text_col: str, k: int) -> DataFrame:
    """(item_id, entry, tokens): the shingles of each item, and the same ``entry`` for items of equal sets.

    Rows that repeat an id are one item; null ids, and null and empty texts, are left out. No items give no rows.
    """
    each = items.select(F.col(item_id).alias("item_id"), F.explode(_tokens(F.col(text_col), k)).alias("token"))
    sets = each.where("item_id IS NOT NULL").groupBy("item_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return sets.select("item_id", F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("entry"), "tokens")


def item_index(sets: DataFrame, threshold: float, common: int = COMMON) -> DataFrame:
    """(entry, token, n_item, in_sketch, required) per shingle of an entry of ``item_sets``; no sets give no rows."""
    entries = sets.groupBy("entry").agg(F.first("tokens").alias("tokens"))  # equal in all rows of an entry
    need = lambda n: F.ceil(F.lit(threshold) * n - 1e-9)
    n = F.size("tokens")
    upper = F.pow(F.lit(2), F.floor(F.log2(n)) + 1).cast("int") - 1
    size = F.least(n, 2 * (upper - need(upper) + 1)).cast("int")
    rows = entries.select("entry", n.cast("long").alias("n_item"), size.alias("s"), (size - (n - need(n))).cast("long").alias("required"), F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > common).select("token", F.lit(True).alias("often"))
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(F.col("often").asc_nulls_first(), "token"))
    return rows.join(often, "token", "left").select("entry", "token", "n_item", (rank <= F.col("s")).alias("in_sketch"), "required")


def candidates(texts: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(doc_id, entry): documents (doc_id, text) that share enough of an entry's sketch; ``index`` is written already."""
    sketch = index.where("in_sketch").select("token", "entry", "required")
    met = texts.select("doc_id", F.explode(_tokens(F.col("text"), k)).alias("token")).join(small(sketch, MOST_TOKENS), "token")
    return met.groupBy("doc_id", "entry", "required").agg(F.count(F.lit(1)).alias("n")).where("n >= required").select("doc_id", "entry")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (``id_col``, item_id, n_item, n_shared, containment): documents that hold ``threshold`` of an item or more.

    Shingles are ``k`` lower-cased (A-Z) words; a shorter text is one shingle as a whole, and texts of any length are
    read whole. Null and empty texts hold nothing and are held by nothing; null ids never match. Rows of one id count
    as one document or item; items with equal texts each have their rows. Ids of any type stay; other columns aren't
    read, whatever their names. An empty table on either side gives an empty result.
    """
    sets = materialise(item_sets(items, item_id, item_text, k), "decon-sets")
    index = materialise(item_index(sets, threshold), "decon-items")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    found = materialise(candidates(texts, index, k), "decon-candidates")

    # Every shingle of a candidate's entry against the document's own: a row for each, never all entries of a shingle.
    wanted = found.join(small(index.select("entry", "token", "n_item"), MOST_TOKENS), "entry")
    again = texts.join(small(found.select("doc_id").distinct()), "doc_id", "left_semi")
    own = again.select("doc_id", F.explode(_tokens(F.col("text"), k)).alias("token")).join(small(index.select("token").distinct(), MOST_TOKENS), "token", "left_semi").distinct()
    shared = own.join(wanted, ["doc_id", "token"]).groupBy("doc_id", "entry", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    share = F.col("n_shared") / F.col("n_item")
    held = shared.where(share >= threshold).join(sets.select("item_id", "entry"), "entry")
    out = materialise(held.select(F.col("doc_id").alias(id_col), "item_id", "n_item", "n_shared", share.alias("containment")), "decon-found")
    discard(sets, index, found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns, rows and null ids that aren't contaminated stay."""
    bad = contaminated(docs, items, id_col, text_col, **options).select(id_col).distinct()
    return docs.join(small(bad), id_col, "left_anti")
