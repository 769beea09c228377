"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A document's set is its distinct word shingles (64-bit hashes). Two sets with Jaccard similarity t or more share a
token among the first ``n - ceil(t * n) + 1`` tokens of each under *every* global order of the tokens. Order 1 puts
tokens that many documents have (``heavy``) last and generates candidates by an equi-join on prefix tokens with the
length and the positional filter; orders 2 and 3 (the same two classes, other hashes) must share a prefix token as
well, and the part of the sets in a fixed quarter of the token space must not differ by more than whole sets may;
what is left is verified on the whole sets.

Exact copies are one class (the hash of the whole set). In a bucket of documents with a common prefix token all are
first compared with one hub, that with the fewest rarer tokens, the likely original of near copies; then only pairs from different components are, so a large group of near copies costs
a row per document and bucket, not one per pair. Nothing is capped: the heavy tokens only steer the order, and
the result is the same for any choice of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import components, discard, materialise, narrow_batches, small
from ._words import chunks, distinct, mix, released, shingles, text_bytes, whole, words

#: Documents that share a token before the orders put it last, and the most tokens put last (8 MB broadcast).
HEAVY_DOCS, MOST_HEAVY = 8, 1 << 20
#: Pairs of one centre that meet in one place; a centre with more is sent to several.
AT_ONCE = 32
#: Bits of the fixed-size table by which the executors skip texts that no candidate pair needs (8 MB broadcast).
TABLE_BITS = 26


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _prefix(grams: np.ndarray, heavy: np.ndarray, p: int) -> tuple[np.ndarray, int]:
    """The first ``p`` tokens, tokens that aren't heavy by value, then heavy ones by value; and how many aren't heavy."""
    last = _in(heavy, grams)
    light = grams[~last][:p]
    return np.concatenate([light, grams[last][: p - len(light)]]), len(light)


def _under(grams: np.ndarray, heavy: np.ndarray, p: int, seed: int) -> np.ndarray:
    """The prefix under another order, as 32-bit values: heavy tokens last, each class by a seeded hash."""
    key = mix(grams.view(np.uint64) + np.uint64(seed))
    return key[np.lexsort((key, _in(heavy, grams)))[:p]].astype(np.uint32).view(np.int32)


def _sample(grams: np.ndarray) -> np.ndarray:
    """A quarter of the token space as 32-bit values: two sets differ at least by what differs in it."""
    key = mix(grams.view(np.uint64) + np.uint64(4))
    return distinct(key[key >> np.uint64(62) == 0].astype(np.uint32).view(np.int32))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _rows(batches: Iterator[pa.RecordBatch], k: int, make, columns: list[str], id_: bool = False) -> Iterator[pa.RecordBatch]:
    """``make(node, grams)`` gives a tuple of column values, or None for no row; arrays become lists.

    ``grams`` are the sorted distinct 64-bit hashes of the ``k``-word shingles; a shorter sequence of words is one
    shingle, no words are none. ``node`` is a hash of all of them, null for none. With ``id_`` the first column of the
    batch, whatever its type, comes first.
    """
    for batch in batches:
        ids, (data, offsets) = batch.column(0), text_bytes(batch.column(1))
        for first, last in chunks(offsets):
            h, _, _, at = words(data, offsets[first : last + 1])
            g = shingles(h, k).view(np.int64)
            held: list[tuple] = []
            of: list[int] = []
            for row, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True), first):
                own = distinct(g[i : j - k + 1]) if j - i >= k else whole(h[i:j]).view(np.int64) if j > i else g[:0]
                node = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None
                if (made := make(node, own)) is not None:
                    held.append(made)
                    of.append(row)
            if held:
                out = _arrays(held, columns)
                names = ["id", *columns] if id_ else columns
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *out] if id_ else out, names)


def _arrays(held: list[tuple], columns: list[str]) -> list[pa.Array]:
    cols = zip(columns, zip(*held, strict=True), strict=True)
    return [_lists(list(c)) if isinstance(c[0], np.ndarray) else pa.array(c, pa.int32() if name in ("n", "light") else pa.int64()) for name, c in cols]


def _of_heads(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, length, ready: bool) -> Iterator[pa.RecordBatch]:
    """From (node, rep, n, head): node, n, light, prefix of the classes whose head holds the prefix, or else node, rep of the others."""
    for batch in batches:
        head, n = batch.column("head"), batch.column("n").to_numpy()
        flat = head.flatten().to_numpy()
        last = _in(heavy, flat)
        at = np.concatenate([[0], np.cumsum(head.value_lengths().to_numpy())])
        light = np.diff(np.concatenate([[0], np.cumsum(~last)])[at])
        fits = (light >= np.array([length(x) for x in n], np.int64)) | (np.diff(at) == n)
        if not ready:
            yield batch.filter(pa.array(~fits)).select(["node", "rep"])
            continue
        held = [(node, size, *_prefix(flat[i:j], heavy, length(size))[::-1]) for node, size, i, j, ok in zip(batch.column("node").to_pylist(), n.tolist(), at[:-1], at[1:], fits, strict=True) if ok]
        if held:
            yield pa.RecordBatch.from_arrays(_arrays(held, PREFIX), PREFIX)


PREFIX = ["node", "n", "light", "prefix"]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: tuple[int, int] = (90, 100), heavy_docs: int = HEAVY_DOCS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, component_id (the smallest id reachable by links, its own included).

    Documents link if ``den * |A & B| >= num * |A | B|`` on their sets of ``k``-word shingles. Null or empty texts and
    texts without words have no shingles and link with nothing; texts of any length are taken whole. Ids may have any
    type that has an order, and keep it. Rows that repeat an id each get a row; equal sets are one class. A row with a
    null id gets the component of equal sets that have an id, else null. Other columns aren't read, whatever their
    names. An empty table gives an empty result.
    """
    spark, (num, den) = docs.sparkSession, threshold
    narrow_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def length(n: int) -> int:
        return prefix_length(n, num, den)

    # Sets: class and size of every row, and the tokens of lowest hash, which hold the prefix unless many are heavy.
    def heads(batches):
        return _rows(batches, k, lambda node, g: (node, len(g), g[: length(len(g)) * 3 // 2 + 8]), ["node", "n", "head"], id_=True)

    wide = materialise(texts.mapInArrow(released(heads), f"id {kind}, node long, n int, head array<long>"), "jaccard-heads")
    of_class = wide.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("head").alias("head"), F.count(F.lit(1)).alias("c"))
    by_head = materialise(of_class, "jaccard-classes")
    rows = materialise(wide.select("id", "node", "n"), "jaccard-rows")
    classes = materialise(by_head.select("node", "rep", "c"), "jaccard-nodes")
    discard(wide)

    def reread(nodes: DataFrame, make, columns: list[str], schema: str) -> DataFrame:
        """``make`` on one text of each of ``nodes`` (node, rep): a table of fixed size says which texts may be meant."""
        bit = F.pmod(F.xxhash64("rep"), F.lit(1 << TABLE_BITS))
        table = nodes.select((bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        bits = np.zeros(1 << TABLE_BITS - 6, np.int64)
        bits[table.column(0).to_numpy()] = table.column(1).to_numpy()
        bits = spark.sparkContext.broadcast(bits)

        def flagged(batches):
            for batch in batches:
                at = batch.column(2).to_numpy()
                yield batch.filter(pa.array((bits.value[at >> 6] >> (at & 63)) & 1 == 1)).select([0, 1])

        flags = texts.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << TABLE_BITS)).alias("bit"))
        read = flags.mapInArrow(released(lambda batches: _rows(flagged(batches), k, lambda node, g: make(node, g) if len(g) else None, columns, id_=True)), f"id {kind}, {schema}")
        named = small(nodes.select(F.col("node").alias("of"), "rep"))
        found = materialise(read.join(named, (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi").drop("id"), "jaccard-sets")
        if found.count() > nodes.count():  # rows that repeat an id and its text
            found, many = materialise(found.dropDuplicates(["node"]), "jaccard-sets"), found
            discard(many)
        return found

    def frequent(tokens: DataFrame) -> np.ndarray:
        many = tokens.groupBy("token").count().where(F.col("count") > heavy_docs)
        most = many.orderBy(F.desc("count"), "token").limit(MOST_HEAVY).select("token").toArrow()
        return np.sort(most.column(0).to_numpy()).astype(np.int64)

    def beyond(last) -> DataFrame:
        """Classes whose head doesn't hold the prefix."""
        return materialise(by_head.mapInArrow(released(lambda batches: _of_heads(batches, last.value, length, False)), f"node long, rep {kind}"), "jaccard-dense")

    heavy = frequent(by_head.select(F.explode("head").alias("token")))
    last = spark.sparkContext.broadcast(heavy)
    dense = beyond(last)
    if dense.count():  # all tokens of their texts are counted
        whole_sets = reread(dense, lambda node, g: (node, g), ["node", "grams"], "node long, grams array<long>")
        heavy = np.union1d(heavy, frequent(whole_sets.select(F.explode("grams").alias("token"))))[: MOST_HEAVY * 2]
        last = spark.sparkContext.broadcast(heavy)
        discard(dense, whole_sets)
        dense = beyond(last)

    # Order 1: prefix tokens of one text of each class, with position; buckets of two classes or more get a hub.
    prefixes = by_head.mapInArrow(released(lambda batches: _of_heads(batches, last.value, length, True)), "node long, n int, light int, prefix array<long>")
    if dense.count():

        def of_text(node, g):
            prefix, light = _prefix(g, last.value, length(len(g)))
            return node, len(g), light, prefix

        prefixes = prefixes.unionAll(reread(dense, of_text, PREFIX, "node long, n int, light int, prefix array<long>"))
    entries = prefixes.select("node", "n", "light", F.posexplode("prefix").alias("pos", "token"))
    hub, own = F.min(F.struct("pos", "n", "node")), F.min(F.struct("pos", "node"))
    # Few classes share a token that isn't heavy: one shuffle, and windows. Heavy ones are counted before the shuffle.
    in_bucket, of_size = Window.partitionBy("token"), Window.partitionBy("token", "n")
    rare = entries.where("pos < light").select("token", "node", "n", "pos").repartition("token")
    rare = rare.select("*", own.over(of_size).alias("own"), hub.over(in_bucket).alias("hub"), F.count(F.lit(1)).over(in_bucket).alias("c"), F.lit(True).alias("rare"))
    many = materialise(entries.where("pos >= light").select("token", "node", "n", "pos"), "jaccard-heavy")
    # Copies cut in different ways have centres of their own: a second hub for each size of set in a bucket.
    hubs = materialise(many.groupBy("token").agg(hub.alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-hubs")
    owns = materialise(many.groupBy("token", "n").agg(own.alias("own")), "jaccard-owns")
    often = many.join(small(hubs), "token").join(small(owns), ["token", "n"])
    shared = rare.unionByName(often.withColumn("rare", F.lit(False))).where("c > 1")
    shared = materialise(shared.selectExpr("token", "node", "n", "pos", "rare", "hub.node AS hnode", "hub.n AS hn", "hub.pos AS hpos", "own.node AS onode", "own.pos AS opos"), "jaccard-buckets")
    discard(by_head, many, hubs, owns)

    def near(n1, p1, n2, p2):
        """Length and positional filter: nothing before the first common token is common, and all of it differs."""
        return (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & ((num + den) * F.least(n1 - p1, n2 - p2) >= num * (n1 + n2)) & ((num + den) * (p1 + p2) <= (den - num) * (n1 + n2))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose prefixes under orders 2 and 3 share a token and whose sets reach the threshold."""
        pairs = materialise(pairs, "jaccard-pairs")
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        ends = materialise(ends.join(classes.select("node", "rep"), "node"), "jaccard-ends")

        def make(node, g):
            p = length(len(g))
            return node, len(g), g, _under(g, last.value, p, 2), _under(g, last.value, p, 3), _sample(g)

        full = reread(ends, make, ["node", "n", "grams", "o2", "o3", "some"], "node long, n int, grams array<long>, o2 array<int>, o3 array<int>, some array<int>")

        def both(some: DataFrame, *columns: str) -> DataFrame:
            """The pairs with columns of both ends: those of b come to a, those of a once for each ``AT_ONCE`` pairs."""
            share = F.ceil(F.count(F.lit(1)) / AT_ONCE).cast("int").alias("shares")
            centres = materialise(some.groupBy("a").agg(share), "jaccard-centres")
            dealt = some.join(small(centres), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
            x, y = (full.select(*[F.col(c).alias(f"{c}{i}") for c in ("node", *columns)]) for i in (1, 2))
            x = x.join(small(centres), F.col("node1") == F.col("a")).drop("node1").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            y = y.join(small(dealt), F.col("node2") == F.col("b")).drop("node2")
            return x.join(y, ["a", "share"])

        differ = F.size("some1") + F.size("some2") - 2 * F.size(F.array_intersect("some1", "some2"))
        few = both(pairs, "n", "o2", "o3", "some").where(F.arrays_overlap("o21", "o22") & F.arrays_overlap("o31", "o32") & ((num + den) * differ <= (den - num) * (F.col("n1") + F.col("n2"))))
        few = materialise(few.select("a", "b"), "jaccard-few")
        common = F.size(F.array_intersect("grams1", "grams2"))
        sure = both(few, "n", "grams").where(den * common >= num * (F.col("n1") + F.col("n2") - common))
        found = materialise(sure.select("a", "b"), "jaccard-links")
        discard(pairs, ends, full, few)
        return found

    to_hub = shared.where("node <> hnode").where(near(F.col("n"), F.col("pos"), F.col("hn"), F.col("hpos")))
    to_own = shared.where("node <> onode AND onode <> hnode").where(near(F.col("n"), F.col("pos"), F.col("n"), F.col("opos")))
    tried = to_hub.selectExpr("hnode AS a", "node AS b").unionAll(to_own.selectExpr("onode AS a", "node AS b"))
    tried = tried.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.col("a") < F.col("b")).alias("forward"))
    links = linked(tried.selectExpr("if(forward, x, y) AS a", "if(forward, y, x) AS b"))
    labels = components(links, "jaccard-labels")

    known = shared.join(small(labels), "node", "left").select("token", "node", "n", "pos", "rare", F.coalesce("root", "node").alias("root"))
    rare = known.where("rare").repartition("token").withColumn("open", F.min("root").over(in_bucket) < F.max("root").over(in_bucket)).where("open").drop("open")
    often = known.where("NOT rare")
    mixed = materialise(often.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token"), "jaccard-mixed")
    open_ = materialise(rare.unionByName(often.join(small(mixed), "token", "left_semi")).drop("rare"), "jaccard-open")
    x, y = (open_.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("node", "n", "pos", "root")]) for i in (1, 2))
    cross = x.join(y, (x["token"] == y["token"]) & (F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & near(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2")))
    links = links.unionAll(linked(cross.selectExpr("node1 AS a", "node2 AS b").distinct()))
    discard(shared, open_, mixed, labels)
    labels = components(links, "jaccard-labels")

    # Only copies and linked classes have another id than their own.
    placed = labels.join(classes.select("node", "rep"), "node")
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked_classes = placed.join(named, "root").select("node", "component_id")
    of_class = classes.where("c > 1").select("node", "rep").join(linked_classes, "node", "full").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(small(materialise(of_class, "jaccard-named")), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
