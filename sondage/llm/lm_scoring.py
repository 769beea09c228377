"""LM scoring: prediction by partial matching over bytes, pretrained on a part of the corpus, and a word unigram base.

The byte model is a trie of contexts of up to ``ORDER`` bytes with symbol counts, gathered by grouping n-gram counts of
all training texts. A symbol is coded in the longest context of the trie that the text is in; where it wasn't seen
there, the model escapes to the next shorter one (escape estimation C: as many escapes as distinct symbols) and the
symbols of the longer context are excluded from the shorter one's counts. Below the empty context all symbols left
share alike. Texts are their lower-cased (A-Z) words joined by a space, ended by a line feed.

Neither the trie nor the word counts are bounded. What is broadcast is: the log probabilities of the most frequent grams
of ``ORDER`` + 1 bytes (``MOST_NODES``) and the most frequent words (``MOST_WORDS``). All others meet the texts in shuffle
joins; grams that no training text has are looked up order by order in the whole trie, which stays in tables. The bounds
change the speed only. ``trie`` builds the model in memory, for small corpora; ``scores`` doesn't use it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, narrow_batches
from ._words import chunks, released, text_bytes, words

ORDER, MOST_NODES, MOST_WORDS = 5, 1_500_000, 1 << 18
_KEEP = 1 << 21  # distinct keys that a task holds before it passes its counts on
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def is_held_out(row_id) -> bool:
    """crc32 of the id as text, modulo 7, is 2."""
    return row_id is not None and zlib.crc32(str(row_id).encode()) % 7 == 2


class Table:
    """An immutable hash table from 64-bit keys to row numbers, for whole arrays of keys; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(1.5 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            at, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at], self.rows[at] = keys[left[chosen]], left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, got = self.rows[slot], self.keys[slot]
        out[got != keys] = -1
        open_ = np.flatnonzero((got != keys) & (got != _EMPTY))
        while len(open_):
            slot_ = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = slot_
            got = self.keys[slot_]
            hit = got == keys[open_]
            out[open_[hit]] = self.rows[slot_[hit]]
            open_ = open_[~hit & (got != _EMPTY)]
        return out


class Ppm:
    """The trie: per order m the m-grams (context of m - 1 bytes and symbol) with what scoring needs of each context."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """counts: for m = 1 .. order + 1, distinct m-grams as integers and their counts (a gram's suffixes are there too); emptied."""
        self.order, self.grams, self.contexts, self.table, self.context_table = order, {}, {}, {}, {}
        for m in range(1, order + 2):
            codes, n = counts.pop(m, (np.empty(0, np.uint64), np.empty(0)))
            at = np.argsort(codes)
            codes, n = codes[at].astype(np.uint64), n[at].astype(np.float64)
            del at
            context, first, which = np.unique(codes >> np.uint64(8), return_index=True, return_inverse=True)
            total, kinds = np.bincount(which, n, len(context)), np.bincount(which, minlength=len(context)).astype(float)
            self.grams[m] = {"codes": codes, "n": n, "which": which}
            c = self.contexts[m] = {"codes": context, "total": total, "kinds": kinds, "own": np.log10(total + kinds), "escape": np.log10(kinds / (total + kinds))}
            if m > 1:  # what the shorter context is left with once the symbols of this one are excluded
                up = self.grams[m - 1]
                seen = np.searchsorted(up["codes"], codes & np.uint64((1 << 8 * (m - 1)) - 1))
                parent = up["which"][seen]
                gone = np.bincount(which, up["n"][seen], len(context))
                parent_of = np.zeros(len(context), np.int64)
                parent_of[which] = parent
                total_left = self.contexts[m - 1]["total"][parent_of] - gone
                kinds_left = self.contexts[m - 1]["kinds"][parent_of] - kinds
                room = total_left + kinds_left
                c["under"] = np.log10(np.where(room > 0, room, 1))
                c["under_escape"] = np.where(room > 0, np.log10(np.where(kinds_left > 0, kinds_left, 1) / np.where(room > 0, room, 1)), 0.0)
                self.context_table[m] = Table(context)
            if m == order + 1:
                self.grams[m]["direct"] = np.log10(n) - c["own"][which]
            self.table[m] = Table(codes)
            if m > 1:
                for k in ("codes", "n", "which"):
                    del self.grams[m - 1][k]
                for k in ("codes", "total", "kinds"):
                    del self.contexts[m - 1][k]
            self.grams[m]["log"] = np.log10(n) if m <= order else np.empty(0)  # at the top only "direct" is read
        for part, names in ((self.grams[order + 1], ("codes", "n", "which")), (self.contexts[order + 1], ("codes", "total", "kinds"))):
            for k in names:
                del part[k]
        self.rest = -math.log10(max(1, 256 - len(self.grams[1]["log"])))

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order + 1)-gram after the others."""
        top = self.order + 1
        out = np.zeros(len(codes))
        row = self.table[top].find(codes)
        hit = row >= 0
        out[hit] = self.grams[top]["direct"][row[hit]]
        open_ = np.flatnonzero(~hit)
        longer = np.full(len(open_), -1, np.int64)  # row of the context just escaped from
        for m in range(top, 0, -1):
            if not len(open_):
                break
            code = codes[open_] & np.uint64((1 << 8 * m) - 1)
            here = self.context_table[m].find(code >> np.uint64(8)) if m > 1 else np.zeros(len(open_), np.int64) if len(self.contexts[1]["own"]) else np.full(len(open_), -1)
            gram = self.table[m].find(code)
            fresh, known, found = longer < 0, here >= 0, gram >= 0
            above = self.contexts[m + 1] if m < top else None
            under = np.where(fresh, self.contexts[m]["own"][np.maximum(here, 0)] if len(self.contexts[m]["own"]) else 0.0, above["under"][np.maximum(longer, 0)] if above and len(above["own"]) else 0.0)
            out[open_[found]] += self.grams[m]["log"][gram[found]] - under[found]
            miss = known & ~found
            escape = np.where(fresh, self.contexts[m]["escape"][np.maximum(here, 0)] if len(self.contexts[m]["own"]) else 0.0, above["under_escape"][np.maximum(longer, 0)] if above and len(above["own"]) else 0.0)
            out[open_[miss]] += escape[miss]
            open_, longer = open_[~found], np.where(known, here, -1)[~found]
        out[open_] += self.rest
        return out


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(order + 1)-grams of consecutive texts in normal form, the number before each text, and the texts' ``words``."""
    found = h, starts, ends, at = words(data, offsets)
    n_docs, length = len(at) - 1, ends - starts
    # Each text becomes: order line feeds, its words with a space after all but the last, a line feed.
    last = at[1:][at[1:] > at[:-1]] - 1
    space = np.ones(len(h), np.int64)
    space[last] = 0
    before = np.concatenate([[0], np.cumsum(length + space)])
    begin = before[at] + np.arange(n_docs + 1) * (order + 1)
    out = np.full(int(begin[-1]), 10, np.uint8)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    to = before[:-1] + (doc + 1) * (order + 1) - 1
    base = data[int(offsets[0]) : int(offsets[-1])]
    flat = np.arange(int(length.sum()))
    shift = np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    out[np.repeat(to, length) + flat - shift] = _LOWER[base[np.repeat(starts, length) + flat - shift]]
    out[(to + length)[space == 1]] = 32
    wide = out.astype(np.uint64)
    n = len(out) - order
    code = wide[:n].copy()
    for j in range(1, order + 1):
        code = (code << np.uint64(8)) | wide[j : n + j]
    # The gram at i ends at byte i + order; those that end in the padding of a text aren't coded.
    coded = np.ones(n, bool)
    pad = (begin[1:-1, None] + np.arange(order)[None, :] - order).ravel() if n_docs > 1 else np.empty(0, np.int64)
    coded[pad[(pad >= 0) & (pad < n)]] = False
    ends_at = np.cumsum(coded)
    upto = begin[1:] - order
    counts = np.concatenate([[0], ends_at[np.minimum(upto, n) - 1]]) if n_docs else np.zeros(1, np.int64)
    return code[coded], counts, found


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    at = np.argsort(keys, kind="stable")
    keys, n = keys[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    return v[first], np.diff(np.append(first, len(v)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets; an empty run is 0."""
    out = np.add.reduceat(np.append(values, values.dtype.type(0)), offsets[:-1]) if len(offsets) > 1 else values[:0]
    out[offsets[:-1] == offsets[1:]] = 0
    return out


def corpus_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): words (0) and (order + 1)-grams (1) of the rows (id, text) that aren't held out, and their number (2)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        docs = 0

        def out(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for batch in parts:
            batch = batch.filter(pa.array([not is_held_out(x) for x in batch.column(0).to_pylist()], pa.bool_()))
            docs += len(batch)
            data, offsets = text_bytes(batch.column(1))
            for first, last in chunks(offsets):
                code, _, (h, *_) = grams(data, offsets[first : last + 1], order)
                held[0].append(_counted(h))
                held[1].append(_counted(code))
                for kind, got in held.items():
                    if sum(len(x[0]) for x in got) > _KEEP:
                        held[kind] = [_merged(got)]
                        if len(held[kind][0][0]) > _KEEP // 2:
                            yield out(kind, *held[kind].pop())
        for kind, got in held.items():
            if got:
                yield out(kind, *_merged(got))
        if docs:
            yield out(2, np.zeros(1, np.uint64), np.array([docs]))

    each = rows.mapInArrow(released(batches), "kind byte, key long, n long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def trie(counts: DataFrame, order: int = ORDER, most: int = MOST_NODES) -> Ppm:
    """The model from (key, n) of all (order + 1)-grams, with at most ``most`` nodes."""
    masks = F.array(*[F.struct(F.lit(m).alias("m"), F.col("key").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("code")) for m in range(1, order + 2)])
    nodes = materialise(counts.select(F.explode(masks).alias("x"), "n").groupBy("x.m", "x.code").agg(F.sum("n").alias("n")), "lm-nodes")
    sizes = {r["b"]: r["c"] for r in nodes.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, kept = 0, sum(sizes.values())
    while kept > most:
        kept -= sizes.get(least, 0)
        least += 1
    kept_counts = {}
    for k in range(1, order + 2):  # an order at a time: the driver holds one in transit
        got = nodes.where((F.col("m") == k) & (F.col("n") >= 1 << least)).select("code", "n").toArrow()
        kept_counts[k] = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy().astype(np.float32)
        del got
    return Ppm(kept_counts, order)


def _suffix(code: str, m: str) -> Column:
    """The last m bytes of a gram."""
    return F.expr(f"{code} & (shiftleft(1L, 8 * ({m})) - 1)")


def model_tables(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """The whole trie from (key, n) of all (order + 1)-grams.

    (m, code, n) of the m-grams, and of their contexts (m, context, own, escape, under, under_escape), as in ``Ppm``.
    """
    masks = F.array(*[F.struct(F.lit(m).alias("m"), F.col("key").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("code")) for m in range(1, order + 2)])
    nodes = materialise(counts.select(F.explode(masks).alias("x"), "n").groupBy("x.m", "x.code").agg(F.sum("n").alias("n")), "lm-nodes")
    up = nodes.select((F.col("m") + 1).alias("m"), F.col("code").alias("suffix"), F.col("n").alias("up"))
    symbols = nodes.select("m", _suffix("code", "m - 1").alias("suffix"), F.shiftright("code", 8).alias("context"), "n").join(up, ["m", "suffix"], "left")
    each = symbols.groupBy("m", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.coalesce("up", F.lit(0))).alias("gone"))
    each = materialise(each, "lm-totals")
    parent = each.select((F.col("m") + 1).alias("m"), F.col("context").alias("suffix"), F.col("total").alias("total_up"), F.col("kinds").alias("kinds_up"))
    c = each.withColumn("suffix", _suffix("context", "greatest(m - 2, 0)")).join(parent, ["m", "suffix"], "left")
    c = c.withColumn("kinds_left", F.col("kinds_up") - F.col("kinds")).withColumn("room", F.col("total_up") - F.col("gone") + F.col("kinds_left"))
    all_ = F.col("total") + F.col("kinds")
    under_escape = F.when(F.col("room") > 0, F.log10(F.greatest("kinds_left", F.lit(1)) / F.col("room"))).otherwise(0.0)
    return nodes, materialise(c.select("m", "context", F.log10(all_).alias("own"), F.log10(F.col("kinds") / all_).alias("escape"), F.log10(F.greatest("room", F.lit(1))).alias("under"), under_escape.alias("under_escape")), "lm-contexts")


def unseen_scores(unseen: DataFrame, nodes: DataFrame, contexts: DataFrame, rest: float, order: int = ORDER) -> DataFrame:
    """(gram, value) of distinct (order + 1)-grams that no training text has: the last byte after the others, by escapes.

    Each order holds its distinct suffixes only, so no key of a join has more than 256 rows.
    """
    suffixes = F.array(*[F.struct(F.lit(m).alias("m"), F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("code")) for m in range(1, order + 2)])
    codes = unseen.select(F.explode(suffixes).alias("x")).select("x.m", "x.code").distinct()
    known = codes.join(nodes, ["m", "code"], "left").withColumn("context", F.shiftright("code", 8)).join(contexts, ["m", "context"], "left").drop("context")
    known = materialise(known, "lm-unseen")
    below = None  # per suffix: n, fresh (no longer context is known), after (the gram's own context is left)
    for m in range(1, order + 2):
        here = known.where(F.col("m") == m).drop("m")
        if below is None:
            here = here.withColumns({"n_": F.lit(None).cast("long"), "fresh_": F.lit(rest), "after_": F.lit(rest)})
            after = F.lit(rest)
        else:
            down = below.select(F.col("code").alias("suffix"), F.col("n").alias("n_"), F.col("fresh").alias("fresh_"), F.col("after").alias("after_"))
            here = here.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(down, "suffix")
            after = F.when(F.col("n_").isNotNull(), F.log10("n_") - F.col("under")).otherwise(F.col("under_escape") + F.col("after_"))
        fresh = F.when(F.col("n").isNotNull(), F.log10("n") - F.col("own")).when(F.col("own").isNull(), F.col("fresh_")).otherwise(F.col("escape") + after)
        below = here.select("code", "n", fresh.alias("fresh"), after.alias("after"))
    return below.select(F.col("code").alias("gram"), F.col("fresh").alias("value"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end; base_score sums log10((c + 1) / (N + 1 * (V + 1))), score is the log10
    probability of the text under the byte model. Null and empty texts have the end token alone, texts of any length
    are scored whole; ids of any type stay, a null id is never held out. Without training texts N and V are 0 and the
    byte model is uniform. Rows that repeat an id each get a row and count each in training. Other columns aren't read,
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counts = materialise(corpus_counts(rows, order), "lm-counts")
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_docs = sums.get(2, (0, 0))[0]
    n_train = sums.get(0, (0, 0))[0] + n_docs
    room = n_train + sums.get(0, (0, 0))[1] + (n_docs > 0) + 1
    word_counts = counts.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    top = word_counts.orderBy(F.desc("c"), "word").limit(MOST_WORDS).toArrow()
    keys, top_n = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy()
    nodes, contexts = model_tables(counts.where("kind = 1").select("key", "n"), order)
    sizes = {(r["m"], r["b"]): r["c"] for r in nodes.where(F.col("m").isin(1, order + 1)).groupBy("m", F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    rest = -math.log10(max(1, 256 - sum(c for (m, _), c in sizes.items() if m == 1)))
    least, kept = 0, sum(c for (m, _), c in sizes.items() if m > 1)
    while kept > MOST_NODES:
        kept -= sizes.get((order + 1, least), 0)
        least += 1
    own = contexts.where(F.col("m") == order + 1).select("context", "own")
    seen = nodes.where(F.col("m") == order + 1).withColumn("context", F.shiftright("code", 8)).join(own, "context")
    seen = materialise(seen.select(F.col("code").alias("gram"), "n", (F.log10("n") - F.col("own")).alias("value")), "lm-grams")
    often = seen.where(F.col("n") >= 1 << least).select("gram", "value").toArrow()
    gram_keys, gram_logs = often.column(0).to_numpy().astype(np.uint64), often.column(1).to_numpy().astype(np.float64)
    shared = spark.sparkContext.broadcast((Table(gram_keys), gram_logs, Table(keys), np.log10((top_n + 1.0) / room)))
    del often, gram_keys, gram_logs, top, keys, top_n  # the broadcast is in a file
    end = math.log10((n_docs + 1) / room)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, values, known, logs = shared.value
        for batch in parts:
            data, offsets = text_bytes(batch.column(1))
            for first, last in chunks(offsets):
                ids = batch.column(0).slice(first, last - first)
                code, upto, (h, _, _, at) = grams(data, offsets[first : last + 1], order)
                place = known.find(h)
                log = np.where(place >= 0, logs[np.maximum(place, 0)] if len(logs) else 0.0, 0.0)
                tail = place < 0
                rest = np.concatenate([[0], np.cumsum(tail)])[at].astype(np.int32)
                row = common.find(code)
                value = np.where(row >= 0, values[np.maximum(row, 0)] if len(values) else 0.0, 0.0)
                missed, times = _counted((np.repeat(np.arange(len(ids), dtype=np.uint64), np.diff(upto)) << np.uint64(48) | code)[row < 0])
                ends = np.searchsorted(missed >> np.uint64(48), np.arange(len(ids) + 1, dtype=np.uint64)).astype(np.int32)
                missed = pa.array((missed & np.uint64((1 << 48) - 1)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([is_held_out(x) for x in ids.to_pylist()], pa.bool_()),
                        pa.array(np.diff(at) + 1),
                        pa.array(_sums((~tail).astype(np.int64), at) + int(n_docs > 0)),
                        pa.array(_sums(log, at) + end),
                        pa.array(_sums(value, upto)),
                        pa.ListArray.from_arrays(pa.array(rest), pa.array(h[tail].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([missed, pa.array(times.astype(np.int64))], ["gram", "k"])),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "missed"],
                )

    part = rows.mapInArrow(released(batches), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, missed array<struct<gram:long,k:long>>")
    part = materialise(part.withColumn("row", F.monotonically_increasing_id()), "lm-rows")  # written: the row numbers stay
    tail = part.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("k"))
    c = F.coalesce("c", F.lit(0))
    met = tail.join(word_counts, "word", "left").select("row", (F.col("k") * F.log10((c + 1) / F.lit(float(room)))).alias("more"), F.when(c > 0, F.col("k")).otherwise(0).alias("seen"), F.lit(0.0).alias("grams"))
    missed = part.select("row", "held_out", F.inline("missed"))
    rare = seen.where(F.col("n") < 1 << least).select("gram", "value")
    unseen = missed.where("held_out").select("gram").distinct().join(rare, "gram", "left_anti")  # training texts have seen theirs
    rare = rare.unionAll(unseen_scores(unseen, nodes, contexts, rest, order))
    met = met.unionAll(missed.join(rare, "gram").select("row", F.lit(0.0).alias("more"), F.lit(0).alias("seen"), (F.col("k") * F.col("value")).alias("grams")))
    met = met.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more", "seen", "grams")])
    out = part.drop("tail", "missed").join(met, "row", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("grams", F.lit(0.0))).alias("score"))
