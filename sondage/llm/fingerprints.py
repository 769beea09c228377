"""Document fingerprints: SimHash of weighted words, and permuted block tables that find near fingerprints.

Each distinct word of a text votes with its hash on every bit, with a weight that grows as the root of its count; a bit
is set if its votes outweigh. Two fingerprints within a Hamming radius of ``blocks - agree`` differ in so few of the
``blocks`` that they are equal in ``agree`` of them: a table for each choice of ``agree`` blocks, keyed by those bits,
holds every such pair under one key at least, and a pair counts in the first of them only. Equal fingerprints are one
entry. Large keys are dealt to chunks, and a chunk of queries meets a chunk of entries as arrays, never as rows of pairs.

``edited`` compares each document with its neighbour in the order of ids. Texts are shuffled once, to ranges of the
order, and read in order; the last text of a range meets the first of the next in a second, small pass.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, narrow_batches, small
from ._words import chunks, mix, released, text_bytes, words

BITS, RADIUS, AGREE = 256, 9, 1
#: Entries of a key that meet queries at once (32 kB).
CHUNK = 1024
#: Documents for each file of fingerprints or results: these rows are narrow, and on local disks each file costs a process.
PER_FILE = 5000
#: Words whose votes are added at once.
BLOCK = 4096
#: Votes of one occurrence of a word; n occurrences have the root of n times as many.
UNIT = 16


def simhash(texts: pa.Array, bits: int = BITS) -> np.ndarray:
    """Fingerprints as rows of bytes (bits / 8, first bit highest); texts without words, empty and null ones are zero."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    data, offsets = text_bytes(texts)
    for first, last in chunks(offsets, 1 << 17):
        h, _, _, at = words(data, offsets[first : last + 1])
        if not len(h):
            continue
        of = np.repeat(np.arange(last - first), np.diff(at))
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
        weight = np.floor(UNIT * np.sqrt(np.diff(np.concatenate([new, [len(h)]])))).astype(np.int32)
        h, of = h[new], of[new]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        raw = np.stack([mix(h + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64)) for b in range(bits // 64)], axis=1).astype(">u8").view(np.uint8)
        votes = np.zeros((len(starts), bits))
        all_ = np.add.reduceat(weight.astype(np.int64), starts)
        for k, (i, j) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True)):
            kind = np.float32 if all_[k] < 1 << 24 else np.float64  # integers that the kind holds exactly
            for w in range(i, j, BLOCK):
                votes[k] += weight[w : min(w + BLOCK, j)].astype(kind) @ np.unpackbits(raw[w : min(w + BLOCK, j)], axis=1).astype(kind)
        out[first + of[starts]] = np.packbits(2 * votes > all_[:, None], axis=1)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between rows of bytes (the last axis; others broadcast)."""
    x = np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes().hex() for p in prints], pa.string())


PAIR = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(ids: pa.Array, texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray) -> dict:
    """Columns of ``PAIR`` and the ids, for texts and those that follow them; own, following: their fingerprints."""
    changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
    bits = own.shape[1] * 8
    edited = simhash(pa.array(changed, pa.string()), bits)
    return {
        "id": ids,
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": _hex(own),
        "edited_fingerprint": _hex(edited),
        "near_edited": pa.array(1 - distances(own, edited) / bits),
        "near_next": pa.array(1 - distances(own, following) / bits),
    }


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text keeps all but the last floor(n_chars / 2) code points, and the first as many of the next document
    (all, if it is shorter) take their place; the next one of the last is the first. Likenesses are the shares of equal
    bits. The order is by id, null ids first, rows that repeat an id by a hash of their text. Null texts are empty;
    texts of any length are read whole; one row alone is its own next. Other columns aren't read, whatever their names.
    An empty table gives no rows.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc(), F.col("copy").asc()]
    dealt = rows.withColumns({"tie": F.xxhash64("text"), "copy": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *[c.split()[0] for c in PAIR.split(", ")], "place", "range", "text"]

    def row(schema: pa.Schema, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values.get(c, pa.nulls(1, schema.field(c).type)) for c in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pa.array([TaskContext.get().partitionId()], pa.int32())
        held = None
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), ("n_chars", pa.int64()), *[(c, pa.string()) for c in names[2:5]], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("place", pa.string()), ("range", pa.int32()), ("text", pa.string())])
            for first, last in chunks(text_bytes(batch.column("text"))[1], 1 << 22):
                part = batch.slice(first, last - first)
                ids, texts = part.column("id"), part.column("text").to_pylist()
                prints = simhash(part.column("text"), bits)
                if held is None:
                    yield row(schema, place=pa.array(["first"]), range=at, text=pa.array(texts[:1]))
                else:
                    ids, texts, prints = pa.concat_arrays([held[0], ids]), held[1] + texts, np.concatenate([held[2], prints])
                if len(texts) > 1:
                    own = _pairs(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                    n = len(texts) - 1
                    own |= {"place": pa.nulls(n, pa.string()), "range": pa.nulls(n, pa.int32()), "text": pa.nulls(n, pa.string())}
                    yield pa.RecordBatch.from_arrays([own[c] for c in names], schema=schema)
                held = (ids[-1:], texts[-1:], prints[-1:])
        if held is not None:
            yield row(schema, id=held[0], place=pa.array(["last"]), range=at, text=pa.array(held[1]))

    out = materialise(dealt.mapInArrow(released(run), f"id {kind}, {PAIR}, place string, range int, text string"), "fingerprints")

    edges = out.where("place IS NOT NULL").select("id", "place", "range", "text")  # two rows a range
    ranges = Window.partitionBy(F.lit(0)).orderBy("range")
    following = edges.where("place = 'last'").select("range").withColumn("then", F.lead("range").over(ranges))
    lowest = edges.agg(F.min("range").alias("lowest"))
    following = following.crossJoin(F.broadcast(lowest)).select("range", F.coalesce("then", "lowest").alias("then"))
    firsts = edges.where("place = 'first'").select(F.col("range").alias("then"), F.col("text").alias("after"))
    left = edges.where("place = 'last'").select("range", "id", "text").join(following, "range").join(firsts, "then").select("id", "text", "after")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in chunks(text_bytes(batch.column("text"))[1], 1 << 22):
                part = batch.slice(first, last - first)
                texts, after = part.column("text"), part.column("after")
                yield pa.RecordBatch.from_pydict(_pairs(part.column("id"), texts.to_pylist(), after.to_pylist(), simhash(texts, bits), simhash(after, bits)))

    columns = ["id", *[c.split()[0] for c in PAIR.split(", ")]]
    both = out.where("place IS NULL").select(*columns).unionAll(left.mapInArrow(rest, f"id {kind}, {PAIR}"))
    return both.withColumnRenamed("id", id_col)


def borders(bits: int, blocks: int) -> list[int]:
    return [i * bits // blocks for i in range(blocks + 1)]


def table_keys(prints: np.ndarray, blocks: int, agree: int) -> np.ndarray:
    """A 64-bit key for each fingerprint (row) and table (column): the bits of the table's blocks, hashed with its number."""
    bits = np.unpackbits(prints, axis=1)
    ends = borders(bits.shape[1], blocks)
    parts = []
    for i, j in itertools.pairwise(ends):
        packed = np.packbits(bits[:, i:j], axis=1)
        h = np.full(len(prints), i + 1, np.uint64)
        for byte in packed.T:
            h = mix(h * np.uint64(257) + byte.astype(np.uint64))
        parts.append(h)
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        h = np.full(len(prints), t + 1, np.uint64)
        for c in chosen:
            h = mix(h + parts[c])
        keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def first_table(differ: np.ndarray, blocks: int, agree: int) -> np.ndarray:
    """Of pairs, given as XOR (rows of bytes), the first table in which they share a key."""
    bits = np.unpackbits(differ, axis=1)
    same = np.stack([~bits[:, i:j].any(axis=1) for i, j in itertools.pairwise(borders(bits.shape[1], blocks))], axis=1)
    number = {c: t for t, c in enumerate(itertools.combinations(range(blocks), agree))}
    place = np.argsort(~same, axis=1, kind="stable")[:, :agree]
    return np.array([number[tuple(p)] for p in place.tolist()], np.int64)


def search(queries: DataFrame, entries: DataFrame, radius: int = RADIUS, agree: int = AGREE, with_matches: bool = True, files: int | None = None) -> DataFrame:
    """(fingerprint, n_near, matches) for every distinct fingerprint of ``queries`` (a column of hex digits).

    n_near counts the rows of ``entries`` (same column) within ``radius`` bits, exact ones included; ``matches`` lists
    their distinct fingerprints, null if ``with_matches`` is off. All fingerprints have one length, a multiple of 64
    bits. Rows with a null fingerprint neither ask nor answer. Empty tables are allowed. The block tables are written in
    ``files`` files at most (None: a file for each partition).
    """
    blocks = radius + agree
    both = queries.select("fingerprint", F.lit(0).alias("n"), F.lit(True).alias("asks")).unionAll(entries.select("fingerprint", F.lit(1).alias("n"), F.lit(False).alias("asks")))
    prints = both.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.sum("n").alias("n"), F.max("asks").alias("asks"))
    prints = prints.coalesce(files) if files else prints

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                raw = [bytes.fromhex(p) for p in batch.column("fingerprint").to_pylist()]
                keys = table_keys(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), blocks, agree)
                n, tables = keys.shape
                rows = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_pydict({"tab": pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), "key": pa.array(keys.ravel()), "print": pa.array(raw, pa.binary()).take(rows), "n": batch.column("n").take(rows), "asks": batch.column("asks").take(rows)})

    tables = materialise(prints.mapInArrow(keyed, "tab int, key long, print binary, n long, asks boolean"), "prints-tables")
    asked, held = tables.where("asks"), tables.where("n > 0")
    parts = lambda which: F.ceil(F.count_if(which) / CHUNK).cast("int")
    crowd = tables.groupBy("tab", "key").agg(parts(F.col("n") > 0).alias("parts"), parts("asks").alias("askers")).where("parts > 1 OR askers > 1")
    crowd = small(materialise(crowd, "prints-crowded"))
    part = lambda many: F.pmod(F.xxhash64("print"), F.greatest(F.coalesce(many, F.lit(1)), F.lit(1))).cast("int")
    boxed = held.join(crowd, ["tab", "key"], "left").groupBy("tab", "key", part("parts").alias("part")).agg(F.collect_list(F.struct("print", "n")).alias("held"))
    sent = asked.join(crowd, ["tab", "key"], "left").groupBy("tab", "key", part("askers").alias("_p")).agg(F.collect_list("print").alias("asked"), F.first("parts").alias("parts"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1)))
    met = sent.join(boxed, ["tab", "key", "part"]).select("tab", "asked", "held")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tab, q, e in zip(batch.column("tab").to_pylist(), batch.column("asked").to_pylist(), batch.column("held").to_pylist(), strict=True):
                a = np.frombuffer(b"".join(q), np.uint8).reshape(len(q), -1)
                b = np.frombuffer(b"".join(x["print"] for x in e), np.uint8).reshape(len(e), -1)
                i, j = np.nonzero(distances(a[:, None, :], b[None, :, :]) <= radius)
                mine = first_table(a[i] ^ b[j], blocks, agree) == tab
                i, j = i[mine], j[mine]
                total = np.bincount(i, np.array([x["n"] for x in e])[j], len(q)).astype(np.int64)
                which = np.flatnonzero(np.bincount(i, minlength=len(q)))
                lists = [[e[y]["print"].hex() for y in j[i == x]] for x in which] if with_matches else [None] * len(which)
                yield pa.RecordBatch.from_pydict({"fingerprint": pa.array([q[x].hex() for x in which], pa.string()), "n_near": pa.array(total[which]), "matches": pa.array(lists, pa.list_(pa.string()))})

    found = met.mapInArrow(matched, "fingerprint string, n_near long, matches array<string>")
    lists = F.sort_array(F.flatten(F.collect_list("matches"))) if with_matches else F.lit(None).cast("array<string>")
    asking = queries.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    return asking.join(found.groupBy("fingerprint").agg(F.sum("n_near").alias("n_near"), lists.alias("matches")), "fingerprint", "left").na.fill(0, ["n_near"])


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20, bits: int = BITS, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """``neighbours`` and n_near: of rows whose id is divisible by ``every``, how many other rows' fingerprints are within ``radius``.

    n_near is null for all other rows and null ids. Ids are integers; else as ``neighbours``.
    """
    prints = neighbours(docs, id_col, text_col, bits)
    asks = F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(every)) == 0, F.lit(False))
    files = 1 + docs.count() // PER_FILE
    near = search(prints.where(asks), prints, radius, agree, with_matches=False, files=files).select("fingerprint", F.col("n_near").alias("_n"))
    asking = prints.where(asks).join(near, "fingerprint", "left").select(*prints.columns, (F.col("_n") - 1).alias("n_near"))
    return asking.unionAll(prints.where(~asks).select("*", F.lit(None).cast("long").alias("n_near"))).coalesce(files)
