"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model's protobuf.

The protobuf is read field by field: pieces with scores and types, the normaliser (precompiled map, dummy prefix,
white space rules), the model type and byte fallback. A unigram model keeps its scores; a BPE model's merges are the
pairs of pieces that join to a piece, ranked by its score. Texts are encoded in batches of bounded size with as many
threads as a task has cores (spark.task.cpus), each distinct word of a batch once where no merge crosses words; every
text's ids are compared with sentencepiece's own, which takes it whole, and decoded again.
"""

from __future__ import annotations

import itertools
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, narrow_batches
from ._words import chunks, released, text_bytes

MARK = "▁"
#: Fixed values of the published format: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are encoded at a time, and after which a longer text is cut at a word.
BATCH_CHARS = 1 << 17
#: Characters of texts whose distinct words are encoded once, and of words that are encoded as one text.
WORD_CHARS, JOINED_CHARS = 1 << 21, 1 << 12


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or bytes of fixed and delimited fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        n = varint() if n is None else n
        yield key >> 3, data[at : at + n]
        at += n


def read_model(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings that encoding depends on."""
    out: dict = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk": 0, "map": b"", "dummy_prefix": True, "trim": True, "escape": True, "suffix": False}
    names = {2: {3: "type", 35: "byte_fallback", 40: "unk", 24: "suffix"}, 3: {2: "map", 3: "dummy_prefix", 4: "trim", 5: "escape"}}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out["pieces"].append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
        elif number in names:
            for inner, v in _fields(value):
                if inner in names[number]:
                    out[names[number][inner]] = v
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for whole, score, kind in pieces:
        if kind == NORMAL:
            found += [(-score, ids[whole], ids[a], ids[b], a, b) for i in range(1, len(whole)) if (a := whole[:i]) in ids and (b := whole[i:]) in ids]
    return [x[-2:] for x in sorted(found)]


class SentencePieces:
    """Encoder and decoder; ``encode`` takes any number of whole texts."""

    def __init__(self, data: bytes):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        m = read_model(data)
        if m["suffix"] or not m["escape"]:
            raise ValueError("models with suffix markers or unescaped white space aren't supported")
        pieces, unk = m["pieces"], m["pieces"][m["unk"]][0]
        self.pieces = [p for p, _, _ in pieces]
        # A normaliser that only marks spaces is a replacement in the text, which Python does at a fiftieth of the time.
        self.plain = not m["map"] and not m["trim"] and not any(kind == USER_DEFINED for _, _, kind in pieces)
        self.prefix = MARK if m["dummy_prefix"] else ""

        def build(prefix: bool):
            if m["type"] == UNIGRAM:
                model = models.Unigram([(p, s) for p, s, _ in pieces], m["unk"], bool(m["byte_fallback"]))
            elif m["type"] == BPE:
                model = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges(pieces), unk_token=unk, fuse_unk=True, byte_fallback=bool(m["byte_fallback"]))
            else:
                raise ValueError("only unigram and BPE models are supported")
            t = Tokenizer(model)
            if self.plain:
                steps = []
            else:
                steps = [normalizers.Precompiled(m["map"])] if m["map"] else []
                if m["trim"]:
                    steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
                steps += [normalizers.Prepend(MARK)] * bool(prefix) + [normalizers.Replace(" ", MARK)]
            t.normalizer = normalizers.Sequence(steps)
            t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
            t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER_DEFINED])
            return t

        # A marker inside a piece follows only markers: then no merge crosses the start of a word, and a long text can be cut there.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.first = build(bool(m["dummy_prefix"]))
        # Cut texts need rules that look at a place only: no map, no trimming. Their encoder is built when one comes.
        self.can_cut = self.by_word and not m["map"] and not m["trim"]
        self.build_rest, self.rest = lambda: build(False), None
        # Then a BPE text whose words are parted by single spaces is its words' ids in a row: each starts with the marker, a piece itself.
        self.leads = np.array([p.startswith(MARK) for p in self.pieces])
        self.words_once = m["type"] == BPE and self.can_cut and self.plain and self.prefix == MARK and (MARK, NORMAL) in {(p, kind) for p, _, kind in pieces}

    def _marked(self, texts: list[str], prefix: str) -> list[str]:
        """Texts as the encoder takes them: marked here if the normaliser does nothing else."""
        return [prefix + t.replace(" ", MARK) if t else t for t in texts] if self.plain else texts

    def _parts(self, text: str) -> list[str]:
        """A very long text cut before single spaces between words."""
        parts, at = [], 0
        while self.can_cut and len(text) - at > BATCH_CHARS:
            cut = text.rfind(" ", at + 1, at + BATCH_CHARS)
            while cut > at and text[cut - 1] in (" ", MARK):
                cut -= 1
            if cut <= at:
                break
            parts.append(text[at:cut])
            at = cut
        return [*parts, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        if not self.words_once:
            yield from self._whole(texts)
            return
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= WORD_CHARS):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            single = [bool(t) and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in part]
            words = self._by_words([t for t, s in zip(part, single, strict=True) if s])
            others = self._whole([t for t, s in zip(part, single, strict=True) if not s])
            for s in single:
                yield next(words if s else others)
            at = end

    def _by_words(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of texts that are words parted by single spaces; each distinct word is encoded once."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        spans = list(chunks(text_bytes(words)[1], JOINED_CHARS))
        spelled = words.to_pylist()
        ids = [np.empty(0, np.int32)]
        for k in range(0, len(spans), BATCH_CHARS // JOINED_CHARS):
            joined = [MARK + MARK.join(spelled[i:j]) for i, j in spans[k : k + BATCH_CHARS // JOINED_CHARS]]
            ids += [np.array(e.ids, np.int32) for e in self.first.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(ids)
        starts = np.append(np.flatnonzero(self.leads[ids]), len(ids))
        if len(starts) != len(words) + 1:
            raise ValueError("a word's ids don't start with the marker")
        sizes = np.diff(starts)[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(starts[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()].tolist()
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield flat[i:j].tolist()

    def _whole(self, texts: list[str]) -> Iterator[list[int]]:
        held, size = [], 0
        for text in texts:
            if len(text) > BATCH_CHARS:
                yield from self._flush(held)
                held, size = [], 0
                parts = self._parts(text)
                ids = self.first.encode_batch_fast(self._marked(parts[:1], self.prefix), add_special_tokens=False)[0].ids
                self.rest = self.rest or (self.build_rest() if parts[1:] else None)
                for part in parts[1:]:
                    ids += self.rest.encode_batch_fast(self._marked([part], ""), add_special_tokens=False)[0].ids
                yield ids
                continue
            held.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[str]) -> list[list[int]]:
        return [e.ids for e in self.first.encode_batch_fast(self._marked(held, self.prefix), add_special_tokens=False)] if held else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = [t.replace(MARK, " ") for t in self.first.decode_batch(ids, skip_special_tokens=False)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


@lru_cache(maxsize=2)
def _loaded(data: bytes):
    import sentencepiece
    from pyspark import TaskContext

    task = TaskContext.get()
    if task:  # a batch is encoded with as many threads as the task has cores (spark.task.cpus)
        os.environ.setdefault("RAYON_NUM_THREADS", str(task.cpus()))

    return SentencePieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``id_col``, tokens array<int>, n_tokens, parity (equal to sentencepiece's ids), round_trip.

    round_trip: the ids, decoded by the rebuilt decoder, give the text or, where the model changes texts, what sentencepiece
    decodes. Null texts count as empty: no tokens.
    Texts of any length are encoded whole. Ids of any type stay; rows that repeat an id each get a row; other columns
    aren't read, whatever their names; an empty table gives an empty result. The model file is read on the driver (its path is a parameter) and broadcast: its size doesn't depend on the data.
    """
    narrow_batches(docs.sparkSession)
    with open(model_path or default_model(), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, theirs = _loaded(data.value)
        for batch in rows:
            at, sizes = 0, pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            every = own.encode([x or "" for x in batch.column(1).to_pylist()])  # lists are made as they are taken
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and (end == at or size < 4 * BATCH_CHARS):
                    size += sizes[end]
                    end += 1
                texts = [x or "" for x in batch.column(1).slice(at, end - at).to_pylist()]
                ids = list(itertools.islice(every, len(texts)))
                same = [a == b for a, b in zip(ids, theirs.encode(texts, num_threads=1), strict=True)]
                trip = [a == b or a == theirs.decode(i) for a, b, i in zip(own.decode(ids), texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same), pa.array(trip)], ["id", "tokens", "n_tokens", "parity", "round_trip"])
                at = end

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(released(batches), f"id {kind}, tokens array<int>, n_tokens long, parity boolean, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", model_path: str | None = None) -> DataFrame:
    """Per row: ``id_col`` and the text of its ids under a free name; null ids give an empty text."""
    with open(model_path or default_model(), "rb") as f:
        data = tokens.sparkSession.sparkContext.broadcast(f.read())
    name = fresh(tokens.select(id_col), "text")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _loaded(data.value)
        for batch in rows:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.decode([x or [] for x in part.column(1).to_pylist()]), pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), tokens_col).mapInArrow(released(batches), f"id {kind}, text string").toDF(id_col, name)
