import struct

import pytest

from sondage.llm.sp_tokens import BATCH_CHARS, MARK, SentencePieces, decoded, default_model, encoded, read_model

TEXTS = ["", " ", "  a  b ", "\n\n a\tb▁▁c ▁d", "</s>[INST] <0x0A> \x00 é𝄞", "x" * 1000, "Das ist ein Test. Y aquí también, où ça?", ("ab cd  " * (BATCH_CHARS // 3)) + "é"]


def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_parity_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(99, None, 0), (0, "", 0)], "doc_id long, text string, tokens int")
    out = encoded(df)
    rows = {r["doc_id"]: r for r in out.collect()}
    theirs = sp()
    for i, t in enumerate(TEXTS):
        assert rows[i]["tokens"] == theirs.encode(t) and rows[i]["parity"] and rows[i]["round_trip"]
    assert rows[99]["tokens"] == [] and out.count() == len(TEXTS) + 2
    back = {r["doc_id"]: r["text"] for r in decoded(out).collect()}
    assert all(back[i] == theirs.decode(rows[i]["tokens"]) for i in back if i != 99)
    assert encoded(df.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    out = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert out.where("NOT parity OR NOT round_trip OR n_tokens <> size(tokens)").count() == 0


class Counted:
    """An encoder that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.chars = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_distinct_words_are_encoded_once(monkeypatch):
    from sondage.llm import sp_tokens

    with open(default_model(), "rb") as f:
        own = SentencePieces(f.read())
    odd = ["a", "\n", "\t x", "x\n", "</s> <unk> <0x0A>", "é𝄞 日本 語\ny", "b\u00a0c \u3000", "q" * 5000 + " " + "ab\x00 c", " a", "a ", "a  b", MARK, f"a {MARK}b", f"a{MARK} b", "", "  "]
    texts = [f"the tokens of {w} are, well, {w}\nand {v}." for w in odd for v in ("one", "two")] + odd
    plain = [" ".join(f"word{(i * j) % 90}" for j in range(60)) for i in range(300)]
    for size in (1, 40, 1 << 21):
        monkeypatch.setattr(sp_tokens, "WORD_CHARS", size)
        assert list(own.encode(texts + plain[:40])) == sp().encode(texts + plain[:40])
    own.first = Counted(own.first)
    assert list(own.encode(plain)) == sp().encode(plain)
    assert own.first.chars < 0.02 * sum(map(len, plain))


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def unigram_model(fallback=True):
    """A small unigram model, written field by field."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback] + [(MARK, -2.0, 1), (MARK + "the", -3.0, 1), ("th", -4.0, 1), ("e", -3.5, 1), ("t", -5.0, 1), ("h", -5.1, 1), ("re", -4.2, 1), ("r", -5.3, 1), ("there", -9.0, 1)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    return data + _field(2, _field(3, 1) + _field(35, int(fallback)) + _field(40, 0)) + _field(3, _field(3, 1) + _field(4, 1) + _field(5, 1))


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_models(fallback):
    import sentencepiece

    data = unigram_model(fallback)
    m = read_model(data)
    assert m["type"] == 1 and bool(m["byte_fallback"]) == fallback and m["trim"] and m["pieces"][-1][0] == "there"
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["there the re", "  the   there ", "", "thé x", "ttthhh e"]
    assert list(SentencePieces(data).encode(texts)) == theirs.encode(texts)
