"""The rebuilt SentencePiece models against the reference processor, for both model kinds."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from pixelstrata.llm import sentence_pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "a ", "  two  blanks ", "tab\tline\nend", "▁mark", "a▁b", "<s></s><unk>", "<0x41>", "漢字🙂é", "x" * 3000, "Ab cd " * 500, " nbsp", "1234567890", "\x01\x02"]


def message(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else varint(len(value)) + value)


def unigram_file(tmp_path, byte_fallback):
    """A unigram model written field by field (nothing is trained)."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rows += [(p, s, 1) for p, s in [("▁", -2.0), ("▁he", -3.0), ("llo", -3.5), ("▁hello", -8.0), ("l", -4.0), ("o", -4.1), ("h", -4.2), ("e", -4.3), ("▁w", -4.5), ("or", -4.4), ("ld", -4.6), ("r", -5.0), ("d", -5.1), ("w", -5.2), ("lo", -4.05)]]
    data = b"".join(message(1, 2, message(1, 2, p.encode()) + message(2, 5, s) + message(3, 0, t)) for p, s, t in rows)
    data += message(2, 2, message(3, 0, 1) + (message(35, 0, 1) if byte_fallback else b""))
    data += message(3, 2, message(1, 2, b"identity") + message(3, 0, 1) + message(4, 0, 0) + message(5, 0, 1))
    path = tmp_path / f"unigram{byte_fallback}.model"
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram", "unigram_bytes"])
def test_parity_and_round_trip(kind, tmp_path):
    path = PATH if kind == "bpe" else unigram_file(tmp_path, kind == "unigram_bytes")
    p, reference = P.Processor(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in TEXTS if kind == "bpe" or "<0x" not in t] + ["hello world", "hello  hello", "wor ld llo"]
    ids, sizes, parity = p.encode(texts)
    ends = np.cumsum(sizes)
    for t, b, n in zip(texts, ends, sizes):
        own = ids[b - n : b].tolist()
        assert own == reference.encode(t), t
        assert p.decode(own) == reference.decode(own), t
    assert parity.all() and p.by_word


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n▁漢<s>0x41\t", max_size=40), max_size=5))
def test_any_text_agrees(texts):
    p = P.Processor.of(PATH)
    ids, sizes, _ = p.encode(texts)
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == [p.reference.encode(t) for t in texts]


def test_columns_and_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "a b", 1), (3, "word " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parity int")
    encoded = P.encode(df, PATH, keep_ids=True)
    out = encoded.collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out) == [(0, True), (1, False), (2, False), (2, False), (3, True)]
    assert all(r.parity and r.round_trip for r in out)
    assert sorted((r.doc_id or 0, r.text) for r in P.decode(encoded, PATH).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert P.encode(df.limit(0), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 10)
    p = P.Processor(PATH)
    for k in range(5):
        texts = [f"w{k}{j} x" for j in range(20)]
        ids, sizes, _ = p.encode(texts)
        assert ids.tolist() == [i for t in texts for i in p.reference.encode(t)]
    assert len(p.place) <= 22


def test_query_on_whole_table(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op7_sentencepiece_encoding"](spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        ids = np.array(reference.encode(text[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_crc32, r.parity, r.round_trip) == (len(ids), zlib.crc32(ids), True, True)
