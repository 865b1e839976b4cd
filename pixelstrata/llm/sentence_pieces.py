"""Encoding and decoding of SentencePiece models with the tokenizers library.

The model protobuf is read field by field; normaliser, metaspace marker, scores (unigram) or
merges in score order (byte pairs) and byte fallback are rebuilt as a tokenizer. Where no
piece holds a marker behind other text, a text's ids are those of its words one after the
other, so batches are cut into words, each new word is encoded once per worker (in
multithreaded batches) and whole texts are assembled from array slices. Each new word is
also encoded by the reference processor; parity says that all words of a text agree.

Defined results: a null text counts as empty and has no ids. Repeated rows give equal rows;
an empty table gives an empty result. Extra columns are ignored. Characters without a piece
become bytes, or the unknown piece where the model has no byte pieces. A unigram model with
byte pieces takes a literal like ``<0x41>`` in a text for the byte; parity is false there.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelstrata.functions.byte_spans import slices

MARK = "▁"
CACHED_WORDS = 300_000
SLICE = 4 << 20
THREADS = 2
# Piece kinds and model kinds of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                out.pieces.append((f.get(1, b"").decode("utf-8"), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                out.kind, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.collapse = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        return out

    @property
    def unknown(self) -> int:
        return next((k for k, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)

    def splits_at_marks(self) -> bool:
        """Whether no piece goes on behind the end of a word."""
        return all(MARK not in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER)) and all(t != USER for _, _, t in self.pieces) and any(p == MARK for p, _, _ in self.pieces)


def _merges(vocabulary: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """All ways to make a piece of two, best score first."""
    out = []
    for piece, score in scores.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in scores and b in scores:
                out.append((-score, vocabulary[piece], vocabulary[a], vocabulary[b], (a, b)))
    return [m[-1] for m in sorted(out)]


class Processor:
    """Encoder and decoder of one model file."""

    _loaded: dict[str, "Processor"] = {}

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = os.environ.get("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        from tokenizers import Tokenizer, models, normalizers

        with open(path, "rb") as f:
            data = f.read()
        self.threads = threads
        self.model = m = Model.parse(data)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        # pieces that no text may match stand under names that no text has
        name = [p if t in (NORMAL, USER, BYTE) else f"\0{k}\0" for k, (p, _, t) in enumerate(m.pieces)]
        vocabulary = {p: k for k, p in enumerate(name)}
        unknown = name[m.unknown] if m.pieces else None
        if m.kind == BPE:
            scores = {p: s for p, s, t in m.pieces if t in (NORMAL, USER)}
            rebuilt = models.BPE(vocab=vocabulary, merges=_merges(vocabulary, scores), unk_token=unknown, fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            rebuilt = models.Unigram([(p, m.pieces[k][1]) for k, p in enumerate(name)], unk_id=m.unknown, byte_fallback=m.byte_fallback)
        self.words_only = Tokenizer(rebuilt)
        self.normalizer = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.by_word = m.splits_at_marks()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in (NORMAL, USER) else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, _, t in m.pieces]
        self.clear()

    @classmethod
    def of(cls, path: str) -> Processor:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.agrees = np.zeros(0, bool)

    def normal(self, text: str) -> str:
        """The text as pieces see it, markers for blanks."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.model.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        return (" " if self.model.dummy_prefix and text else "") + text.replace(MARK, " ")  # a marker in a text is a blank

    def words(self, normal: str) -> list[str]:
        """Cut before each run of blanks; every word keeps its blanks."""
        if not self.by_word:
            return [normal] if normal else []
        if "  " in normal or not normal.startswith(" ") or normal.endswith(" "):
            return re.findall(r" +[^ ]*|[^ ]+", normal)
        return [" " + w for w in normal[1:].split(" ")]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, with both implementations."""
        if not words:
            return
        encoded = [e.ids for e in self.words_only.encode_batch_fast([w.replace(" ", MARK) for w in words], add_special_tokens=False)]
        prefix = self.model.dummy_prefix
        plain = [w[1:] if prefix and w.startswith(" ") else w for w in words]
        checked = self.reference.encode(plain, num_threads=self.threads)
        mark = [self.reference.piece_to_id(MARK)]  # a blank alone would be asked for as an empty text
        checked = [mark if w == " " and prefix else c for w, c in zip(words, checked)]
        sizes = np.array([len(e) for e in encoded], np.int64)
        for w in words:
            self.place[w] = len(self.place)
        self.ids = np.concatenate([self.ids, np.fromiter((i for e in encoded for i in e), np.uint32, int(sizes.sum()))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        # a word that starts without the prefix can't be asked for alone
        self.agrees = np.concatenate([self.agrees, [a == b or (prefix and not w.startswith(" ")) for a, b, w in zip(encoded, checked, words)]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, ids of each text, and parity of each text."""
        if len(self.place) > CACHED_WORDS:
            self.clear()
        cut = [self.words(self.normal(t)) for t in texts]
        flat = [w for words in cut for w in words]
        self.learn(list(dict.fromkeys(w for w in flat if w not in self.place)))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        out = self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(int(size.sum()))]
        words = np.array([len(c) for c in cut], np.int64)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        wrong = np.concatenate([[0], np.cumsum(~self.agrees[at])])[np.concatenate([[0], np.cumsum(words)])]
        return out, np.diff(upto), np.diff(wrong) == 0

    def decode(self, ids) -> str:
        """Text of ids; invalid bytes become replacement characters."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip (and ids) for every row of ``documents(doc_id, text)``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``round_trip``
    says that decoding gives the normalised text back.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Processor.of(path)
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                texts = [t or "" for t in batch.column(1).slice(part.first, len(part.starts)).to_pylist()]
                ids, sizes, parity = p.encode(texts)
                ends = np.cumsum(sizes)
                each = [ids[b - n : b] for b, n in zip(ends, sizes)]
                whole = []
                for t, i in zip(texts, each):
                    normal = p.normal(t)
                    whole.append(p.decode(i.tolist()) == (normal[1:] if p.model.dummy_prefix and normal.startswith(" ") else normal))
                columns = [batch.column(0).slice(part.first, len(texts)), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(i.astype("<u4")) for i in each], pa.int64()), pa.array(parity), pa.array(whole, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([i.astype(np.int32) for i in each], pa.list_(pa.int32()))] if keep_ids else []), names=names + ["ids"] * keep_ids)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean" + ", ids array<int>" * keep_ids)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for every row of ``encoded(doc_id, ids)``."""
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Processor.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
