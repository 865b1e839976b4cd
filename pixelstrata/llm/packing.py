"""Packing documents into fixed-length sequences by best-two-fit.

Piece lengths are integers up to the capacity, so all that packing needs is how many pieces
have each length. Spark counts that histogram (at most ``capacity`` rows), the driver packs
lengths instead of pieces, and every piece then finds its place from its rank among the
pieces of its length. A bin pattern is repeated as long as its lengths last, hence each
pattern uses up a length and the plan has at most ``capacity`` patterns, however many
pieces there are.

A bin is filled greedily with the largest lengths that fit; then its smallest piece makes
room for two unpacked ones that fill the widened gap more tightly, as often as that helps.

Ranks are counted in buckets of bounded size with prefix sums over the buckets, so neither a
common length nor a group of copies ends up in one task.

Defined results: a null text counts as empty and gives the closing id alone. A document of at
most ``capacity`` ids is one piece; a longer one is cut so that only its first piece may be
shorter. Repeated rows are packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pixelstrata.functions.byte_spans import slices
from pixelstrata.llm.tables import stored

CAPACITY = 1024
CLOSING_ID = 2
RANKED_TOGETHER = 50_000

# Fixed value: the word pattern of byte-level tokenizers of this family.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_RUN = 100_000
# The white space of that pattern. The byte-pair encoder's matcher gives up on longer runs.
_BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")


class Encoder:
    """Ids of whole texts under a byte-level tokenizer file.

    Texts in Latin script go to a byte-pair encoder with the same ranks, all others to the
    tokenizers library itself; both give the same ids, the former several times faster.
    """

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # such strings in a text are ordinary text
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        try:
            ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}
        except KeyError:
            return
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        in_order = all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        pre = spec.get("pre_tokenizer") or {}
        if in_order and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ids(self, text: str, latin: bool) -> np.ndarray:
        if latin and self.fast is not None:
            if len(text) < LONG_RUN:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            return np.concatenate(list(self._parts(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text part by part. A long run of white space is one word up to its last blank, which may belong to the next word."""
        at = 0
        for run in _BLANKS.finditer(text):
            a, b = run.span()
            b -= b < len(text)
            yield self.fast.encode_to_numpy(text[at:a], disallowed_special=())
            yield np.array(self.fast._encode_single_piece(text[a:b]), np.uint32)
            at = b
        yield self.fast.encode_to_numpy(text[at:], disallowed_special=())


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for every piece of every row of ``documents(doc_id, text)``."""
    kind = dict(documents.dtypes)["doc_id"]
    end = np.array([closing], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for part in slices(batch.column(1)):
                texts = batch.column(1).slice(part.first, len(part.starts)).to_pylist()
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for r, text in enumerate(texts):
                    latin = not text or part.raw[part.starts[r] : part.ends[r]].max() < 0xCA  # lead bytes of U+0280 and above
                    ids = np.concatenate([encoder.ids(text or "", bool(latin)), end]).astype("<u4")
                    for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                        row.append(r), piece.append(k), start.append(s), length.append(n)
                        crc.append(zlib.crc32(ids[s : s + n]))
                        if keep_ids:
                            kept.append(ids[s : s + n].astype(np.int32))
                columns = [batch.column(0).slice(part.first, len(texts)).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), names=names + ["ids"] * keep_ids)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _largest(left: np.ndarray, most: int) -> int:
    """Largest length up to ``most`` of which any is left; 0 for none."""
    at = np.flatnonzero(left[: most + 1])
    return int(at[-1]) if len(at) else 0


def _two(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Two lengths that are left, with the largest sum in (more_than, room]."""
    have = np.flatnonzero(left[: room + 1])
    best, found = more_than, None
    for a in have[::-1]:
        if 2 * a <= best:
            break
        b = _largest(left, min(room - int(a), int(a)))
        if b == a and left[a] < 2:
            b = _largest(left, min(room - int(a), int(a) - 1))
        if b and a + b > best:
            best, found = int(a) + b, (int(a), b)
            if best == room:
                break
    return found


def bin_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in the bin, bins of that pattern), by best-two-fit over a histogram of lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while left.any():
        spare, used, room = left.copy(), [], capacity
        while room and (n := _largest(spare, room)):
            used.append(n)
            spare[n] -= 1
            room -= n
        while room and len(used) > 1 and (pair := _two(spare, room + used[-1], used[-1])):
            room += used[-1] - sum(pair)
            spare[used.pop()] += 1
            for n in pair:
                spare[n] -= 1
            used = sorted([*used, *pair], reverse=True)
        size, number = np.unique(used, return_counts=True)
        times = int((left[size] // number).min())
        left[size] -= times * number
        out.append(({int(s): int(n) for s, n in zip(size[::-1], number[::-1])}, times))
    return out


def _places(patterns: list[tuple[dict[int, int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """By length and first rank: ranks from there on, pieces of the length in a bin, first bin, offset in the bin."""
    ranks = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for used, times in patterns:
        offset = 0
        for n, number in used.items():
            rows.append((n, int(ranks[n]), number, first, offset))
            ranks[n] += number * times
            offset += n * number
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return tuple(table[:, k].copy() for k in range(5))


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``cut`` (of ``pieces``, stored) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    length, rank, number, first, offset = _places(bin_patterns(counts, capacity), capacity)
    lookup = (length << 44) + rank
    buckets = max(1, math.ceil(sum(counts.values()) / RANKED_TOGETHER))
    rows = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    rows = rows.withColumn("_rank", within).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(lookup, (n << 44) + r, "right") - 1
            k, inside = np.divmod(r - rank[at], number[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(first[at] + k), pa.array(offset[at] + n * inside)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {k}" for c, k in cut.dtypes) + ", sequence_id bigint, offset bigint"
    return rows.select(*names, "_rank").mapInArrow(run, schema)


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(stored(pieces(documents, path, capacity, keep_ids=keep_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, input_ids, doc_ids of each piece in order, from ``pack(..., keep_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("input_ids"), F.col("parts.doc_id").alias("doc_ids"))
