"""Spelling variants of the corpus vocabulary by a reduced alphabet.

Words are counted first (before any shuffle in each slice of texts, then by Spark). Letters
are then hashed to ``SYMBOLS`` symbols by a table that spreads the letters of the vocabulary
evenly, most frequent first. If two words differ by one code point, their reduced words are
equal or differ by one symbol. So every word generates the whole one-edit neighbourhood of
its reduced word (deletions, replacements and insertions of symbols, and itself), and meets
the words whose reduced word is in it; the original strings decide.

Neighbours that are no reduced word of the vocabulary are left out before the shuffle by a
bitmap of ``2**BITMAP_BITS`` bits, which Spark aggregates and every task gets. Its size is
fixed; with a vocabulary of any size it lets more pass, but never stops a true one. Reduced
words travel as 64-bit polynomial hashes, from which those of neighbours follow in one step.

The most frequent near word, if it is ``ratio`` times as frequent, is a word's form. Counts
rise with every step, so roots are found by doubling the steps a few times.

Defined results: null and empty texts have no words; a null doc_id is hashed as the empty
string. Repeated rows count each time. Runs and words of any length are taken whole. An empty
table, or one without words, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelstrata.functions.byte_spans import Slice, mix, slices, span_hashes, spans
from pixelstrata.llm.tables import stored

SYMBOLS = 8
BITMAP_BITS = 26
LEAST_LENGTH, LEAST_COUNT, RATIO, DELETED = 7, 2, 10, 31
GENERATED = 1 << 20  # neighbours made in one step
TOGETHER = 20_000  # words whose neighbours one task makes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_TWO = 0xC3  # the lead byte of U+00C0 to U+00FF and of nothing else

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def crc32(seed: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many spans of bytes, each continued from a seed; a byte of all spans at a time."""
    state = seed.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = ends - starts > 64
    for k in np.flatnonzero(long):
        state[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(seed[k])) ^ 0xFFFFFFFF
    order = np.argsort(np.where(long, 0, starts - ends), kind="stable")
    size = np.where(long, 0, ends - starts)[order]
    for k in range(int(size[0]) if len(size) else 0):
        some = order[: np.searchsorted(-size, -k, "left")]
        state[some] = _CRC[(state[some] ^ raw[starts[some] + k]) & 0xFF] ^ (state[some] >> 8)
    return state ^ np.uint32(0xFFFFFFFF)


def _without(word: bytes, at: int) -> bytes:
    text = word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def counted(part: Slice, ids: list[str | None], least: int, deleted: int) -> tuple[list[bytes], list[int]]:
    """Distinct words of a slice and how often they occur."""
    raw = _LOWER[part.raw]
    two = raw == _TWO
    inside = _ASCII[raw] | two
    inside[1:] |= two[:-1]
    starts, ends, counts = spans(part, ~inside)
    lead = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(~two, out=lead[1:])
    length = (lead[ends] - lead[starts]).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    kept = length >= least
    starts, ends, length, row = starts[kept], ends[kept], length[kept], row[kept]
    if not len(starts):
        return [], []
    seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    check = crc32(seed[row], raw, starts, ends).astype(np.int64)
    cut = check % deleted == 0
    data = raw.tobytes()
    _, first, n = np.unique(span_hashes(raw, starts[~cut], ends[~cut]), return_index=True, return_counts=True)
    words = [data[a:b] for a, b in zip(starts[~cut][first].tolist(), ends[~cut][first].tolist())]
    cut &= length > least
    more = [_without(data[a:b], at) for a, b, at in zip(starts[cut].tolist(), ends[cut].tolist(), (check[cut] % length[cut]).tolist())]
    return words + more, n.tolist() + [1] * len(more)


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted: int = DELETED) -> DataFrame:
    """word, n: runs of letters, lower-cased in ASCII, with the hashed deletions; long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words, n = counted(part, batch.column(0).slice(part.first, len(part.starts)).to_pylist(), least_length, deleted)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as code points below 256 in one array, with the starts and ends of the words."""
    part = next(slices(column, 1 << 62))
    two = part.raw == _TWO
    points = part.raw.copy()
    points[1:][two[:-1]] += 64
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(~two, out=before[1:])
    return points[~two], before[part.starts], before[part.ends]


def letter_symbols(words: DataFrame, symbols: int) -> np.ndarray:
    """A symbol from 1 to ``symbols`` for each code point below 256: the next letter goes to the lightest symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_points(batch.column(0))[0], minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["letter", "n"])

    counts = words.select("word").mapInArrow(run, "letter int, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # at most 256 rows
    table = 1 + np.arange(256) % symbols
    heap = [(0, s) for s in range(1, symbols + 1)]
    for n, letter in sorted(((r["n"], r["letter"]) for r in counts), key=lambda x: (-x[0], x[1])):
        load, symbol = heapq.heappop(heap)
        table[letter] = symbol
        heapq.heappush(heap, (load + n, symbol))
    return table.astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        out[size : 2 * size] = out[: min(size, n - size)] * step
        size *= 2
    return out


def _key(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of a reduced word from its polynomial and its length."""
    return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def neighbours(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the whole one-edit neighbourhood of reduced words, themselves included, in bounded steps.

    A word is the sum of symbol * base**place. An edit at a place leaves the sum before it and
    moves the sum behind it by one power, so each neighbour costs a few operations.
    """
    length = ends - starts
    up = _powers(_BASE, int(length.max(initial=0)) + 2)
    a, n = 0, len(starts)
    edges = np.cumsum(length + 1)
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + GENERATED // (2 * kinds + 1), "right")))
        row = np.repeat(np.arange(a, b), length[a:b])
        place = np.arange(len(row)) - np.repeat(np.cumsum(length[a:b]) - length[a:b], length[a:b])
        value = symbols[starts[row] + place]
        sums = np.zeros(len(row) + 1, np.uint64)
        np.cumsum(value * up[place], out=sums[1:])
        first = np.cumsum(length[a:b]) - length[a:b]
        total = sums[first + length[a:b]] - sums[first]
        head = sums[:-1] - sums[first][row - a]  # before each place
        tail = total[row - a] - head  # from each place on
        own = value * up[place]
        size = length[row]
        yield np.arange(a, b), _key(total, length[a:b])
        yield row, _key(head + (tail - own) * np.uint64(_BASE_INVERSE), size - 1)
        for symbol in range(1, kinds + 1):
            other = value != symbol
            yield row[other], _key((head + (tail - own) + np.uint64(symbol) * up[place])[other], size[other])
            yield row, _key(head + tail * np.uint64(_BASE) + np.uint64(symbol) * up[place], size + 1)
            yield np.arange(a, b), _key(total + np.uint64(symbol) * up[length[a:b]], length[a:b] + 1)
        a = b


def reduced(words: DataFrame, table: np.ndarray) -> DataFrame:
    """The columns of ``words`` with the key of each reduced word."""
    names = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, starts, ends = _points(batch.column("word"))
            length = ends - starts
            up = _powers(_BASE, int(length.max(initial=0)) + 1)
            place = np.arange(len(points)) - np.repeat(starts, length)
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(table[points] * up[place], out=sums[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_key(sums[ends] - sums[starts], length).view(np.int64))], names=[*names, "key"])

    return words.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in words.dtypes) + ", key bigint")


def key_bitmap(keyed: DataFrame, bits: int) -> np.ndarray:
    """One bit for each slot that a key falls into: 2**bits bits, whatever the number of keys."""
    slot = F.shiftrightunsigned("key", 64 - bits) + 1  # these functions count from 1
    made = keyed.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    out = np.zeros(max(8, 1 << (bits - 3)), np.uint8)
    for row in made.toLocalIterator():  # at most 2**bits bits in all
        part = np.frombuffer(row["bitmap"], np.uint8)
        at = (row["bucket"] - 1) * len(part)
        out[at : at + len(part)] |= part[: len(out) - at]
    return out


def candidates(words: DataFrame, table: np.ndarray, kinds: int, bitmap: np.ndarray, bits: int) -> DataFrame:
    """word, key for every neighbour of a reduced word that may itself be one of the vocabulary; each once."""
    down = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, starts, ends = _points(batch.column(0))
            rows, keys = [], []
            for row, key in neighbours(table[points], starts, ends, kinds):
                slot = key >> down
                known = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                rows.append(row[known])
                keys.append(key[known])
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[fresh])), pa.array(key[fresh].view(np.int64))], names=["word", "key"])

    return words.select("word").mapInArrow(run, "word string, key bigint")


def one_apart(a: str, b: str) -> bool:
    """Whether one code point inserted, deleted or replaced makes one of the other; linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same, most = 0, len(a)
    while same < most:
        middle = (same + most + 1) // 2
        if a[same:middle] == b[same:middle]:
            same = middle
        else:
            most = middle - 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def near_words(words: DataFrame, symbols: int = SYMBOLS, bits: int = BITMAP_BITS) -> DataFrame:
    """word, near, near_n: every pair of words of the vocabulary ``words(word, n)`` one code point apart, in both directions."""
    table = letter_symbols(words, symbols)
    keyed = stored(reduced(words, table), "spelling-keys")
    dealt = words.repartition(max(1, math.ceil(words.count() / TOGETHER)), "word")  # a word makes a hundred rows and more
    made = candidates(dealt, table, symbols, key_bitmap(keyed, bits), bits)
    met = made.join(keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([one_apart(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    apart = F.abs(F.length("word") - F.length("near")) <= 1
    return met.where((F.col("word") != F.col("near")) & apart).select("word", "near", "near_n").mapInArrow(run, "word string, near string, near_n bigint")


def roots(words: DataFrame) -> DataFrame:
    """word, root for ``words(word, form)`` with a form; each round doubles the steps taken."""
    ahead = words.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = stored(ahead, "spelling-roots")
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = ahead.join(onward, "root", "left")
        if joined.where("_next is not null").isEmpty():
            return ahead
        ahead = joined.select("word", F.coalesce("_next", "root").alias("root"))


def variants(documents: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS, bits: int = BITMAP_BITS, **counting: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for the vocabulary of ``documents(doc_id, text)``."""
    words = stored(vocabulary(documents, **counting), "spelling-words")
    pairs = near_words(words, symbols, bits)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    top = -F.col("best.less")
    fits = top >= ratio * F.col("n")
    linked = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, top).alias("form_n")), "spelling-forms")
    return linked.join(roots(linked), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
