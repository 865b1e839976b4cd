"""Benchmark decontamination: an FM-index over each shard of the corpus, searched for test phrases.

A shard is about ``SHARD_WORDS`` words of consecutive texts inside a task. Its words become
symbols (ranks in the shard's own vocabulary), every text ends with a separator of its own.
The suffix array comes from sorting triples of symbols and then prefix doubling among the
suffixes that are still tied; equal texts of a shard are indexed once. Kept of it are the
Burrows-Wheeler transform as a wavelet tree (levels of bits with rank counts, stored as a
matrix) and the suffix positions at text starts and at every ``SAMPLE``-th word.

A phrase is a window of ``width`` consecutive words of an item, or the whole item where it
has fewer. All windows are searched backward at once, a symbol a step, by rank queries.
Occurrences walk back to a sampled position; the words they cover are merged into spans.

Texts longer than a shard are cut with an overlap of the longest phrase, and read in windows
of ``WINDOW`` bytes. Items come to the driver in blocks of at most ``BLOCK_WORDS`` words (one
item at least); each block is one more pass over the corpus, which adds to the spans so far.

Words are compared by 64-bit hashes: two of a shard's and block's words are confused with a
probability below n * m / 2**64, 1e-7 for a million of each.

Defined results: null texts and texts without words have no spans; items that are null or
without words never occur. Items with equal text all count, and an item_id counts once per
document; hits of an item without id count as hits, but name no item. Repeated documents and
null doc_ids are handled row by row. Empty tables give an empty result, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixelstrata.functions.byte_spans import Slice, slices, span_hashes, spans
from pixelstrata.llm.tables import stored

WIDTH = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20
WINDOW = 1 << 20
SAMPLE = 16
LOCATED = 1 << 18  # occurrences located in one step

#: ASCII letters and digits and everything beyond ASCII belong to words; A-Z become a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False


def words(part: Slice) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes, first and last code point of each word, words of each row) of a slice.

    A text of more than ``WINDOW`` bytes comes in several steps, cut between words.
    """
    raw, at, base = part.raw, 0, 0
    long = len(part.starts) == 1 and len(raw) > WINDOW
    while True:
        end = min(at + WINDOW, len(raw)) if long else len(raw)
        while end < len(raw) and not (gap := _GAP[_LOWER[raw[end : end + WINDOW]]]).any():
            end = min(end + WINDOW, len(raw))
        end += int(np.argmax(gap)) if end < len(raw) else 0
        here = _LOWER[raw[at:end]]
        starts, ends = (np.zeros(1, np.int64), np.array([len(here)])) if long else (part.starts, part.ends)
        opens, closes, counts = spans(Slice(part.first, here, starts, ends), _GAP[here])
        points = np.zeros(len(here) + 1, np.int32)
        np.cumsum((here & 0xC0) != 0x80, out=points[1:])
        shift = base if long else -np.repeat(points[starts], counts)
        yield part.first, span_hashes(here, opens, closes), points[opens] + shift, points[closes] + shift, counts
        base, at = base + int(points[-1]), end
        if at >= len(raw):
            return


class WaveletMatrix:
    """Symbols by levels of bits, most significant first; ranks by counts of 64-bit blocks."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = symbols
        for level in range(width - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.zeros((len(now) // 64 + 1) * 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[: len(bits)] = bits
            blocks = packed.view(np.uint64)
            before = np.zeros(len(blocks), np.int64)
            np.cumsum(np.bitwise_count(blocks[:-1]), out=before[1:])
            zeros = len(now) - int(np.count_nonzero(bit))
            self.levels.append((blocks, before, zeros))
            now = np.concatenate([now[~bit], now[bit]])
        turn = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]])) if len(now) else np.zeros(0, np.int64)
        self.first = np.zeros(1 << width, np.int64)  # where each symbol begins after the last level
        self.first[now[turn]] = turn

    @staticmethod
    def bit(blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    @staticmethod
    def ones(blocks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(blocks[block] & below)

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi."""
        for k, (blocks, before, zeros) in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            a, b = self.ones(blocks, before, lo), self.ones(blocks, before, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo - self.first[symbol], hi - self.first[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for blocks, before, zeros in self.levels:
            one = self.bit(blocks, at)
            a = self.ones(blocks, before, at)
            at = np.where(one, zeros + a, at - a)
            symbol = (symbol << 1) | one
        return symbol, at - self.first[symbol]


def suffix_array(text: np.ndarray, top: int) -> np.ndarray:
    """Positions in the order of their suffixes; symbols below ``top`` and smallest ones that occur once end all ties."""
    n, bits = len(text), max(1, int(top).bit_length())
    packed = text.astype(np.uint64)
    key = packed.copy()
    deep = min(62 // bits, 8)
    for k in range(1, deep):
        key <<= np.uint64(bits)
        key[: max(0, n - k)] |= packed[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    reach = deep
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    slots = np.flatnonzero(~alone)
    while len(slots):
        here = order[slots]
        key = rank[here] * (n + 1) + np.where(here + reach < n, rank[np.minimum(here + reach, n - 1)] + 1, 0)
        turn = np.argsort(key)
        here, key = here[turn], key[turn]
        order[slots] = here
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[here] = slots[first]
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = slots[~alone]
        reach *= 2
    return order


class FMIndex:
    """Search in a list of word sequences (arrays of hashes)."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        self.vocabulary, ids = np.unique(flat, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        n, many, kinds = len(flat) + len(texts), len(texts), len(self.vocabulary)
        text = np.empty(n, np.int64)
        gap = np.zeros(n, bool)
        gap[ends] = True
        text[gap] = np.arange(many)
        text[~gap] = ids + many
        order = suffix_array(text, many + kinds)
        last = text[order - 1]  # the symbol before each suffix; before the first stands the last separator
        last = np.where(last < many, 0, last - many + 1)
        self.tree = WaveletMatrix(last.astype(np.uint32), max(1, int(kinds).bit_length()))
        self.below = np.zeros(kinds + 2, np.int64)  # rows of smaller symbols; symbol 0 are the separators
        np.cumsum(np.bincount(last, minlength=kinds + 1), out=self.below[1:])
        kept = order % SAMPLE == 0
        at_start = np.zeros(n, bool)
        at_start[self.starts] = True
        kept |= at_start[order]
        self.kept = WaveletMatrix(kept.astype(np.uint32), 1)
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns of one length (m x length hashes); lo = hi for none."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, patterns), len(self.vocabulary) - 1)
        live = np.flatnonzero((self.vocabulary[at] == patterns).all(1))
        symbols = at[live] + 1
        a, b = self.below[symbols[:, -1]], self.below[symbols[:, -1] + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            if not len(live):
                return lo, hi
            symbol = symbols[:, k]
            x, y = self.tree.ranks(symbol, a, b)
            a, b = self.below[symbol] + x, self.below[symbol] + y
            some = a < b
            live, symbols, a, b = live[some], symbols[some], a[some], b[some]
        lo[live], hi[live] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        blocks, before, _ = self.kept.levels[0]
        while len(left):
            sampled = self.kept.bit(blocks, rows)
            out[left[sampled]] = self.positions[self.kept.ones(blocks, before, rows[sampled])] + steps
            left, rows = left[~sampled], rows[~sampled]
            symbol, rank = self.tree.symbol_and_rank(rows)
            rows = self.below[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of a block of items by length, and the items that have each."""

    patterns: dict[int, np.ndarray]
    owners: dict[int, list[frozenset[str]]]

    @property
    def longest(self) -> int:
        return max(self.patterns, default=1)

    @classmethod
    def of(cls, items: list[tuple[str | None, np.ndarray]], width: int) -> Phrases:
        found: dict[int, dict[bytes, set[str]]] = {}
        for name, hashes in items:
            n = min(width, len(hashes))
            for a in range(len(hashes) - n + 1) if n else ():
                found.setdefault(n, {}).setdefault(hashes[a : a + n].tobytes(), set()).update([] if name is None else [name])
        patterns = {n: np.frombuffer(b"".join(w), np.uint64).reshape(-1, n) for n, w in found.items()}
        return cls(patterns, {n: [frozenset(k) for k in w.values()] for n, w in found.items()})


@dataclass
class _Document:
    """A row on its way: words so far, runs of hit words with their code points, items."""

    n_words: int = 0
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    items: set[str] = field(default_factory=set)


class _Shard:
    """Parts of documents that are indexed and searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.size = phrases, 0
        self.parts: list[tuple[_Document, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, document: _Document, first: int, hashes: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> None:
        if len(hashes):
            self.parts.append((document, first, hashes, opens, closes))
            self.size += len(hashes)

    def search(self) -> None:
        """Note every occurrence with its documents and forget the parts."""
        copies: dict[bytes, list[int]] = {}
        for k, part in enumerate(self.parts):
            copies.setdefault(hashlib.blake2b(part[2].tobytes(), digest_size=16).digest(), []).append(k)
        if copies and self.phrases.patterns:
            groups = list(copies.values())
            self._note(FMIndex([self.parts[g[0]][2] for g in groups]), groups)
        self.parts, self.size = [], 0

    def _note(self, index: FMIndex, groups: list[list[int]]) -> None:
        edge = np.zeros(int(index.starts[-1]) + len(self.parts[groups[-1][0]][2]) + 2, np.int32)
        for n, patterns in self.phrases.patterns.items():
            lo, hi = index.search(patterns)
            which = np.flatnonzero(lo < hi)
            counts = (hi - lo)[which]
            done = np.cumsum(counts)
            for a in range(0, int(done[-1]) if len(done) else 0, LOCATED):
                flat = np.arange(a, min(a + LOCATED, int(done[-1])))
                w = np.searchsorted(done, flat, "right")
                at = index.locate(lo[which[w]] + flat - (done[w] - counts[w]))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n, -1)
                group = np.searchsorted(index.starts, at, "right") - 1
                for g, x in zip(*np.divmod(np.unique(group * len(patterns) + which[w]), len(patterns))):
                    for k in groups[g]:
                        self.parts[k][0].items |= self.phrases.owners[n][x]
        hit = np.cumsum(edge) > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for a, b in zip(turn[::2], turn[1::2]):
            g = int(np.searchsorted(index.starts, a, "right")) - 1
            a, b = a - index.starts[g], b - index.starts[g]
            for k in groups[g]:
                document, first, _, opens, closes = self.parts[k]
                document.runs.append((first + int(a), first + int(b), int(opens[a]), int(closes[b - 1])))


def _merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            a, b, c, d = out.pop()
            run = (a, max(b, run[1]), c, max(d, run[3]))
        out.append(run)
    return out


_RUNS = "array<struct<first:bigint,past:bigint,start:bigint,stop:bigint>>"


def _pass(state: DataFrame, phrases: Phrases, keep_text: bool) -> DataFrame:
    """Search one block of phrases in all rows of ``state(doc_id, text, n_words, runs, items)``."""
    kind = dict(state.dtypes)["doc_id"]
    overlap = phrases.longest - 1
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "past", "start", "stop")]))
    names = ["doc_id"] + ["text"] * keep_text + ["n_words", "runs", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(phrases)
        waiting: list[tuple[pa.RecordBatch, list[_Document]]] = []

        def made() -> Iterator[pa.RecordBatch]:
            shard.search()
            for rows, documents in waiting:
                given = [rows.column(name) for name in names[: 1 + keep_text]]
                runs = pa.array([[dict(zip(("first", "past", "start", "stop"), r)) for r in _merged(d.runs)] for d in documents], run_type)
                yield pa.RecordBatch.from_arrays([*given, pa.array([d.n_words for d in documents], pa.int64()), runs, pa.array([sorted(d.items) for d in documents], pa.list_(pa.string()))], names=names)
            waiting.clear()

        for batch in batches:
            for part in slices(batch.column(1)):
                rows = batch.slice(part.first, len(part.starts))
                documents = [_Document(0, [tuple(r.values()) for r in runs or ()], set(items or ())) for runs, items in zip(rows.column("runs").to_pylist(), rows.column("items").to_pylist())]
                waiting.append((rows if keep_text else rows.select(["doc_id"]), documents))
                tail, searched = None, False
                for _, hashes, opens, closes, counts in words(part):
                    if len(documents) > 1:
                        past = np.cumsum(counts)
                        for d, a, b in zip(documents, past - counts, past):
                            d.n_words = int(b - a)
                            shard.add(d, 0, hashes[a:b], opens[a:b], closes[a:b])
                        continue
                    d = documents[0]
                    if tail is not None:
                        hashes, opens, closes = (np.concatenate(pair) for pair in zip(tail, (hashes, opens, closes)))
                    first = d.n_words - (len(tail[0]) if tail is not None else 0)
                    d.n_words = first + len(hashes)
                    shard.add(d, first, hashes, opens, closes)
                    tail = tuple(x[max(0, len(x) - overlap) :] for x in (hashes, opens, closes))
                    if shard.size >= SHARD_WORDS:
                        shard.search()
                        searched = True
                if searched or shard.size >= SHARD_WORDS:
                    yield from made()
        yield from made()

    return state.mapInArrow(run, f"doc_id {kind}, " + "text string, " * keep_text + f"n_words bigint, runs {_RUNS}, items array<string>")


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """Items as (id as text, hashes of words), in blocks of a bounded number of words; read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        hashes = [h for part in slices(pa.array([row["text"]], pa.string())) for _, h, _, _, _ in words(part)]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        if block and size + len(hashes) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], hashes))
        size += len(hashes)
    yield block


def hits(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """doc_id, (text,) n_words, runs, items for every row of ``documents(doc_id, text)``.

    ``runs`` are the merged spans to remove: words [first, past) and code points [start, stop).
    ``items`` are the ids, as sorted text, of the rows of ``benchmark(item_id, text)`` of which
    a window occurs.
    """
    state = documents.select("doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_RUNS).alias("runs"), F.array().cast("array<string>").alias("items"))
    held = None
    for block in _blocks(benchmark):
        if held is not None:
            state = stored(_pass(state, held, True), "phrase-hits")
        held = Phrases.of(block, width)
    return _pass(state, held, keep_text)


def cleaned(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text without the spans of any phrase, and how many words went."""
    found = hits(documents, benchmark, width, keep_text=True)
    opens = F.concat(F.array(F.lit(0).cast("bigint")), F.col("runs.stop"))
    closes = F.concat(F.col("runs.start"), F.array(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")))
    kept = F.transform(F.arrays_zip(opens.alias("a"), closes.alias("b")), lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    text = F.when(F.col("text").isNotNull(), F.concat_ws("", kept))
    return found.select("doc_id", text.alias("text"), hit_words().alias("n_removed"))


def hit_words() -> Column:
    return F.aggregate("runs", F.lit(0).cast("bigint"), lambda total, r: total + r["past"] - r["first"])
