"""Words and lines of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column.

A text column arrives from Spark as one byte buffer with offsets. Everything here works on
that buffer, so no Python string is made for a word. Texts are handled in slices of about
``SLICE_BYTES`` bytes; one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Bytes 0x20 and 0x09 to 0x0D part words; A-Z become a-z.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (two multiply and shift steps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, as far as the longest slice so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        while len(cls.up) < n:
            size = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(int(_BASE), size, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(int(_BASE_INVERSE), size, 1 << 64))])


@dataclass
class Slice:
    """Rows ``first`` to ``first + len(starts) - 1`` of a batch; row r has bytes starts[r]:ends[r] of ``raw``."""

    first: int
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:]
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        b = min(b, n)
        yield Slice(a, raw[at[a] : at[b]], starts[a:b] - at[a], ends[a:b] - at[a])
        a = b


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial by prefix sums, then mixed with the length."""
    _Powers.to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(part: Slice, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap`` (a mask over ``part.raw``) and the number of runs of each row."""
    inside = ~gap
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    if n:
        edge[0], edge[n] = inside[0], inside[-1]
        edge[1:n] = inside[1:] != inside[:-1]
    if len(part.starts) > 1:  # texts touch one another in the buffer
        cut = part.starts[1:]
        cut = cut[(cut > 0) & (cut < n)]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    else:
        cut = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    opens, closes = at[::2], at[1::2]
    if len(cut):
        opens = np.sort(np.concatenate([opens, cut]))
        closes = np.sort(np.concatenate([closes, cut]))
    counts = np.searchsorted(opens, part.ends) - np.searchsorted(opens, part.starts)
    return opens, closes, counts


def words(part: Slice, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of a slice and the number of words of each row."""
    raw = _LOWER[part.raw] if lower else part.raw
    opens, closes, counts = spans(part, _WHITE[part.raw])
    return span_hashes(raw, opens, closes), opens, closes, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words inside each row; a row of fewer words gives its whole sequence as one."""
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), made)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)
    out = np.zeros(len(at), np.uint64)
    last = first[row + 1]
    for k in range(width):
        here = at + k
        there = here < last
        value = np.where(there, hashes[np.minimum(here, max(len(hashes) - 1, 0))] if len(hashes) else np.uint64(0), np.uint64(k + 1))
        out = mix(out * np.uint64(0xA24BAED4963EE407) + value)
    return out, made
