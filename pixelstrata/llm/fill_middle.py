"""Fill-in-the-middle samples: texts cut at unit boundaries that a learned rank index finds.

A unit is a run of ASCII letters or any other single code point. The boundary offsets of all
units of a slice of texts rise with their rank, so straight segments describe them: a segment
starts at a boundary and goes on as long as one slope keeps every boundary within ``ERROR``
bytes of the line (a shrinking cone of slopes). What a segment misses is stored as one signed
byte for each boundary. A cut at rank k is predicted from its segment and corrected by its
residual, which gives the exact offset; no list of boundaries is kept.

Boundaries are found in windows of ``WINDOW`` bytes, so a text of any length needs one byte
for each unit besides itself.

Defined results: a null text counts as empty; an empty text has no units and stays plain.
Repeated rows and equal ids are handled one by one, a null doc_id is hashed as the empty
string. An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixelstrata.functions.byte_spans import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 120  # bytes between a boundary and its segment; a residual then fits in a signed byte
WINDOW = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class RankIndex:
    """Offsets of ascending boundaries by rank: error-bounded segments and a byte of residual each."""

    def __init__(self) -> None:
        self._first: list[int] = []
        self._base: list[int] = []
        self._slope: list[float] = []
        self._residuals: list[np.ndarray] = []
        self.size = 0

    def extend(self, offsets: np.ndarray) -> None:
        """Add boundaries that follow all earlier ones."""
        at, reach = 0, 1024
        while at < len(offsets):
            here = offsets[at : at + reach]
            step = np.arange(1, len(here))
            rise = here[1:] - here[0]
            low = np.maximum.accumulate((rise - ERROR) / step)
            high = np.minimum.accumulate((rise + ERROR) / step)
            over = int(np.argmax(low > high)) if len(step) and low[-1] > high[-1] else len(step)
            if over == len(step) and at + len(here) < len(offsets):
                reach *= 2  # the cone is still open: look further from the same start
                continue
            slope = float(low[over - 1] + high[over - 1]) / 2 if over else 0.0
            line = np.rint(slope * np.arange(over + 1)).astype(np.int64)
            self._first.append(self.size + at)
            self._base.append(int(here[0]))
            self._slope.append(slope)
            self._residuals.append((here[: over + 1] - here[0] - line).astype(np.int8))
            at, reach = at + over + 1, max(1024, 2 * over)
        self.size += len(offsets)

    def close(self) -> RankIndex:
        self.first, self.base, self.slope = np.array(self._first, np.int64), np.array(self._base, np.int64), np.array(self._slope)
        self.residuals = np.concatenate(self._residuals) if self._residuals else np.zeros(0, np.int8)
        self._residuals = []
        return self

    def at(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries of these ranks."""
        k = np.searchsorted(self.first, rank, "right") - 1
        predicted = self.base[k] + np.rint(self.slope[k] * (rank - self.first[k])).astype(np.int64)
        return predicted + self.residuals[rank]


def _units(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[RankIndex, np.ndarray]:
    """Index of all unit boundaries of a slice and the number of units of each row."""
    index, counts = RankIndex(), np.zeros(len(starts), np.int64)
    for a in range(0, len(raw), WINDOW):
        part = raw[a : a + WINDOW]
        letter = _LETTER[part]
        begins = (part & 0xC0) != 0x80
        before = np.empty(len(part), bool)
        before[0] = a > 0 and _LETTER[raw[a - 1]]
        before[1:] = letter[:-1]
        begins &= ~(letter & before)
        first = starts[(starts >= a) & (starts < a + len(part)) & (ends > starts)] - a
        begins[first] = True
        found = np.flatnonzero(begins) + a
        counts += np.searchsorted(found, ends) - np.searchsorted(found, starts)
        index.extend(found)
    return index.close(), counts


def _draw(seed: str, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(documents: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``documents(doc_id, text)``.

    ``form`` is psm, spm or plain. Plain are empty texts, texts that hold a marker themselves
    and the texts beyond ``percent`` of the draws; their output is the text.
    """
    kind = dict(documents.dtypes)["doc_id"]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            for part in slices(batch.column(1)):
                rows = len(part.starts)
                index, n = _units(part.raw, part.starts, part.ends)
                h1, h2, h3, h4 = (np.asarray(batch.column(k).slice(part.first, rows)) for k in range(2, 6))
                x, y = h1 % (n + 1), h2 % (n + 1)
                before = np.cumsum(n) - n
                cut = []
                for k in (np.minimum(x, y), np.maximum(x, y)):
                    at = part.ends.copy()
                    inside = k < n
                    at[inside] = index.at((before + k)[inside])
                    cut.append(at)
                form, head, middle, output = [], [], [], []
                for r, (a, i, j, b) in enumerate(zip(part.starts, *cut, part.ends)):
                    text = part.raw[a:b].tobytes()
                    if a == b or h3[r] % 100 >= percent or p in text or s in text or m in text:
                        form.append("plain"), head.append(None), middle.append(None), output.append(text)
                        continue
                    one, two, three = text[: i - a], text[i - a : j - a], text[j - a :]
                    spm = h4[r] % 100 < spm_percent
                    form.append("spm" if spm else "psm")
                    output.append(b"".join([s, three, p, one, m, two] if spm else [p, one, s, three, m, two]))
                    head.append(int(np.count_nonzero((part.raw[a:i] & 0xC0) != 0x80)))
                    middle.append(int(np.count_nonzero((part.raw[i:j] & 0xC0) != 0x80)))
                columns = [batch.column(0).slice(part.first, rows), pa.array(n), pa.array(form, pa.string()), pa.array(head, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = documents.select("doc_id", "text", *(_draw(seed, k).alias(f"h{k}") for k in range(1, 5)))
    return drawn.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone. A marker never stands inside a part, so the first find is right."""
    def between(opening: str, closing: str) -> Column:
        return F.split_part(F.split_part(F.col(output), F.lit(opening), F.lit(2)), F.lit(closing), F.lit(1))

    middle = F.substring_index(F.col(output), MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)
