"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

``statistics`` turns each whole text into ``len(NAMES)`` numbers. Random cosine features over
them approximate a Gaussian kernel. Each partition of labelled rows adds up its own normal
equations, Spark adds these up row by row, and the driver solves one system of fixed size.
A fold that the ridge has not seen is counted in score bins of fixed number; pooling adjacent
violators over those bins gives the calibration.

Defined results: a null text counts as empty, and empty texts get a score like any other.
Labels that are null or whose id is null are ignored; several labels of one id are averaged
and rounded. Without labels every score is 0.5. An empty table gives an empty result.
Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelstrata.functions import byte_spans as B
from pixelstrata.llm.tables import id_remainder, stored

NAMES = (
    "log_bytes", "lower", "upper", "digit", "blank", "newline", "comma", "stop", "bar", "mark", "high_byte", "entropy",
    "log_words", "word_mean", "word_sd", "word_distinct", "word_top", "pair_distinct", "capital", "shout", "marked",
    "log_lines", "line_mean", "line_distinct", "stop_per_word", "comma_per_word", "short_words", "long_words",
)
FEATURES = 320
BINS = 1024
RIDGE = 1.0

_CLASS = np.zeros((256, 10))
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r", b"\n", b",", b".!?", b"|", b"%*$#&@=<>{}[]\\^~_+/", range(128, 256))):
    _CLASS[list(_bytes), _k] = 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LETTER = (_CLASS[:, [0, 1, 9]].sum(1) > 0)
_UPPER = _CLASS[:, 1] > 0
_LOWER = _CLASS[:, 0] > 0


def _repeats(hashes: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values and share of the most frequent one, of each row (1 and 0 for none)."""
    distinct, top = np.ones(len(counts)), np.zeros(len(counts))
    for r in np.flatnonzero(counts):
        v = np.sort(hashes[ends[r] - counts[r] : ends[r]])
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        distinct[r], top[r] = (len(at) - 1) / len(v), np.diff(at).max() / len(v)
    return distinct, top


def text_statistics(part: B.Slice) -> np.ndarray:
    """One row of ``NAMES`` for each text of a slice."""
    n = len(part.starts)
    out = np.zeros((n, len(NAMES)))
    size = part.ends - part.starts
    histogram = np.stack([np.bincount(part.raw[a:b], minlength=256) for a, b in zip(part.starts, part.ends)]) if n else np.zeros((0, 256))
    share = histogram / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    out[:, 1:11] = share @ _CLASS
    out[:, 11] = -(share * np.log(np.maximum(share, 1e-12))).sum(1)
    hashes, opens, closes, counts = B.words(part)
    ends, some = np.cumsum(counts), np.maximum(counts, 1)
    length = (closes - opens).astype(float)

    def per_row(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[ends] - total[ends - counts]

    out[:, 12] = np.log1p(counts)
    out[:, 13] = per_row(length) / some
    out[:, 14] = np.sqrt(np.maximum(per_row(length**2) / some - out[:, 13] ** 2, 0))
    out[:, 15], out[:, 16] = _repeats(hashes, ends, counts)
    pairs, made = B.shingles(hashes, counts, 2)
    out[:, 17], _ = _repeats(pairs, np.cumsum(made), made)
    if len(opens):
        first, last = part.raw[opens], part.raw[closes - 1]
        second = part.raw[np.minimum(opens + 1, closes - 1)]
        out[:, 18] = per_row(_UPPER[first] & _LOWER[second]) / some
        out[:, 19] = per_row(_UPPER[first] & _UPPER[second] & (length > 1)) / some
        out[:, 20] = per_row(~_LETTER[last]) / some
        out[:, 26] = per_row(length <= 2) / some
        out[:, 27] = per_row(length >= 14) / some
    at, to, lines = B.spans(part, _NEWLINE[part.raw])
    out[:, 21] = np.log1p(lines)
    out[:, 22] = np.log1p(size / np.maximum(lines, 1))
    out[:, 23], _ = _repeats(B.span_hashes(part.raw, at, to), np.cumsum(lines), lines)
    out[:, 24] = share @ _CLASS[:, 6] * size / some
    out[:, 25] = share @ _CLASS[:, 5] * size / some
    return out


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, facts array<float> for every row of ``documents(doc_id, text)``."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch.column(1)):
                facts = text_statistics(part).astype(np.float32)
                at = np.arange(len(facts) + 1, dtype=np.int32) * facts.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(facts)), pa.ListArray.from_arrays(pa.array(at), pa.array(facts.reshape(-1)))], names=["doc_id", "facts"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, facts array<float>")


@dataclass(frozen=True)
class Model:
    """Weights of the cosine features and the calibration; empty ``weights`` stand for no labels."""

    centre: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, facts: np.ndarray) -> np.ndarray:
        z = np.clip((facts - self.centre) / self.scale, -4, 4)
        return np.concatenate([np.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phase), np.ones((len(z), 1))], axis=1)

    def raw(self, facts: np.ndarray) -> np.ndarray:
        return self.features(facts) @ self.weights

    def score(self, facts: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(facts), 0.5)
        return np.interp(self.raw(facts), self.knots, self.levels)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, len(NAMES)))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over rows (facts, y): summed in each partition, then row by row of the matrix."""
    width = model.waves.shape[1] + 1

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for pdf in batches:
            z = model.features(_matrix(pdf["facts"]))
            total[:, :width] += z.T @ z
            total[:, width] += z.T @ pdf["y"].to_numpy(float)
        if total.any():
            yield pd.DataFrame({"i": np.arange(width), "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.stack(pdf["v"].to_numpy()).sum(0)]})

    sums = rows.select("facts", "y").mapInPandas(local, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    total = np.zeros((width, width + 1))
    for r in sums.collect():  # as many rows as features
        total[r["i"]] = r["v"]
    return total[:, :width], total[:, width]


def pooled(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to ``mean`` with ``weight``."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def fit(facts: DataFrame, labels: DataFrame, folds: int = 5, seed: int = 11) -> Model:
    """Learn from labelled rows outside fold 0: the last fold calibrates, the others fit the ridge."""
    rng = np.random.default_rng(seed)
    width = len(NAMES)
    none = np.zeros(0)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = facts.select("doc_id", "facts", id_remainder("doc_id", folds).alias("fold")).where("fold <> 0").join(marks, "doc_id")
    rows = stored(rows, "quality-train")
    fitting, holding = rows.where(F.col("fold") < folds - 1), rows.where(F.col("fold") == folds - 1)
    stats = fitting.select(F.posexplode("facts").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    if not stats:
        return Model(np.zeros(width), np.ones(width), np.zeros((width, FEATURES)), np.zeros(FEATURES), none, none, none)
    centre, scale = np.zeros(width), np.ones(width)
    for r in stats:
        centre[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    model = Model(centre, scale, rng.normal(0, 1 / np.sqrt(width), (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), none, none, none)
    gram, target = normal_equations(fitting, model)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model = Model(centre, scale, model.waves, model.phase, np.linalg.solve(gram + penalty, target), none, none)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(BINS), np.zeros(BINS)
        for pdf in batches:
            at = np.clip(((model.raw(_matrix(pdf["facts"])) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, pdf["y"].to_numpy(float), minlength=BINS)
        k = np.flatnonzero(n)
        yield pd.DataFrame({"bin": k, "n": n[k], "s": s[k]})

    calibration = holding if holding.take(1) else fitting
    bins = calibration.select("facts", "y").mapInPandas(counted, "bin int, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").toPandas()
    at, n, s = bins["bin"].to_numpy(float), bins["n"].to_numpy(), bins["s"].to_numpy()
    level = pooled(n, s / n)
    knots = (at + 0.5) / BINS * 2 - 0.5
    # half a row of doubt at each end; a slight slope keeps order inside pooled blocks
    rows_seen = n.sum()
    level = np.clip((level * rows_seen + 0.5) / (rows_seen + 1), 0, 1) * (1 - 1e-3) + 1e-3 * np.clip((knots + 0.5) / 2, 0, 1)
    return Model(centre, scale, model.waves, model.phase, model.weights, knots, level)


def score(facts: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""
    kind = dict(facts.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.score(_matrix(pdf["facts"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return facts.select("doc_id", "facts").mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents(doc_id, text)``."""
    facts = stored(statistics(documents), "quality-facts")
    out = score(facts, fit(facts, labels), threshold)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` whose text scores at least ``threshold``, with all their columns."""
    model = fit(stored(statistics(documents), "quality-facts"), labels)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                facts = np.concatenate([text_statistics(part) for part in B.slices(batch.column(text))])
                yield batch.filter(pa.array(model.score(facts.astype(np.float32).astype(float)) >= threshold))

    return documents.mapInArrow(run, documents.schema)
