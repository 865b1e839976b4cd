"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Texts become symbols: letters in lower case, every run of other characters one blank. A gram
of four symbols packs into 64 bits, so a partition counts grams by sorting integers and Spark
adds up the counts of all training rows. One interpolated Kneser-Ney model per language is
made from all grams. Scoring looks grams up, backs off where a gram is unknown, and takes the
lowest cross-entropy per symbol.

Up to ``CAPACITY`` grams the models are sorted arrays of hashed keys that every task holds,
with a log-probability column per language. Beyond, the same models are tables keyed by gram
and the grams of each different text are joined to them. No gram is dropped either way; the
two agree up to rounding.

Rejection: per language and power of two of the length, quantiles of the cross-entropy of the
training rows; a text far above them is written in none of the learned languages.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected;
without training rows every text is ``und``. Rows with a null lang or id are never learned
from. Ties go to the language that sorts first. Repeated rows get equal results; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelstrata.functions.byte_spans import slices
from pixelstrata.llm.tables import id_remainder, stored

ORDER = 4
CAPACITY = 1_000_000  # grams up to which the models are sent to every task
LENGTH_CAP = 200  # symbols that count as evidence in the score
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = []


def _symbols_of_characters() -> np.ndarray:
    """Symbol of each code point: 16 bits, 32 for everything but letters."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint16)
        for c in range(1, 0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                table[c] = low if low < 0xE000 else 0xE000 + low % 0x1900
        _FOLD.append(table)
    return _FOLD[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ORDER - 1 zeros before it, and the text that each symbol is of (-1: none)."""
    head = "\0" * (ORDER - 1)
    joined = head + head.join(t.replace("\0", " ") for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + ORDER - 1) - size
    s = _symbols_of_characters()[code]
    row = np.repeat(np.arange(len(texts)), size + ORDER - 1).astype(np.int32)
    fresh = np.zeros(len(s), bool)
    for k in range(1, ORDER):
        fresh[start - k] = True
    s = np.where(fresh, np.uint16(0), s)
    row[fresh] = -1
    again = (s[1:] == 32) & ((s[:-1] == 32) | (s[:-1] == 0))
    keep = np.concatenate([[True], ~again])
    return s[keep], row[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """The gram of ORDER symbols that ends at each symbol."""
    g = s.astype(np.uint64)
    out = g.copy()
    for k in range(1, ORDER):
        out[k:] |= g[:-k] << np.uint64(16 * k)
    return out


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str]]]:
    column = batch.column(at)
    for part in slices(column, 1 << 19):
        yield part.first, [t or "" for t in column.slice(part.first, len(part.starts)).to_pylist()]


def gram_counts(training: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``training(lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        room = 0

        def emptied():
            for lang, parts in held.items():
                key = np.concatenate([k for k, _ in parts])
                n = np.concatenate([c for _, c in parts])
                order = np.argsort(key)
                key, n = key[order], n[order]
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(key[at].view(np.int64)), pa.array(np.add.reduceat(n, at))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, texts in _texts(batch, 1):
                s, row = symbols(texts)
                g = grams(s)
                named, kind = np.unique(langs[first : first + len(texts)], return_inverse=True)
                kind = np.append(kind, -1)[row]
                for k, lang in enumerate(named):
                    key, n = np.unique(g[kind == k], return_counts=True)
                    if not len(key):
                        continue
                    held.setdefault(lang, []).append((key, n))
                    room += len(key)
                if room > 2_000_000:
                    yield from emptied()
                    room = 0
        yield from emptied()

    counts = training.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class HashArray:
    """Values by key: hashes in order, with a directory over their leading bits."""

    hashes: np.ndarray
    values: np.ndarray
    directory: np.ndarray
    shift: np.uint64
    longest: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        h = keys * _ODD
        order = np.argsort(h)
        h, values = h[order], values[order]
        bits = max(1, int(np.ceil(np.log2(len(h) + 1))) + 1)
        shift = np.uint64(64 - bits)
        directory = np.searchsorted(h >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(h, values, directory, shift, int(np.diff(directory).max(initial=0)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashes):
            return out
        h = keys * _ODD
        at = self.directory[h >> self.shift]
        left = None
        for _ in range(self.longest):
            here = np.minimum(at, len(self.hashes) - 1)
            hit = self.hashes[here] == h
            if left is None:
                out[hit] = here[hit]
                left = np.flatnonzero(~hit & (self.hashes[here] < h))
                h, at = h[left], at[left] + 1
            else:
                out[left[hit]] = here[hit]
                go = ~hit & (self.hashes[here] < h) & (at < len(self.hashes))
                left, h, at = left[go], h[go], at[go] + 1
            if not len(left):
                break
        return out


def _discount(n: np.ndarray) -> float:
    return _discount_of(float((n == 1).sum()), float((n == 2).sum()))


def _discount_of(one: float, two: float) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.05


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n.astype(float)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n.astype(float), at)


class Models:
    """Kneser-Ney models of several languages that share one key array per order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        width = len(self.langs)
        vocabulary = len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in counts.values()]))) + 1 if counts else 1
        # per language and order: keys with counts, contexts with (total, kinds); lower orders count the symbols seen before
        levels: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            keys, n = counts[lang]
            n = n.astype(float)
            for order in range(ORDER, 0, -1):
                context, total = _summed(keys >> np.uint64(16), n)
                _, kinds = _summed(keys >> np.uint64(16), np.ones(len(keys)))
                levels[order].append((keys, n, _discount(n), context, total, kinds))
                if order > 1:
                    shorter = keys & np.uint64((1 << (16 * (order - 1))) - 1)
                    keys, n = _summed(shorter, np.ones(len(shorter)))
        self.floor = np.float32(-np.log(vocabulary))
        self.probability: list[HashArray | None] = [None] * (ORDER + 1)
        self.backoff: list[HashArray | None] = [None] * (ORDER + 1)
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([x[0] for x in levels[order]])) if width else np.zeros(0, np.uint64)
            contexts = np.unique(np.concatenate([x[3] for x in levels[order]])) if width else np.zeros(0, np.uint64)
            gamma = np.ones((len(contexts), width))
            direct = np.zeros((len(union), width))
            for k, (keys, n, d, context, total, kinds) in enumerate(levels[order]):
                gamma[np.searchsorted(contexts, context), k] = d * kinds / total
                under = total[np.searchsorted(context, keys >> np.uint64(16))]
                direct[np.searchsorted(union, keys), k] = (n - d) / under
            lower = np.exp(self._log(union & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)) if order > 1 else np.exp(np.full((len(union), width), self.floor))
            p = direct + gamma[np.searchsorted(contexts, union >> np.uint64(16))] * lower
            self.probability[order] = HashArray.of(union, np.log(p).astype(np.float32))
            self.backoff[order] = HashArray.of(contexts, np.log(gamma).astype(np.float32))

    def _log(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log-probability of the last symbol of each gram under each language."""
        out = np.empty((len(keys), len(self.langs)), np.float32)
        if order == 0:
            out[:] = self.floor
            return out
        table = self.probability[order]
        at = table.find(keys)
        known = at >= 0
        out[known] = table.values[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            lower = self._log(keys[rest] & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
            context = self.backoff[order].find(keys[rest] >> np.uint64(16))
            seen = context >= 0
            lower[seen] += self.backoff[order].values[context[seen]]
            out[rest] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol under each language, and the number of letters, of each text."""
        s, row = symbols(texts)
        g = grams(s)
        real = row >= 0
        g, row, s = g[real], row[real], s[real]
        n = np.bincount(row, minlength=len(texts))
        letters = np.bincount(row[s != 32], minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        logs = self._log(g, ORDER)
        if len(g):
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[at]] = np.add.reduceat(logs, at, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], letters


def _lower(gram: str, order: int) -> F.Column:
    """The last order - 1 symbols of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1).cast("bigint"))


@dataclass
class ModelTable:
    """The models as tables: for each order the direct part of each gram and the weight behind each context, by language."""

    langs: list[str]
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    floor: float
    probability: tuple = ()  # no task holds arrays

    @classmethod
    def of(cls, counts: DataFrame, langs: list[str]) -> ModelTable:
        """From all rows of ``counts(lang, gram, n)``."""

        def by_language(value: str, absent: float) -> F.Column:
            return F.array(*[F.coalesce(F.max(F.when(F.col("lang") == k, F.col(value))), F.lit(absent)) for k in langs])

        vocabulary = counts.select(_lower("gram", 2)).distinct().count() + 1
        level, direct, behind = counts, {}, {}
        for order in range(ORDER, 0, -1):
            ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
            facts = level.groupBy("lang").agg(ones.alias("one"), twos.alias("two")).collect()
            discount = F.coalesce(*[F.when(F.col("lang") == r["lang"], _discount_of(r["one"], r["two"])) for r in facts])
            rows = level.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("d", discount)
            context = stored(rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.max("d") * F.count(F.lit(1)) / F.sum("n")).alias("gamma")), "lang-contexts")
            behind[order] = stored(context.groupBy("context").agg(by_language("gamma", 1.0).alias("gamma")), "lang-behind")
            parts = rows.join(context, ["lang", "context"]).withColumn("p", (F.col("n") - F.col("d")) / F.col("total"))
            direct[order] = stored(parts.groupBy("gram").agg(by_language("p", 0.0).alias("direct")), "lang-direct")
            if order > 1:
                level = stored(level.groupBy("lang", _lower("gram", order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lang-lower")
        return cls(langs, direct, behind, 1 / vocabulary)

    def logs(self, asked: DataFrame) -> DataFrame:
        """gram, logs: log-probability of the last symbol of each gram of ``asked(gram)`` under each language."""
        wanted = {ORDER: stored(asked.select("gram").distinct(), "lang-asked")}
        for order in range(ORDER, 1, -1):
            wanted[order - 1] = wanted[order].select(_lower("gram", order).alias("gram")).distinct()

        def all_of(x: float) -> F.Column:
            return F.array(*[F.lit(x) for _ in self.langs])

        lower = None
        for order in range(1, ORDER + 1):
            rows = wanted[order].withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("shorter", _lower("gram", order))
            rows = rows.join(self.grams[order], "gram", "left").join(self.contexts[order], "context", "left")
            rows = rows.join(lower, "shorter") if order > 1 else rows.withColumn("lower", all_of(self.floor))
            backed = F.zip_with(F.coalesce("gamma", all_of(1.0)), "lower", lambda a, b: a * b)
            p = rows.select("gram", F.zip_with(F.coalesce("direct", all_of(0.0)), backed, lambda a, b: a + b).alias("lower"))
            lower = p.withColumnRenamed("gram", "shorter")
        return p.select("gram", F.transform("lower", lambda x: F.log(x)).alias("logs"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """_key, _e (by language), _letters of each row of ``texts(_key, text)`` that has symbols; keys are different."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part in _texts(batch, 1):
                    s, row = symbols(part)
                    g, real = grams(s), row >= 0
                    g, row = g[real], row[real]
                    order = np.lexsort((g, row))
                    g, row = g[order], row[order]
                    at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])) if len(g) else np.zeros(0, np.int64)
                    n = np.diff(np.append(at, len(g)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row[at].astype(np.int64))), pa.array(g[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["_key", "gram", "n"])

        rows = stored(texts.select("_key", "text").mapInArrow(run, "_key binary, gram bigint, n bigint"), "lang-text-grams")
        total = F.array(*[F.sum(F.col("n") * F.col("logs")[k]) for k in range(len(self.langs))])
        letters = F.sum(F.when(_lower("gram", 2) != 32, F.col("n")).otherwise(0))
        sums = rows.join(self.logs(rows), "gram").groupBy("_key").agg(total.alias("t"), F.sum("n").alias("n"), letters.alias("_letters"))
        return sums.select("_key", F.transform("t", lambda x: -x / F.col("n")).alias("_e"), "_letters")


def fit(training: DataFrame, capacity: int = CAPACITY) -> Models | ModelTable:
    """Models from all rows of ``training(lang, text)``, both not null; a table beyond ``capacity`` grams."""
    counts = stored(gram_counts(training), "lang-grams")
    kinds = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if sum(r["n"] for r in kinds) > capacity:
        return ModelTable.of(counts, sorted(r["lang"] for r in kinds))
    table = counts.toPandas()
    return Models({lang: (np.sort(g["gram"].to_numpy().view(np.uint64)), g["n"].to_numpy()[np.argsort(g["gram"].to_numpy().view(np.uint64))]) for lang, g in table.groupby("lang")})


def _scored_by_table(documents: DataFrame, models: ModelTable) -> DataFrame:
    """As ``_scored``; each different text is scored once."""
    rows = documents.withColumn("_key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = rows.where("text is not null").groupBy("_key").agg(F.first("text").alias("text"))
    lowest, some = F.array_min("_e"), F.coalesce("_letters", F.lit(0)) > 0
    odds = F.transform("_e", lambda x: F.exp(-(x - F.array_min("_e")) * F.least("_letters", F.lit(LENGTH_CAP))))
    score = 1 / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    lang = F.element_at(F.array(*[F.lit(k) for k in models.langs]), F.array_position("_e", lowest).cast("int"))
    return rows.join(models.entropies(texts), "_key", "left").select(
        *documents.columns,
        F.when(some, lang).otherwise("und").alias("_lang"),
        F.coalesce(lowest, F.lit(0.0)).alias("_entropy"),
        F.coalesce("_letters", F.lit(0).cast("bigint")).alias("_letters"),
        F.when(some, score).otherwise(0.0).alias("_score"),
    )


def _scored(documents: DataFrame, models: Models | ModelTable) -> DataFrame:
    """The columns of ``documents`` and _lang, _entropy, _letters, _score."""
    if isinstance(models, ModelTable):
        return _scored_by_table(documents, models)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(models)
    columns, text = documents.columns, documents.columns.index("text")
    schema = ", ".join(f"`{c}` {k}" for c, k in documents.dtypes) + ", _lang string, _entropy double, _letters bigint, _score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs + ["und"], object)
        for batch in batches:
            for first, texts in _texts(batch, text):
                e, letters = m.entropies(texts)
                if m.langs:
                    best = np.where(letters > 0, e.argmin(1), len(m.langs))
                    evidence = np.minimum(letters, LENGTH_CAP)[:, None]
                    odds = np.exp(-(e - e.min(1, keepdims=True)) * evidence)
                    score = np.where(letters > 0, 1 / odds.sum(1), 0.0)
                    lowest = e.min(1)
                else:
                    best, score, lowest = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best].tolist(), pa.string()), pa.array(lowest), pa.array(letters.astype(np.int64)), pa.array(score)],
                    names=[*columns, "_lang", "_entropy", "_letters", "_score"],
                )

    return documents.mapInArrow(run, schema)


def _learnable(documents: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return documents.where((id_remainder("doc_id", modulus) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _limits(scored: DataFrame) -> dict[tuple[str, int], float]:
    """Highest cross-entropy that counts as the language, by language and power of two of the length."""
    own = scored.where("_lang = lang and _letters > 0")
    at = F.floor(F.log2("_letters")).cast("int").alias("size")
    rows = own.groupBy("lang", at).agg(F.percentile_approx("_entropy", [0.5, 0.99], 1000).alias("q")).collect()
    return {(r["lang"], r["size"]): r["q"][0] + 4 * (r["q"][1] - r["q"][0]) + 1.0 for r in rows}


def _rejected(limits: dict[tuple[str, int], float]) -> F.Column:
    size = F.floor(F.log2(F.greatest("_letters", F.lit(1)))).cast("int")
    known = [F.when((F.col("_lang") == lang) & (size == k), v) for (lang, k), v in sorted(limits.items())]
    widest = {lang: max(v for (x, _), v in limits.items() if x == lang) for lang, _ in limits}
    known += [F.when(F.col("_lang") == lang, v) for lang, v in sorted(widest.items())]
    return (F.col("_lang") == "und") | (F.col("_entropy") > (F.coalesce(*known) if known else F.lit(float("inf"))))


def languages(documents: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``documents(doc_id, text, lang)``."""
    slim = documents.select("doc_id", "text", "lang")
    models = fit(_learnable(slim, modulus, held_out))
    scored = stored(_scored(slim, models).drop("text"), "lang-scores")
    limits = _limits(scored.where(id_remainder("doc_id", modulus) != held_out))
    held = F.coalesce(id_remainder("doc_id", modulus) == held_out, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), _rejected(limits).alias("rejected"))


def keep_identified(documents: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of ``documents`` that some learned language explains, with all their columns."""
    slim = documents.select("doc_id", "text", "lang")
    learnable = _learnable(slim, modulus, held_out)
    models = fit(learnable)
    limits = _limits(stored(_scored(learnable, models).drop("text"), "lang-scores"))
    return _scored(documents, models).where(~_rejected(limits)).select(documents.columns)
