"""Nearest rows by inner product, found through stable projections and kd-trees.

Inner products become distances by one more coordinate (rows scaled to the largest norm, so
the nearest row has the largest product). Gaussian projections to ``PROJECTED`` dimensions
are 2-stable: the squared projected distance of a pair is its squared distance times a
chi-square variable. Rows are cut into the cells of a kd-tree over a sample of projections
(at most 64 rows for each of at most 4,096 cells), larger cells into blocks by hash. A task
builds a kd-tree over one block and, for each query sent to it, verifies rows in the order of
their own projected distances, a part at a time; rows that many queries of a batch want are
multiplied at once, others singly. It stops when the chi-square test says that a row nearer
than the k-th found so far, there or in the query's first block, would have been met with
probability ``confidence``; rows that can have an equal product are verified too. Equal
vectors are searched as one and expanded to their rows with the smallest ids afterwards.
Equal scores go to the smaller id, in every cut.

Defined results: vectors that are null, zero, of another length than the most frequent one or
hold null or non-finite components take no part, nor do null ids. With fewer candidates than
``k`` all are returned. Rows that repeat a query's id are its own and no candidates; other
repeated ids are candidates of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pixelstrata.llm.embedding_links import usable
from pixelstrata.llm.tables import stored

PROJECTED = 16
LEAF = 128
BLOCK = 16_384
QUERY_BLOCK = 16_384
TOGETHER = 40  # queries searched at once in a task
SINGLE = 0.03  # below this share of wanted pairs rows are verified one by one, else the wanted rows of all queries by one product
STRIDE = 8  # every so many rows tell where a part ends
PARTS = (8, 32, 128, 512, 0)  # rows of a query verified before its reach is measured again, in multiples of k; the last takes the rest
MOST_CELLS = 12  # halvings of the kd-tree over the sample
SAMPLED = 64  # rows of the sample for each cell
SPARE = 8  # kept beyond k until scores are computed in a fixed order of addition
ROUNDING = 1e-12  # squared projected distance that rounding can make of none
SALTS = 32  # parts of a group of equal vectors


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value below which a chi-square variable lies with probability p (even degrees)."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, degrees // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves: halved at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = points[rows]
        widest = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, widest], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """embedding, ids, counts: each vector once, with the k + 1 smallest ids of its rows and how many rows (k at most) each has."""
    found = rows.groupBy("embedding", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for by in (["embedding", "salt"], ["embedding"]):
        found = found.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy("vec_id"))).where(F.col("at") <= k + 1).drop("at")
    members = F.array_sort(F.collect_list(F.struct("vec_id", "n")))
    return found.groupBy("embedding").agg(members.alias("m")).select("embedding", F.col("m.vec_id").alias("ids"), F.col("m.n").alias("counts"))


def plane(d: int, projected: int = PROJECTED, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(d + 1, projected))


def project(rows: np.ndarray, top: float, onto: np.ndarray) -> np.ndarray:
    """Projections of rows scaled to the largest norm ``top`` and lifted to the unit sphere."""
    lift = np.sqrt(np.maximum(0, 1 - (rows**2).sum(1) / top**2))
    return (rows / top) @ onto[:-1] + lift[:, None] * onto[-1]


def box_gap(aims: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each query to each box."""
    out = np.stack([np.maximum(0, np.maximum(low[j] - aims, aims - high[j])) for j in range(len(low))], 1)
    return (out**2).sum(2)


def squared_gaps(aims: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared projected distance of each query to each row."""
    return np.maximum(0, (aims**2).sum(1)[:, None] + (points**2).sum(1) - 2 * (aims @ points.T))


def search_block(first, second, rows, query_ids, queries, top: float, k: int, confidence: float, floor=None, projected: int = PROJECTED, seed: int = 5):
    """For each query the numbers and products of its best rows of one block, and how many pairs were verified.

    ``top``: largest norm of all rows; ``first`` and ``second``: the two smallest ids of each row, equal if it has one;
    ``floor``: a product that k rows elsewhere are known to reach. Leaves are opened in order of their projected distance and
    give up their rows in the order of the rows' own projected distances, some at a time.
    """
    onto = plane(rows.shape[1], projected, seed)
    points = project(rows, top, onto)
    leaves = kd_leaves(points)
    turned = np.concatenate(leaves)  # rows by leaf, so that a leaf is a slice
    first, second, rows, points = first[turned], second[turned], rows[turned], points[turned]
    ends = np.cumsum([len(r) for r in leaves])
    leaves = [slice(b - len(r), b) for b, r in zip(ends, leaves)]
    low = np.stack([points[r].min(0) for r in leaves])
    high = np.stack([points[r].max(0) for r in leaves])
    place = np.unique(np.concatenate([first, second]), return_inverse=True)[1]
    place = np.stack([place[: len(rows)], place[len(rows) :]])
    bound = chi_square_quantile(confidence, projected)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    keep = min(k + SPARE, len(rows))
    who, best, verified = np.full((len(queries), keep), -1, np.int64), np.full((len(queries), keep), -np.inf), 0
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        who[part], best[part], n = _search(first, second, place, rows, points, leaves, low, high, query_ids[part], queries[part], floor[part], onto, top, k, bound)
        verified += n
    return np.where(who >= 0, turned[who], -1), best, verified


def _search(first, second, place, rows, points, leaves, low, high, query_ids, queries, floor, onto, top, k, bound):
    d = rows.shape[1]
    norm = np.linalg.norm(queries, axis=1)
    direction = queries / norm[:, None]
    slack = 4 * (d + 2) * np.finfo(float).eps * top
    floor = floor / norm - slack
    aims = direction @ onto[:-1]
    gap = box_gap(aims, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    n, keep = len(queries), min(k + SPARE, len(rows))
    wanted = min(k, keep)
    best = np.full((n, keep), -np.inf)
    who = np.full((n, keep), -1, np.int64)
    waiting = np.full((n, len(rows)), np.inf)  # projected distances of opened rows that are not verified yet

    def reach(mine: np.ndarray) -> np.ndarray:
        """Projected distance within which a row nearer than the k-th would lie."""
        worst = np.partition(best[mine], keep - k, axis=1)[:, keep - k] if k <= keep else np.full(len(mine), -np.inf)
        worst = np.maximum(worst, floor[mine])
        return np.where(np.isfinite(worst), bound * np.maximum(0, 2 - 2 * worst / top) + ROUNDING, np.inf)

    def verify(mine: np.ndarray, ahead: np.ndarray, due: np.ndarray, products: np.ndarray | None = None) -> int:
        """Takes the rows ``ahead`` that are due to each query among its best."""
        if products is None:
            products = np.full(due.shape, -np.inf)
            q, c = np.nonzero(due)
            products[q, c] = np.einsum("aj,aj->a", rows[ahead[c]], direction[mine[q]])
        hopeful = np.flatnonzero((due & (products >= best[mine].min(1)[:, None] - slack)).any(0))
        if not len(hopeful):
            return int(due.sum())
        x = ahead[hopeful]
        own = (query_ids[mine][:, None] == first[x]) & (query_ids[mine][:, None] == second[x])  # a query is no candidate of its own
        value = np.concatenate([best[mine], np.where(due[:, hopeful] & ~own, products[:, hopeful], -np.inf)], 1)
        name = np.concatenate([who[mine], np.broadcast_to(x, (len(mine), len(x)))], 1)
        chosen = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
        least = np.partition(value, value.shape[1] - wanted, axis=1)[:, value.shape[1] - wanted]
        close = (value >= least[:, None] - slack) & np.isfinite(value)
        for c in np.flatnonzero(close.sum(1) > keep):  # more equals than room: by score and id
            among = np.flatnonzero(close[c])
            x = name[c, among]
            tie = np.where(first[x] == query_ids[mine[c]], place[1, x], place[0, x])
            chosen[c] = among[np.lexsort((tie, -(rows[x] * queries[mine[c]]).sum(1)))[:keep]]
        best[mine], who[mine] = np.take_along_axis(value, chosen, 1), np.take_along_axis(name, chosen, 1)
        return int(due.sum())

    def within(mine: np.ndarray, until: np.ndarray) -> np.ndarray:
        return np.minimum(np.minimum(until, reach(mine)), np.finfo(float).max)

    active, at, step, verified = np.arange(n), 0, 1, 0
    while len(active) and at < len(leaves):
        step = step if at + 2 * step < len(leaves) else len(leaves) - at
        turn = order[active, at : at + step]
        for j in np.unique(turn):
            mine = active[(turn == j).any(1)]
            waiting[mine, leaves[j]] = squared_gaps(aims[mine], points[leaves[j]])
        at += step
        step *= 4
        edge = gap[active, order[active, at]] if at < len(leaves) else np.full(len(active), np.inf)
        ahead = np.flatnonzero(np.isfinite(waiting[active]).any(0))
        near = waiting[np.ix_(active, ahead)]
        limit = within(active, edge)
        if 2 * k < len(ahead):
            limit = np.minimum(limit, np.partition(near, 2 * k - 1, axis=1)[:, 2 * k - 1])
        due = near <= limit[:, None]  # the nearest 2 k rows first
        some = np.flatnonzero(due.any(0))
        verified += verify(active, ahead[some], due[:, some])
        past = near <= within(active, edge)[:, None]
        waiting[np.ix_(active, ahead)] = np.where(past | due, np.inf, near)  # verified now or never: the reach only shrinks
        past &= ~due
        some = np.flatnonzero(past.any(0))
        if len(some):
            ahead, near = ahead[some], np.where(past, near, np.inf)[:, some]
            dense = past[:, some].mean() >= SINGLE
            products = direction[active] @ rows[ahead].T if dense else None
            few = near[:, ::STRIDE]
            for part in PARTS:  # the others by rising distance, while the reach shrinks
                last = part * k // STRIDE if part else few.shape[1]
                limit = within(active, edge)
                if last < few.shape[1]:
                    limit = np.minimum(limit, np.partition(few, last, axis=1)[:, last])
                due = near <= limit[:, None]
                verified += verify(active, ahead, due, products)
                if last >= few.shape[1]:
                    break
                near[due] = np.inf
        active = active[edge <= reach(active)]
    return who, best, verified


def cut_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A kd-tree of ``cells`` (a power of two) leaves as (dimension, median) of its nodes, breadth first."""
    nodes, level = [], [sample]
    while len(level) < cells:
        following = []
        for part in level:
            widest = int(np.argmax(part.max(0) - part.min(0))) if len(part) else 0
            middle = float(np.median(part[:, widest])) if len(part) else 0.0
            nodes.append((widest, middle))
            following += [part[part[:, widest] < middle], part[part[:, widest] >= middle]]
        level = following
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    dims, cuts = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] >= cuts[at])
    return at - len(nodes)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, confidence: float = 0.98, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the rows of ``vectors(vec_id, embedding)`` with the largest inner products.

    ``queries(vec_id, embedding)`` may be of any size. Rows lie in the cells of a kd-tree over a bounded sample of
    projections. A query first searches one block of its own cell; the k-th product found there is a bound with which
    it goes only to those cells that the stopping test leaves open.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    rows = stored(distinct_vectors(usable(vectors.select("vec_id", "embedding").where("vec_id is not null")), k), "search-rows")
    asked = usable(queries.select("vec_id", "embedding").where("vec_id is not null"))
    facts = rows.select(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("m"), F.max(F.size("embedding")).alias("d")).first()
    width = facts["d"] or 0
    asked = stored(asked.where(F.size("embedding") == width), "search-queries")
    top = math.sqrt(facts["m"] or 1.0)
    onto = plane(width)
    blocks = max(1, math.ceil(facts["n"] / block))
    cells = 1 << min(MOST_CELLS, math.ceil(math.log2(blocks)))
    sample = np.zeros((0, PROJECTED))
    if cells > 1:
        share = SAMPLED * cells / facts["n"]  # of all different rows: about SAMPLED * 2 ** MOST_CELLS rows at most
        few = rows.select("embedding").where(F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).toPandas()
        sample = project(np.stack(few["embedding"].to_numpy()), top, onto) if len(few) else sample
    nodes = cut_cells(sample, cells)

    def to_cells(batches):
        for b in batches:
            if len(b):
                p = project(np.stack(b["embedding"].to_numpy()), top, onto)
                yield b.assign(cell=cell_of(p, nodes), low=list(p), high=list(p))

    left = stored(rows.mapInPandas(to_cells, f"embedding array<double>, ids array<{kind}>, counts array<int>, cell bigint, low array<double>, high array<double>"), "search-cells")
    edges = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    boxes = left.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).orderBy("cell").toPandas()  # a row a cell
    names, sizes = boxes["cell"].to_numpy(), np.ceil(boxes["n"].to_numpy() / block).astype(int)
    low, high = (boxes[[f"{c}{i}" for i in range(PROJECTED)]].to_numpy() for c in ("low", "high"))
    bound = chi_square_quantile(confidence, PROJECTED)
    many = F.broadcast(left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))  # at most 2 ** MOST_CELLS rows
    left = left.join(many, "cell").select("ids", "counts", "embedding", "cell", F.pmod(F.xxhash64("embedding"), F.col("parts")).cast("int").alias("part"))

    def route(home: bool):
        def run(batches):
            for b in batches:
                if len(b) and len(names):
                    v = np.stack(b["embedding"].to_numpy())
                    norm = np.linalg.norm(v, axis=1)
                    gap = box_gap((v / norm[:, None]) @ onto[:-1], low, high)
                    if home:
                        yield b.assign(floor=-np.inf, cell=names[gap.argmin(1)], part=0)
                        continue
                    distance = np.maximum(0, 2 - 2 * (b["floor"].to_numpy() / norm) / top)
                    limit = np.where(np.isfinite(distance), bound * distance + ROUNDING, np.inf)
                    q, c = np.nonzero(gap <= limit[:, None])
                    part = np.concatenate([np.arange(0), *(np.arange(n) for n in sizes[c])])
                    q, c = np.repeat(q, sizes[c]), np.repeat(c, sizes[c])
                    yield b.iloc[q].assign(cell=names[c], part=part)
        return run

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            v, w = np.stack(a["embedding"].to_numpy()), np.stack(b["embedding"].to_numpy())
            members, counts, query_ids = a["ids"].to_numpy(), a["counts"].to_numpy(), b["vec_id"].to_numpy()
            first, second = np.array([m[0] for m in members]), np.array([m[min(1, len(m) - 1)] for m in members])
            who, best, _ = search_block(first, second, v, query_ids, w, top, k, confidence, b["floor"].to_numpy())
            q, c = np.nonzero((who >= 0) & np.isfinite(best))
            x = who[q, c]
            hits = pd.DataFrame({"q": q, "query_id": query_ids[q], "vec_id": [np.repeat(members[i], counts[i]) for i in x], "score": (v[x] * w[q]).sum(1)})
            hits = hits.explode("vec_id").astype({"vec_id": first.dtype})
            hits = hits[hits["vec_id"] != hits["query_id"]].sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
            out = hits.groupby("q").head(k)[["query_id", "vec_id", "score"]]
        return pd.DataFrame(out)

    def search(sent: DataFrame) -> DataFrame:
        """Queries of a block are dealt to searches of up to QUERY_BLOCK; a block is copied only if it has more."""
        asks = sent.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("asks"))
        searches = F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERY_BLOCK)).cast("int")
        a = left.join(asks, ["cell", "part"]).withColumn("deal", F.explode(F.sequence(F.lit(0), searches - 1))).drop("asks")
        b = sent.join(asks, ["cell", "part"]).withColumn("deal", F.pmod(F.xxhash64("vec_id", F.lit(1)), searches).cast("int")).drop("asks")
        by = ["cell", "part", "deal"]
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score double")

    schema = f"vec_id {kind}, embedding array<double>, floor double, cell bigint, part int"
    asked = asked.select("vec_id", "embedding")
    if sizes.sum() > 1:
        home = search(stored(asked.mapInPandas(route(True), schema), "search-home"))
        kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        floors = home.withColumn("at", kth).where(F.col("at") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        asked = asked.join(floors, "vec_id", "left")
    else:
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    asked = asked.select("vec_id", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = search(stored(asked.mapInPandas(route(False), schema), "search-routes"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
