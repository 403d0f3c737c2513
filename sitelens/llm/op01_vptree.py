"""Nearest neighbours by largest inner product: vantage-point trees, one for each shard.

Equal vectors are one node with their smallest ids. In each shard a further coordinate brings every vector to the shard's
largest norm; a query has zero there, so that squared distance = norm² + |q|² − 2 q·x and the nearest vector is that of
largest inner product, under a metric. A tree's node holds a vantage point, the median distance to it and the range of
distances on either side; a side is passed over if ``factor`` × its triangle-inequality bound reaches the distance of the
worst neighbour held. Factor one is exact search; larger factors prune more. How much a factor passes over differs with the
vectors and their norms; so in each cell of queries and shard some queries are compared with all vectors, and the factor
falls from the largest of ``LADDER`` towards one until these find ``RECALL`` of their neighbours.

Every query meets every shard in a cell, a group of queries beside one tree; cells are dealt out over as many tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import stored

LEAF = 128
#: Trees of no more vectors are searched exactly: they are a few leaves, of which pruning saves little.
EXACT = 8 * LEAF
#: So many queries of a cell measure the recall in a shard, and this is what their mean must reach.
PROBES, RECALL = 128, 0.92
#: Factors that are tried, as parts of the way from one to the given one.
LADDER = (1.0, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125, 0.06, 0.03)


class Tree:
    """Nodes in arrays. A leaf covers ``order[lo:hi]``; an inner node's vantage point is also in one of its sides."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.x = vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.norm = float(norms.max()) if len(norms) else 0.0
        self.extra = np.sqrt(np.maximum(self.norm - norms, 0.0))
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # lo, hi, vantage point, left, right, ranges of distances of left and right
        rng = np.random.default_rng(seed)
        self._build(0, len(vectors), rng)
        self.scored = 0  # inner products of the searches so far, those with vantage points included

    def _distance(self, i: np.ndarray, v: int) -> np.ndarray:
        d = self.x[i] - self.x[v]
        return np.sqrt(np.einsum("ij,ij->i", d, d) + (self.extra[i] - self.extra[v]) ** 2)

    def _build(self, lo: int, hi: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1, -1, 0.0, 0.0, 0.0, 0.0))
        own = self.order[lo:hi]
        if hi - lo <= LEAF:
            return at
        # of a few candidates, the vantage point that spreads the others most
        tried = rng.choice(own, min(5, len(own)), replace=False)
        probe = rng.choice(own, min(64, len(own)), replace=False)
        v = max(tried.tolist(), key=lambda c: float(np.var(self._distance(probe, c))))
        d = self._distance(own, v)
        by = np.argsort(d, kind="stable")
        self.order[lo:hi], d = own[by], d[by]
        mid = (hi - lo) // 2
        left = self._build(lo, lo + mid, rng)
        right = self._build(lo + mid, hi, rng)
        self.nodes[at] = (lo, hi, v, left, right, float(d[0]), float(d[mid - 1]), float(d[mid]), float(d[-1]))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query, (positions, inner products) of the vectors found, k at most; −1 fills up."""
        n, wide = len(queries), min(k, len(self.x))
        best = np.full((n, wide), -np.inf)
        place = np.full((n, wide), -1, np.int64)
        if not wide:
            return place, best
        q2 = np.einsum("ij,ij->i", queries, queries)
        first = np.full(n, -1)

        def dots(who: np.ndarray, own: np.ndarray) -> None:
            self.scored += len(who) * len(own)
            score = queries[who] @ self.x[own].T
            both = np.concatenate([best[who], score], 1)
            ids = np.concatenate([place[who], np.broadcast_to(own, score.shape)], 1)
            top = np.argpartition(-both, wide - 1, axis=1)[:, :wide]
            best[who] = np.take_along_axis(both, top, 1)
            place[who] = np.take_along_axis(ids, top, 1)

        def to_vantage(who: np.ndarray, v: int) -> np.ndarray:
            self.scored += len(who)
            return np.sqrt(np.maximum(q2[who] + self.norm - 2 * (queries[who] @ self.x[v]), 0.0))

        def descend(at: int, who: np.ndarray) -> None:
            lo, hi, v, left, right, _, near, far, _ = self.nodes[at]
            if v < 0:
                first[who] = at
                dots(who, self.order[lo:hi])
                return
            inside = to_vantage(who, v) <= (near + far) / 2
            for side, own in ((left, who[inside]), (right, who[~inside])):
                if len(own):
                    descend(side, own)

        def visit(at: int, who: np.ndarray) -> None:
            lo, hi, v, left, right, *bounds = self.nodes[at]
            if v < 0:
                who = who[first[who] != at]
                if len(who):
                    dots(who, self.order[lo:hi])
                return
            d = to_vantage(who, v)
            sides = [(left, bounds[0], bounds[1]), (right, bounds[2], bounds[3])]
            if np.median(d) > (bounds[1] + bounds[2]) / 2:
                sides.reverse()
            for side, low, high in sides:
                worst = best[who].min(1)
                reach = np.sqrt(np.maximum(q2[who] + self.norm - 2 * worst, 0.0))  # inf while fewer than k are held
                bound = np.maximum(np.maximum(d - high, low - d), 0.0)
                # a hair of slack keeps ties at the border, whatever the rounding
                on = bound * factor <= reach * (1 + 1e-9) + 1e-9
                if on.any():
                    visit(side, who[on])

        descend(0, np.arange(n))
        visit(0, np.arange(n))
        return place, best

    def fitting(self, queries: np.ndarray, k: int, held: int, factor: float) -> float:
        """The first of some factors from ``factor`` down to one by which probed queries, holding ``held``, find ``RECALL`` of their ``k`` nearest."""
        wide = min(k, len(self.x))
        if factor <= 1 or not wide or not len(queries):
            return factor
        if len(self.x) <= EXACT:
            return 1.0
        some = queries[np.unique(np.linspace(0, len(queries) - 1, PROBES).astype(int))]
        least = np.partition(some @ self.x.T, -wide, axis=1)[:, -wide, None]
        hair = 1e-12 * np.sqrt(self.norm * np.einsum("ij,ij->i", some, some))[:, None]
        for share in LADDER:
            now = 1 + (factor - 1) * share
            _, best = self.search(some, held, now)
            if np.minimum((best >= least - hair).sum(1), wide).mean() >= RECALL * wide:
                return now
        return 1.0


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(batch: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(batch["embedding"].tolist(), np.float64)
    tree = Tree(vectors)
    ids = [np.sort(np.asarray(x, np.int64)) for x in batch["ids"]]
    data = _pack(x=vectors, order=tree.order, nodes=np.array(tree.nodes, np.float64), extra=tree.extra, norm=np.array(tree.norm), ids=np.concatenate(ids), ends=np.cumsum([len(x) for x in ids]))
    return pd.DataFrame({"dim": [np.int32(vectors.shape[1])], "shard": [np.int64(batch["shard"].iloc[0])], "tree": [data]})


def _load(data: bytes) -> tuple[Tree, np.ndarray, np.ndarray]:
    held = np.load(io.BytesIO(data))
    tree = Tree.__new__(Tree)
    tree.x, tree.order, tree.norm, tree.extra, tree.scored = held["x"], held["order"], float(held["norm"]), held["extra"], 0
    tree.nodes = [(int(a), int(b), int(v), int(l), int(r), *rest) for a, b, v, l, r, *rest in held["nodes"].tolist()]
    return tree, held["ids"], held["ends"]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.add.accumulate(q[None, :] * x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


FOUND = "query_id long, vec_id long, score double, shard long, scored long"


def _search(k: int, factor: float, slack: int, block: int):
    def run(cell: pa.Table) -> pa.Table:
        """A cell is one row: a tree and a group of queries."""
        tree, ids, ends = _load(cell.column("tree")[0].as_py())
        names = np.array(cell.column("query_ids")[0].as_py(), np.int64)
        queries = np.array(cell.column("queries")[0].as_py(), np.float64).reshape(len(names), -1)
        fit = tree.fitting(queries, k, k + slack, factor)
        out: list[tuple] = []
        for lo in range(0, len(names), block):
            before = tree.scored
            found, _ = tree.search(queries[lo : lo + block], k + slack, fit)
            each = (tree.scored - before) // len(found)
            for name, q, at in zip(names[lo : lo + block].tolist(), queries[lo : lo + block], found, strict=True):
                at = at[at >= 0]
                score = _scores(q, tree.x[at])
                pairs = sorted((-s, i) for s, p in zip(score.tolist(), at.tolist(), strict=True) for i in ids[(ends[p - 1] if p else 0) : ends[p]].tolist() if i != name)
                out += [(name, i, -s, each) for s, i in pairs[:k]]
        query_id, vec_id, score, scored = zip(*out, strict=True) if out else ((), (), (), ())
        shard = pa.array([cell.column("shard")[0].as_py()] * len(out), pa.int64())
        return pa.Table.from_arrays([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64()), shard, pa.array(scored, pa.int64())], ["query_id", "vec_id", "score", "shard", "scored"])

    return run


def _valid(vectors: DataFrame) -> DataFrame:
    """Ids and vectors as doubles, without vectors that are null, empty or zero or hold what is null or not finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(fit)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 9.0, shard_rows: int = 8192, block: int = 256, slack: int = 8, group_rows: int = 8192, counters: bool = False) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each of ``queries`` (both ``vec_id``, ``embedding``), found through the trees.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; equal scores by smaller vec_id; a query's own id is no
    neighbour of it. Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows
    without an id; vectors of other lengths than the query's are no candidates; rows that repeat an id and vector count
    once. Fewer candidates than ``k`` are all returned; empty tables give an empty result; other columns are ignored.
    ``slack``: as many more than k are held on the way, for scores that rounding made equal. ``factor`` is the most that a
    shard prunes by; it takes less where probed queries don't reach ``RECALL``. ``counters`` adds ``shard`` and ``scored``,
    the inner products that a query took in the shard on average.
    """
    own = _valid(vectors).groupBy("vec_id", "embedding").agg(F.lit(1)).select("vec_id", "embedding")
    # of equal vectors the k+1 smallest ids suffice: one may be the query's own
    few = own.withColumn("n", F.expr("row_number() over (partition by embedding order by vec_id)")).where(F.col("n") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.collect_set("vec_id").alias("ids"))
    nodes, _ = stored(nodes.withColumn("dim", F.size("embedding")), "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))
    trees, _ = stored(sharded.repartition(min(4 * shards, 20_000), "shard", "dim").groupBy("shard", "dim").applyInPandas(lambda batch: _build(batch), "dim int, shard long, tree binary"), "trees")

    asked = _valid(queries).groupBy("vec_id", "embedding").agg(F.lit(1)).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    asked, _ = stored(asked, "queries")
    # groups as large as a tree at most, and small enough that there are cells for every core
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = asked.count()
    groups = max(1, -(-n // group_rows), min(-(-n // block), -(-2 * cores // shards)))
    grouped = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).groupBy("group", "dim").agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("embedding")).alias("queries"))
    tasks = min(4 * shards * groups, 100_000)
    cell = F.col("shard") * groups + F.col("group")
    left = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("dim", "shard", "tree", cell.alias("cell")).repartition(tasks, "cell")
    right = grouped.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(F.col("dim").alias("of"), "query_ids", "queries", cell.alias("cell")).repartition(tasks, "cell")
    pairs = left.join(right.hint("shuffle_hash"), "cell").where("dim = of")
    found = pairs.groupBy("cell", "dim").applyInArrow(_search(k, factor, slack, block), FOUND)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *(["shard", "scored"] if counters else []))
