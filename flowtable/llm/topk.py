"""Exact top-k by inner product: ball trees, branch and bound.

Vectors become integers, floor(scale * x). Rows are cut into shards; each shard is a ball tree, built
once and stored as one row. Queries are cut into blocks. A group of shards meets each block in one
cell, which walks the trees with one running list per query, so that the kth score found in one tree
prunes the next. A node is skipped for a query when centre . q + radius * |q| is below its kth
score, or equal to it while the node holds no smaller id than the kth.

Lists of a (block, group) are at most k long; the last step merges them. Scores are exact: 64-bit
floats where all sums stay below 2**53, else Python integers. Null vectors, or those holding null or
non-finite components, take no part; missing components of shorter vectors count as 0. Fewer than k
candidates: all of them. Repeated ids are distinct candidates, but never a query's own id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtable.llm.common import stored

LEAF, SHARD, BLOCK, GROUP = 64, 4096, 1024, 2
EXACT = float(1 << 53)


def matrix(vectors: list[list[float]], scale: float) -> np.ndarray:
    """Rows of floor(scale * x), padded with 0; floats where inner products stay exact, else integers."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * scale)
    if np.abs(out).max(initial=0) > 2.0**26:
        return np.array([[int(x) for x in row] for row in out.tolist()], dtype=object).reshape(out.shape)
    return out


class BallTree:
    """Nodes in preorder: centre, radius, smallest id, rows [first, last), and the two children (or -1)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.exact = rows.dtype != object
        near = rows if self.exact else rows.astype(float)
        order, nodes = np.arange(len(ids)), []

        def grow(a: int, b: int) -> int:
            part = near[order[a:b]]
            centre = part.mean(0)
            far = ((part - centre) ** 2).sum(1)
            node, radius = len(nodes), float(np.sqrt(far.max()))
            nodes.append([centre, radius * (1 + 1e-9) + 1e-6, int(ids[order[a:b]].min()), a, b, -1, -1])
            if b - a > LEAF and radius > 0:  # equal points stay together
                one = part[far.argmax()]
                other = part[((part - one) ** 2).sum(1).argmax()]
                side = part @ (other - one)
                at = np.argsort(side, kind="stable")
                order[a:b] = order[a:b][at]
                middle = (a + b) // 2
                nodes[node][5], nodes[node][6] = grow(a, middle), grow(middle, b)
            return node

        if len(ids):
            grow(0, len(ids))
        self.ids, self.rows = ids[order], rows[order].astype("i4") if self.exact else rows[order]
        self.centre = np.array([n[0] for n in nodes]).reshape(len(nodes), near.shape[1])
        self.radius, self.least = np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes], "i8")
        self.spans = [tuple(n[3:]) for n in nodes]

    def search(self, own: np.ndarray, queries: np.ndarray, best: "Best") -> None:
        if not len(self.ids) or not len(own):
            return
        width = max(self.rows.shape[1], queries.shape[1])
        rows, q, centre = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.rows, queries, self.centre))
        rows = rows.astype(float) if self.exact else rows
        near = q.astype(float)
        size = np.sqrt((near**2).sum(1))
        bounds = near @ centre.T + size[:, None] * self.radius  # every node's best possible score
        bounds += np.abs(bounds) * 1e-9 + 1e-6
        exact = self.exact and q.dtype != object and width * float(np.abs(rows).max(initial=0)) * float(np.abs(near).max(initial=0)) < EXACT

        def score(at: np.ndarray, a: int, b: int) -> np.ndarray:
            if exact:
                return q[at] @ rows[a:b].T
            wide = np.vectorize(int, otypes=[object])
            return wide(q[at]).dot(wide(rows[a:b]).T) if len(at) else np.zeros((0, b - a))

        stack = [(0, np.arange(len(own)))]
        while stack:
            node, at = stack.pop()
            at = at[best.open(at, bounds[at, node], self.least[node])]
            if not len(at):
                continue
            a, b, left, right = self.spans[node]
            if left < 0:
                for lo in range(a, b, 4096):  # a leaf of equal points can be long
                    hi = min(lo + 4096, b)
                    best.add(at, score(at, lo, hi), self.ids[lo:hi], own)
                continue
            # The child with the higher bound for most of the queries goes first.
            first, second = (left, right) if (bounds[at, left] >= bounds[at, right]).mean() >= 0.5 else (right, left)
            stack += [(second, at), (first, at)]


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.lists: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), sorted
        self.kth, self.kth_id = np.full(n, -np.inf), np.full(n, np.iinfo("i8").max)

    def open(self, at: np.ndarray, bound: np.ndarray, least: int) -> np.ndarray:
        kth = self.kth[at]
        # Bounds carry a margin, so an equal score shows as bound >= kth.
        return (bound >= kth) & ((bound >= kth + 1) | (least < self.kth_id[at]))

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        for i, row in zip(at, scores, strict=True):
            kth = self.kth[i]
            if len(self.lists[i]) < self.k:
                ok = np.ones(len(row), bool)
            elif row.dtype == object:  # beyond 53 bits kth is rounded; the merge below is exact
                ok = row >= kth - abs(kth) * 1e-12
            else:
                ok = (row > kth) | ((row == kth) & (ids < self.kth_id[i]))
            hits = np.flatnonzero(ok.astype(bool) & (ids != own[i]))
            if not len(hits):
                continue
            if len(hits) > self.k and row.dtype != object:
                hits = hits[np.lexsort((ids[hits], -row[hits]))[: self.k]]
            self.lists[i] = merged = sorted(self.lists[i] + [(-int(row[j]), int(ids[j])) for j in hits])[: self.k]
            if len(merged) == self.k:
                self.kth[i], self.kth_id[i] = -merged[-1][0], merged[-1][1]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, key: str = "vec_id", column: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which `is_query` holds, against all other rows."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), is_query.alias("asks")
    ).where(usable & F.col("id").isNotNull())
    total, asking = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, -(-total // shard)), max(1, -(-asking // block))
    groups = max(1, -(-shards // GROUP))

    def packs(make, size: int, name: str):
        """The rows of a partition, in packs of `size` as they come."""
        schema = pa.schema([(name, pa.binary())])

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []

            def out(some: list) -> pa.RecordBatch:
                made = make(np.array([i for i, _ in some], "i8"), matrix([v for _, v in some], scale))
                return pa.record_batch([pa.array([pickle.dumps(made, protocol=5)], pa.binary())], schema=schema)

            for frame in frames:
                held += zip(frame.column("id").to_pylist(), frame.column("v").to_pylist(), strict=True)
                while len(held) >= size:
                    yield out(held[:size])
                    held = held[size:]
            if held:
                yield out(held)

        return run

    # Dealt by a hash of id and vector, so neither the order nor a common vector matters.
    deal = F.xxhash64("id", "v")
    trees = stored(rows.repartition(shards, deal).select("id", "v").mapInArrow(packs(BallTree, shard, "tree"), "tree binary"), "ball-trees")
    asked = rows.where("asks").repartition(blocks, deal).select("id", "v")
    asked = stored(asked.mapInArrow(packs(lambda i, m: (i, m), block, "queries"), "queries binary"), "query-blocks")
    # A cell: one block of queries, one group of trees; both of bounded size.
    left = trees.select("tree", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = asked.select("queries", F.pmod(F.xxhash64("queries"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def walk(_key, some_trees: pd.DataFrame, some_queries: pd.DataFrame) -> pd.DataFrame:
        flat: list[tuple[int, int, int]] = []
        for raw in some_queries["queries"]:
            own, queries = pickle.loads(raw)
            best = Best(len(own), k)
            for tree in some_trees["tree"]:
                pickle.loads(tree).search(own, queries, best)
            flat += [(int(i), x, -score) for i, found in zip(own, best.lists, strict=True) for score, x in found]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(walk, "query_id long, vec_id long, score long")
    return _merge(found, k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
