"""Nearest rows by inner product: a vantage-point tree in each shard of the vectors.

``build`` cuts the rows into shards of bounded size where they lie and stores one tree a shard. Distances are Euclidean between
augmented vectors (see ``vectors``), so the nearest rows are those with the largest inner products. A node has a vantage point,
and its rows are parted at their median distance from it; both halves keep the interval of these distances. For a query
at distance d of the vantage point a half can't hold a row nearer than the gap between d and its interval; it is
left out where ``factor`` times that gap exceeds the distance of the query's k-th best. Factor 1 is the triangle
inequality itself, so the search is exact; larger ones prune more and may miss rows near a border.

``search`` sends queries to the tasks in blocks of bounded size, each block against all shards. A sixteenth of the rows is scored
first, so a block starts with k-th best distances that prune. Scores are sums in double precision over the original vectors,
component by component from the first on.

Edge cases: vectors that are null, zero or empty, or hold a null or non-finite component, take no part, as query or candidate; nor do
rows with a null id. Of rows that share an id the one with the first vector counts. Shorter vectors count as filled up with zeros.
Equal scores go to the smaller id. With fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import scratch, small_batches, stored
from cadenza.llm.vectors import SEED_SHARE, SLACK, Array, Best, blocks, finite, matrix, one_row_an_id, ranked, seeds

FACTOR = 1.25
LEAF = 256  # rows
SHARD_BYTES = 4 << 20  # of the vectors of a shard, in doubles
START, MID, END, POINT, IN_LO, IN_HI, OUT_LO, OUT_HI, LEFT, RIGHT = range(10)  # columns of a node
SHARD = "ids array<long>, vectors binary, nodes binary"


def augmented(x: Array, big: float) -> Array:
    return np.column_stack([x, np.sqrt(np.maximum(0, big - (x * x).sum(axis=1)))])


def plant(points: Array, leaf: int = LEAF) -> tuple[Array, Array]:
    """(order, nodes) of the tree over ``points``: a node is a range of rows in that order; node 0 is all of them.

    A node's vantage point is its row farthest from its mean. Ranges whose rows are all equally far from it stay whole.
    """
    order, nodes = np.arange(len(points)), []

    def grow(start: int, end: int) -> int:
        me, node = len(nodes), np.full(10, -1.0)
        nodes.append(node)
        node[[START, END]] = start, end
        if end - start <= leaf:
            return me
        own = points[order[start:end]]
        point = order[start + int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())]
        d = np.sqrt(((own - points[point]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        d = d[by]
        cut = np.searchsorted(d, d[len(d) // 2], side="right")
        cut = cut if cut < len(d) else np.searchsorted(d, d[-1])
        if cut == 0:
            return me
        order[start:end] = order[start:end][by]
        node[[MID, POINT, IN_LO, IN_HI, OUT_LO, OUT_HI]] = start + cut, point, d[0], d[cut - 1], d[cut], d[-1]
        node[LEFT] = grow(start, start + cut)
        node[RIGHT] = grow(start + cut, end)
        return me

    grow(0, len(points))
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    out = np.array(nodes)
    inner = out[:, LEFT] >= 0
    out[inner, POINT] = place[out[inner, POINT].astype(np.int64)]
    return order, out


def build(rows: DataFrame, dim: int, big: float, leaf: int = LEAF, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored shards of (vec_id, v): ids and vectors in the order of the shard's tree, and its nodes."""
    small_batches(rows.sparkSession)
    most = max(leaf, shard_bytes // (8 * (dim + 1)))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shard(ids: Array, x: Array) -> pd.DataFrame:
            order, nodes = plant(augmented(x, big), leaf)
            return pd.DataFrame({"ids": [ids[order]], "vectors": [x[order].tobytes()], "nodes": [nodes.tobytes()]})

        held, n = [], 0
        for b in batches:
            held.append((b["vec_id"].to_numpy(np.int64), matrix(b["v"], dim)))
            n += len(b)
            while n >= most:
                ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                yield shard(ids[:most], x[:most])
                held, n = [(ids[most:], x[most:])], n - most
        if n:
            yield shard(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return stored(rows.mapInPandas(task, SHARD), "trees")


def measure(a: Array, b: Array) -> Array:
    """Inner products of the rows of ``a`` with those of ``b``, summed from the first component on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


@dataclass
class Queries:
    ids: Array
    x: Array
    points: Array  # with a zero as the last coordinate
    norms: Array
    big: float

    @classmethod
    def of(cls, ids: Array, x: Array, big: float) -> Queries:
        return cls(ids, x, np.column_stack([x, np.zeros(len(x))]), (x * x).sum(axis=1), big)

    def reach(self, at: Array, best: Best) -> Array:
        """Distance of the k-th best of some queries, rounded up; infinite where there is none yet."""
        base = self.big + self.norms[at]
        return np.sqrt(np.maximum(0, base - 2 * best.least[at]) + SLACK * base)

    def compare(self, at: Array, ids: Array, x: Array, best: Best) -> None:
        """Score some queries with some rows: fast products rule out what is worse, the rest is measured."""
        s = self.x[at] @ x.T
        least = best.least[at]
        none = np.isneginf(least)
        if none.any() and len(ids) > best.k + 1:  # one of them may be the query itself
            least = np.where(none, -np.partition(-s, best.k, axis=1)[:, best.k], least)
        slack = SLACK * np.sqrt(self.norms[at] * self.big)
        a, j = np.nonzero((s >= (least - slack)[:, None]) & (self.ids[at, None] != ids))
        best.add(at[a], ids[j], measure(self.x[at[a]], x[j]))

    def visit(self, tree: Array, ids: Array, x: Array, factor: float, best: Best) -> None:
        """Search one shard; the half on the vantage point's side first."""
        todo = [(0, np.arange(len(self.ids)), np.zeros(len(self.ids)))]
        while todo:
            n, at, gap = todo.pop()
            at = at[factor * gap <= self.reach(at, best)]
            if not len(at):
                continue
            node = tree[n]
            if node[LEFT] < 0:
                here = slice(int(node[START]), int(node[END]))
                self.compare(at, ids[here], x[here], best)
                continue
            v = augmented(x[[int(node[POINT])]], self.big)[0]
            d = np.sqrt(((self.points[at] - v) ** 2).sum(axis=1))
            todo.append((int(node[RIGHT]), at, np.maximum(0, np.maximum(d - node[OUT_HI], node[OUT_LO] - d))))
            todo.append((int(node[LEFT]), at, np.maximum(0, np.maximum(d - node[IN_HI], node[IN_LO] - d))))


def search(vectors: DataFrame, is_query: Column, k: int, factor: float = FACTOR, leaf: int = LEAF, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, from (vec_id, v); all rows are candidates."""
    if factor < 1:
        raise ValueError("factor must be 1 (exact) or more")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0)).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    rows = stored(one_row_an_id(rows, "vec_id"), "vectors")
    top = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("big")).first()
    dim, big = top["dim"] or 0, top["big"] or 0.0
    trees = build(rows, dim, big, leaf, shard_bytes)
    part = rows.where(F.pmod(F.xxhash64(F.lit("seed"), "vec_id"), F.lit(SEED_SHARE)) == 0)
    path, kind = scratch(spark, "nearest"), "query_id long, vec_id long, score double"
    spark.createDataFrame([], kind).write.parquet(path)
    for block in blocks(rows.where(is_query), dim):
        q = Queries.of(block["vec_id"].to_numpy(np.int64), matrix(block["v"], dim), big)

        def first(batches: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            best = Best(len(q.ids), k, np.float64)
            for b in batches:
                for lo in range(0, len(b), leaf):
                    q.compare(np.arange(len(q.ids)), b["vec_id"].to_numpy(np.int64)[lo : lo + leaf], matrix(b["v"].iloc[lo : lo + leaf], dim), best)
            yield pd.DataFrame(dict(zip(("slot", "vec_id", "score"), best.cut(), strict=True)))

        some = ranked(part.mapInPandas(first, "slot long, vec_id long, score double"), ["slot"], k)
        beat = seeds(some.select("slot", "vec_id", "score").toPandas(), len(q.ids), k, np.float64)  # k rows a query of the block

        def task(batches: Iterator[pd.DataFrame], q=q, beat=beat) -> Iterator[pd.DataFrame]:
            best = Best(len(q.ids), k, np.float64, *beat)
            for b in batches:
                for ids, raw, nodes in zip(b["ids"], b["vectors"], b["nodes"], strict=True):
                    q.visit(np.frombuffer(nodes).reshape(-1, 10), np.asarray(ids, np.int64), np.frombuffer(raw).reshape(-1, dim), factor, best)
                    best.cut()
            slot, ids, score = best.cut()
            yield pd.DataFrame({"query_id": q.ids[slot], "vec_id": ids, "score": score})

        trees.mapInPandas(task, kind).write.mode("append").parquet(path)
    return ranked(spark.read.schema(kind).parquet(path), ["query_id"], k).select("query_id", "rank", "vec_id", "score")
