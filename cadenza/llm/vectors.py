"""Vector tables for searches by inner product: clean rows, queries in blocks, the best of each query, augmented distances.

Augmentation turns inner products into Euclidean distances. With M the largest squared norm, a row x gets one more
coordinate, sqrt(M - |x|^2), and a query q gets a zero: the squared distance is then M + |q|^2 - 2 <x, q>, so the nearest
rows are those with the largest inner products, and triangle inequalities over distances bound scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stored

Array = np.ndarray
BLOCK_BYTES = 8 << 20  # of the queries that are sent to all tasks at a time
SEED_SHARE = 16  # one row in so many is scored first, for the scores that a query's best have to beat
HELD = 400_000  # candidates that a task gathers before it cuts them to the best of each slot
SLACK = 1e-9  # of squared distances, for rounding


def finite(vec: Column) -> Column:
    """True for vectors that are not null and have no null, NaN or infinite component."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~odd


def one_row_an_id(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without null ids; of rows that share an id the first in the order of the other columns.

    Only ids are shuffled to find repeated ones, and only the rows of these are grouped.
    """
    rows = rows.where(F.col(key).isNotNull())
    twice = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_cz_n")).where("_cz_n > 1").select(key), "twice")
    if twice.isEmpty():
        return rows
    rest = [c for c in rows.columns if c != key]
    one = rows.join(twice, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("_cz_r")).select(key, "_cz_r.*")
    return rows.join(twice, key, "left_anti").unionByName(one.select(*rows.columns))


def matrix(vectors: pd.Series, dim: int) -> Array:
    """The vectors as rows of doubles; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def blocks(queries: DataFrame, dim: int) -> Iterator[pd.DataFrame]:
    """The rows of ``queries`` in pieces of about BLOCK_BYTES, which is all that the driver and each task hold of them."""
    n = queries.count()
    parts = max(1, -(-n * 8 * (dim + 1) // BLOCK_BYTES))
    for b in range(parts if n else 0):
        piece = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b).toPandas()
        if len(piece):
            yield piece.sort_values("vec_id", ignore_index=True)


class Best:
    """The ``k`` best (score, id) of each slot: largest scores, then smallest ids. Gathers candidates and cuts them in turn.

    ``least`` and ``last`` are the score and id of each slot's k-th best so far: what is worse can be left out.
    """

    def __init__(self, slots: int, k: int, kind: type, least: Array | None = None, last: Array | None = None):
        self.k, self.kind = k, kind
        lowest = np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf
        self.least = np.full(slots, lowest, kind) if least is None else least.copy()
        self.last = np.full(slots, np.iinfo(np.int64).max) if last is None else last.copy()
        self.parts: list[tuple[Array, Array, Array]] = []
        self.held = 0

    def add(self, slot: Array, ids: Array, score: Array) -> None:
        good = (score > self.least[slot]) | ((score == self.least[slot]) & (ids <= self.last[slot]))
        if good.any():
            self.parts.append((slot[good], ids[good], score[good]))
            self.held += int(good.sum())
            if self.held > HELD:
                self.cut()

    def cut(self) -> tuple[Array, Array, Array]:
        """(slot, id, score) of the best so far, in the order of slots and ranks."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind))
        slot, ids, score = (np.concatenate(x) for x in zip(none, *self.parts, strict=True))
        down = ~score if np.issubdtype(self.kind, np.integer) else -score
        order = np.lexsort((ids, down, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        slot, ids, score, rank = slot[keep], ids[keep], score[keep], rank[keep]
        full = rank == self.k - 1
        self.least[slot[full]], self.last[slot[full]] = score[full], ids[full]
        self.parts, self.held = [(slot, ids, score)], len(slot)
        return slot, ids, score


def seeds(found: pd.DataFrame, slots: int, k: int, kind: type) -> tuple[Array, Array]:
    """Score and id of the k-th best of each slot among ``found`` (slot, vec_id, score); nothing to beat where there are fewer."""
    best = Best(slots, k, kind)
    best.add(found["slot"].to_numpy(np.int64), found["vec_id"].to_numpy(np.int64), found["score"].to_numpy(kind))
    best.cut()
    return best.least, best.last


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``found`` with ``rank`` from 1 by score, then vec_id, within ``keys``; the first ``k`` of each."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def far_apart(points: Array, n: int) -> Array:
    """Indexes of ``n`` rows of ``points``, each the farthest from those before; the first is the farthest from the mean."""
    near = ((points - points.mean(axis=0)) ** 2).sum(axis=1) if len(points) else np.zeros(0)
    chosen: list[int] = []
    for _ in range(min(n, len(points))):
        at = int(near.argmax())
        d = ((points - points[at]) ** 2).sum(axis=1)
        near = np.minimum(near, d) if chosen else d
        chosen.append(at)
        if near.max() <= 0:
            break
    return np.array(chosen, np.int64)
