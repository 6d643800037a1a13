"""Hard negatives by a pivot table: stored distances to a few pivots bracket every score, survivors are scored exactly.

Vectors are augmented (see ``vectors``), so that a score is a Euclidean distance. Each row's distances to all pivots are
stored, rows sorted by their nearest pivot within the partition they are in (nothing is shuffled for that). A page of such
rows has an interval of distances to each pivot; with an anchor's own distances the triangle inequality gives a bracket
of scores for the whole page, and pages whose bracket can't reach what an anchor still seeks are left out for it. All rows
of the other pages are scored exactly, in integers.

Anchors are sent to the tasks in blocks of bounded size, each block against the whole table. A sixteenth of the rows is
scored first: its k-th best are scores that the final ones have to beat, so a task returns few rows however many there are.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that share an id
the first by label, then by vector, counts. Shorter vectors count as filled up with zeros. Equal scores go to the smaller id.
Anchors without positives, and positives without negatives, return nothing. Components have to be whole numbers; scores beyond
the range of a long end at its ends. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import scratch, small_batches, stored
from cadenza.llm.vectors import SEED_SHARE, SLACK, Array, Best, blocks, far_apart, finite, matrix, one_row_an_id, ranked, seeds

PIVOTS = 16
SAMPLE = 1024  # rows that pivots are chosen from, by a hash of the id
PAGE = 256
EXACT = float(1 << 53)  # below this all sums of whole numbers are exact in doubles
LONG = np.iinfo(np.int64)


@dataclass
class Space:
    """What all tasks know: the width of vectors, the largest squared norm, and the pivots with their last coordinate."""

    dim: int
    big: float
    pivots: Array

    @property
    def plain(self) -> bool:
        """Whether scores fit the whole numbers of doubles; if not, they are computed in Python's integers, without brackets."""
        return self.big < EXACT

    def augmented(self, x: Array) -> Array:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.big - (x * x).sum(axis=1)))])

    def to_pivots(self, points: Array) -> Array:
        """Distances of augmented points to all pivots."""
        sq = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, sq))

    def scores(self, q: Array, x: Array) -> Array:
        if self.plain:
            return (q @ x.T).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        exact = whole(q).dot(whole(x).T) if q.size and x.size else np.zeros((len(q), len(x)), object)
        return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


@dataclass
class Anchors:
    """A block of anchors; the last coordinate of an anchor is zero."""

    ids: Array
    labels: Array
    x: Array
    norms: Array
    away: Array  # distances to the pivots

    @classmethod
    def of(cls, frame: pd.DataFrame, space: Space) -> Anchors:
        x = matrix(frame["v"], space.dim)
        away = space.to_pivots(np.column_stack([x, np.zeros(len(x))])) if space.plain else np.zeros((len(x), 0))
        return cls(frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), x, (x * x).sum(axis=1), away)


@dataclass
class Page:
    ids: Array
    labels: Array
    x: Array
    least: Array  # of the distances to each pivot
    most: Array


def bracket(away: Array, norms: Array, page: Page, big: float) -> tuple[Array, Array]:
    """Bounds of the scores of each anchor with any row of the page.

    A row at a distance in [least, most] of a pivot is at least the gap between that and the anchor's own distance away
    from the anchor, and at most their sum; the best pivot counts.
    """
    gap = np.maximum(0, np.maximum(away - page.most, page.least - away)).max(axis=1)
    far = (away + page.most).min(axis=1)
    base = big + norms
    return (base - far**2) / 2 - SLACK * base, (base - gap**2) / 2 + SLACK * base


def pages(batches: Iterator[pd.DataFrame], space: Space) -> Iterator[Page]:
    for b in batches:
        x = matrix(b["v"], space.dim)
        d = np.stack(list(b["d"])) if space.plain and len(b) else np.zeros((len(b), 0))
        for lo in range(0, len(b), PAGE):
            at = slice(lo, lo + PAGE)
            yield Page(b["vec_id"].to_numpy(np.int64)[at], b["label"].to_numpy(np.int64)[at], x[at], d[at].min(axis=0), d[at].max(axis=0))


def pivot_table(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, Space]:
    """(vec_id, label, v, d): the stored rows with their distances ``d`` to all pivots, in the order of the nearest one.

    Pivots are chosen far apart among ``sample`` rows, by a hash of the id; every row is in the table.
    """
    small_batches(rows.sparkSession)
    rows = stored(rows, "rows")
    top = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("big")).first()
    space = Space(top["dim"] or 0, top["big"] or 0.0, np.zeros((0, (top["dim"] or 0) + 1)))
    if not space.plain:
        return rows.withColumn("d", F.array().cast("array<double>")), space
    some = rows.orderBy(F.xxhash64(F.lit("pivots"), "vec_id"), "vec_id").limit(sample).select("v").toPandas()
    points = space.augmented(matrix(some["v"], space.dim))
    space.pivots = points[far_apart(points, pivots)]

    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        return pd.Series(list(space.to_pivots(space.augmented(matrix(v, space.dim)))))

    near = F.struct(F.array_position("d", F.array_min("d")), F.array_min("d"))
    return stored(rows.withColumn("d", distances("v")).sortWithinPartitions(near), "pivots"), space


Find = Callable[[Page, Best], None]


def scan(table: DataFrame, space: Space, slots: int, k: int, find: Find, least: Array | None = None, last: Array | None = None) -> DataFrame:
    """(slot, vec_id, score): each task's ``k`` best of every slot, as ``find`` adds them page by page."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(slots, k, np.int64, least, last)
        for page in pages(batches, space):
            find(page, best)
        yield pd.DataFrame(dict(zip(("slot", "vec_id", "score"), best.cut(), strict=True)))

    return table.mapInPandas(task, "slot long, vec_id long, score long")


def best_of(table: DataFrame, space: Space, slots: int, k: int, find: Find) -> DataFrame:
    """``scan`` of the whole table, after one of a part of it that gives the scores to beat."""
    part = table.where(F.pmod(F.xxhash64(F.lit("seed"), "vec_id"), F.lit(SEED_SHARE)) == 0)
    first = ranked(scan(part, space, slots, k, find), ["slot"], k).select("slot", "vec_id", "score").toPandas()  # slots of one block
    return scan(table, space, slots, k, find, *seeds(first, slots, k, np.int64))


def same_label(anchors: Anchors, space: Space) -> Find:
    """Other rows with the anchor's label; a slot for each anchor."""

    def find(page: Page, best: Best) -> None:
        want = np.isin(anchors.labels, page.labels)
        if space.plain:
            want &= bracket(anchors.away, anchors.norms, page, space.big)[1] >= best.least
        at = np.flatnonzero(want)
        s = space.scores(anchors.x[at], page.x)
        a, j = np.nonzero((s >= best.least[at, None]) & (anchors.labels[at, None] == page.labels) & (anchors.ids[at, None] != page.ids))
        best.add(at[a], page.ids[j], s[a, j])

    return find


def other_labels(anchors: Anchors, space: Space, first: Array, low: Array, high: Array) -> Find:
    """Rows of other labels with a score in [low, high] of a slot; the slots of anchor a are first[a] to first[a + 1]."""
    some = np.flatnonzero(np.diff(first))
    top = np.maximum.reduceat(high, first[some]) if len(some) else high

    def find(page: Page, best: Best) -> None:
        if not len(some):
            return
        need = np.minimum.reduceat(np.maximum(low, best.least), first[some])
        want = need <= top
        if space.plain:
            lo, hi = bracket(anchors.away[some], anchors.norms[some], page, space.big)
            want &= (hi >= need) & (lo <= top)
        at = some[want]
        s = space.scores(anchors.x[at], page.x)
        a, j = np.nonzero((s >= need[want, None]) & (s <= top[want, None]) & (anchors.labels[at, None] != page.labels))
        score, ids, begin = s[a, j], page.ids[j], first[at[a]]
        for i in range(int(np.diff(first).max())):
            slot = np.minimum(begin + i, first[at[a] + 1] - 1)
            fits = (begin + i == slot) & (score >= low[slot]) & (score <= high[slot])
            best.add(slot[fits], ids[fits], score[fits])

    return find


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, v).

    A score is the inner product. Positives of an anchor are its best ``positives`` rows of the same label; negatives
    of both are the best ``negatives`` of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    spark = rows.sparkSession
    rows = one_row_an_id(rows.where(F.col("label").isNotNull() & finite(F.col("v"))).select("vec_id", F.col("label").cast("long").alias("label"), "v"), "vec_id")
    table, space = pivot_table(rows)
    kind = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    path = scratch(spark, "negatives")
    spark.createDataFrame([], kind).write.parquet(path)
    for block in blocks(table.where(is_anchor).select("vec_id", "label", "v"), space.dim):
        anchors = Anchors.of(block, space)
        near = best_of(table, space, len(block), positives, same_label(anchors, space))
        pairs = ranked(near, ["slot"], positives).toPandas().sort_values(["slot", "rank"])  # a few for each anchor of the block
        slots, pos, ps = (pairs[c].to_numpy(np.int64) for c in ("slot", "vec_id", "score"))
        first = np.searchsorted(slots, np.arange(len(block) + 1))
        clip = lambda v: min(max(v, LONG.min), LONG.max)
        least = np.array([clip(-(-low * int(p) // 100)) for p in ps], np.int64)
        most = np.array([clip(high * int(p) // 100) for p in ps], np.int64)
        found = best_of(table, space, len(pairs), negatives, other_labels(anchors, space, first, least, most))
        send = anchors.ids[slots], pos, ps

        def named(batches: Iterator[pd.DataFrame], send=send) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = b["slot"].to_numpy(np.int64)
                yield pd.DataFrame({"anchor_id": send[0][at], "positive_id": send[1][at], "positive_score": send[2][at], "vec_id": b["vec_id"], "score": b["score"]})

        found.mapInPandas(named, kind).write.mode("append").parquet(path)
    out = ranked(spark.read.schema(kind).parquet(path), ["anchor_id", "positive_id"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
