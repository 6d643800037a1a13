"""Distributed first to fourth moments of array columns, and what follows from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.runs import alike

Array = np.ndarray

HELD = 64 << 20  # bytes of sums that a task holds before it sends them on
STACKED = 1 << 20  # entries of the matrices that kernels take together
NARROW, SHORT = 24, 64  # width, and rows a key, up to which the sums of many keys are added at once
PARTS = "n long, s array<double>, g array<double>, q array<double>, c array<double>"
SUMS = ["n", "s", "g", "q", "c"]

Kernel = Callable[["Moments"], list[tuple]]


def edges_of(dims: list[int] | int, width: int) -> Array:
    """Block edges of arrays of ``width`` values; a number stands for equal blocks of that width."""
    return np.arange(0, width + 1, dims) if isinstance(dims, int) else np.cumsum([0, *dims])


def head_of(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def sums_of(x: Array, dims: list[int] | int) -> list:
    """Count, sum z, the upper triangle of sum z z', and per block sums of |z|^4 and |z|^2, and of |z|^2 z."""
    edges = edges_of(dims, x.shape[1])
    q = np.stack([(x[:, i:j] ** 2).sum(axis=1) for i, j in pairwise(edges)], axis=1)
    cross = [(x[:, i:j] * q[:, m : m + 1]).sum(axis=0) for m, (i, j) in enumerate(pairwise(edges))]
    return [len(x), x.sum(axis=0), (x.T @ x)[np.triu_indices(x.shape[1])], np.concatenate([(q**2).sum(axis=0), q.sum(axis=0)]), np.concatenate(cross)]


def key_rows(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple]:
    """The keys of each row as tuples, nulls as None."""
    return zip(*[[None if v is None or v != v else v for v in frame[k]] for k in keys], strict=True)


def sums_by_group(x: Array, dims: list[int] | int, starts: Array) -> Array:
    """``sums_of`` in one row for each run of rows that begins at ``starts``: all runs at once where they are short and narrow."""
    if x.shape[1] > NARROW or len(x) > SHORT * len(starts):
        return np.stack([np.concatenate(list(map(np.atleast_1d, sums_of(part, dims)))) for part in np.split(x, starts[1:])])
    edges = edges_of(dims, x.shape[1])
    q = np.stack([(x[:, i:j] ** 2).sum(axis=1) for i, j in pairwise(edges)], axis=1)
    upper, lower = np.triu_indices(x.shape[1])
    cross = [x[:, i:j] * q[:, m : m + 1] for m, (i, j) in enumerate(pairwise(edges))]
    return np.add.reduceat(np.hstack([np.ones((len(x), 1)), x, x[:, upper] * x[:, lower], q**2, q, *cross]), starts, axis=0)


def frame_of(heads: list[tuple], rows: list[Array], keys: list[str], sizes: list[int]) -> pd.DataFrame:
    """Rows of sums as a frame; ``sizes`` are the widths of its columns."""
    parts = np.split(np.stack(rows), np.cumsum(sizes)[:-1], axis=1)
    head = pd.DataFrame(heads, columns=keys) if keys else pd.DataFrame(index=range(len(rows)))
    return head.assign(**{c: p[:, 0].astype(np.int64) if c == "n" else list(p) for c, p in zip(SUMS, parts, strict=True)})


def sizes_of(dims: list[int] | int, width: int) -> list[int]:
    return [1, width, width * (width + 1) // 2, 2 * (len(edges_of(dims, width)) - 1), width]


def partial_moments(df: DataFrame, keys: list[str], z: str, dims: list[int] | int) -> DataFrame:
    """(keys, n, s, g, q, c): per task and key, the sums that ``sums_of`` names.

    Tasks add their rows up, so a key with any number of samples sends one row per task, or one for each ``HELD`` bytes of
    sums where a task meets many keys.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Array] = {}
        size = 0
        for b in batches:
            values = b[z].to_numpy()
            code = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(b), np.int64)
            for same in alike(np.array([len(v) for v in values])):  # a width each
                same = same[np.argsort(code[same], kind="stable")]
                starts = np.flatnonzero(np.diff(code[same], prepend=-1))
                rows = sums_by_group(np.stack(values[same]).astype(float), dims, starts)
                for k, new in zip(key_rows(b.iloc[same[starts]], keys) if keys else [()], rows, strict=True):
                    old = held.get(k)
                    size += 0 if old is not None else new.nbytes
                    held[k] = new if old is None else old + new
            if size > HELD:
                yield from frames(held)
                held, size = {}, 0
        yield from frames(held)

    def frames(held: dict) -> Iterator[pd.DataFrame]:
        heads, rows = list(held), list(held.values())
        for same in alike(np.array([len(r) for r in rows])):
            width = int(values_in(len(rows[same[0]]), dims))
            yield frame_of([heads[i] for i in same], [rows[i] for i in same], keys, sizes_of(dims, width))

    return df.select(*keys, z).mapInPandas(task, f"{head_of(df, keys)}, {PARTS}")


def values_in(length: int, dims: list[int] | int) -> int:
    """The width whose sums are so many numbers."""
    width = 1 if isinstance(dims, int) else sum(dims)
    while sum(sizes_of(dims, width)) < length:
        width += 1
    return width


def summed(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[tuple[tuple, list]]]:
    """(key, sums) for each run of rows with one key, in lists of about a batch."""
    now, total = None, None
    for b in batches:
        done = []
        code = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(b), np.int64)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        columns = [b[c].to_numpy() for c in SUMS]
        for k, i, j in zip(key_rows(b.iloc[first], keys) if keys else [()] * len(first), first, [*first[1:], len(b)], strict=True):
            parts = [c[i] if j == i + 1 else sum(c[i + 1 : j], c[i]) for c in columns]
            if total is not None and k == now:
                total = [x + y for x, y in zip(total, parts, strict=True)]
            else:
                if total is not None:
                    done.append((now, total))
                now, total = k, parts
        yield done
    if total is not None:
        yield [(now, total)]


def by_key(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one key side by side in one of a fixed number of partitions.

    The number is stated, as sums are few bytes: merging partitions by size would run all kernels in one task.
    """
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, *keys).sortWithinPartitions(*keys)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row of sums for each key."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for done in summed(batches, keys):
            if done:
                yield pd.DataFrame([(*k, *v) for k, v in done], columns=[*keys, *SUMS])

    return by_key(parts.select(*keys, *SUMS), keys).mapInPandas(task, f"{head_of(parts, keys)}, {PARTS}")


class Moments:
    """What the sums of one key give: count, mean, Gram and covariance matrices, centred fourth moments of each block."""

    def __init__(self, sums: list, dims: list[int] | int):
        n, s, g, q, c = sums
        self.n, self.s = float(n), np.asarray(s)
        width = len(self.s)
        self.gram = np.zeros((width, width))
        self.gram[np.triu_indices(width)] = g
        self.gram += np.triu(self.gram, 1).T
        self.mean = self.s / self.n
        self.cov = (self.gram - np.outer(self.s, self.mean)) / max(1.0, self.n - 1)
        edges, self.fourths = edges_of(dims, width), []
        self.dims = [int(d) for d in np.diff(edges)]
        for b, (i, j) in enumerate(pairwise(edges)):
            mu, own, s, cross = self.mean[i:j], self.gram[i:j, i:j], self.s[i:j], c[i:j]
            m = float(mu @ mu)
            self.fourths.append(float(q[b] + 4 * mu @ own @ mu + self.n * m * m - 4 * mu @ cross + 2 * m * q[len(self.dims) + b] - 4 * m * mu @ s))


class Stack:
    """``Moments`` of many keys of one width: arrays with an entry for each."""

    def __init__(self, sums: list[list], dims: list[int] | int):
        n, s, g, q, c = (np.stack([np.asarray(x[i], float) for x in sums]) for i in range(5))
        self.n, width = n, s.shape[1]
        upper, lower = np.triu_indices(width)
        self.gram = np.zeros((len(n), width, width))
        self.gram[:, upper, lower] = self.gram[:, lower, upper] = g
        mean = s / n[:, None]
        self.cov = (self.gram - s[:, :, None] * mean[:, None]) / np.maximum(1.0, n - 1)[:, None, None]
        edges, self.fourths = edges_of(dims, width), []
        self.dims = [int(d) for d in np.diff(edges)]
        for b, (i, j) in enumerate(pairwise(edges)):
            mu, own, sb, cross = mean[:, i:j], self.gram[:, i:j, i:j], s[:, i:j], c[:, i:j]
            dot = lambda p, r: np.einsum("mi,mi->m", p, r)
            m = dot(mu, mu)
            self.fourths.append(q[:, b] + 4 * np.einsum("mi,mij,mj->m", mu, own, mu) + n * m * m - 4 * dot(mu, cross) + 2 * m * q[:, len(self.dims) + b] - 4 * m * dot(mu, sb))


def times(parts: DataFrame, keys: list[str], factor: Column) -> DataFrame:
    """Sums, each times a factor."""
    scaled = [(F.col("n") * factor).cast("long").alias("n"), *[F.transform(c, lambda x: x * factor).alias(c) for c in SUMS[1:]]]
    return parts.select(*keys, *scaled)


def fit_by(df: DataFrame, keys: list[str], z: str, dims: list[int] | int, kernel: Kernel, schema: str, without: str | None = None, seams: DataFrame | None = None) -> DataFrame:
    """(keys, schema): ``kernel`` gives rows from the moments of each key. Sums are shuffled, never samples.

    With ``without`` there is a fit for each value of that column which is not null: on the key's rows of all other
    values, nulls included. Each row is summed once; a fit's sums are the key's total less the value's own. A value that
    all rows of a key have gets no fit. A kernel's memory is bounded by the width of ``z``.

    ``seams`` (keys, without, sign, z) corrects these fits: rows that a value's fit also takes (sign 1) or does not take
    (sign -1), such as lagged rows next to the gap that the value's own rows leave. A value with no rows of its own needs one here, of
    sign 0 if it has no other, to get a fit.
    """
    all_keys = [*keys, without] if without else keys
    names = [*all_keys, *[c.strip().split()[0] for c in re.sub(r"<.*?>", "", schema).split(",")]]
    out = f"{head_of(df, all_keys)}, {schema}"
    parts = partial_moments(df, all_keys, z, dims)

    many = getattr(kernel, "many", None)

    def rows_of(done: list[tuple[tuple, list]]) -> pd.DataFrame:
        if not many or not done:
            return pd.DataFrame([(*k, *row) for k, sums in done for row in kernel(Moments(sums, dims))], columns=names)
        rows = []
        for same in alike(np.array([len(sums[1]) for _, sums in done])):
            for at in np.array_split(same, -(-len(same) * len(done[same[0]][1][1]) ** 2 // STACKED)):
                found = many(Stack([done[i][1] for i in at], dims))
                rows += [(*done[i][0], *row) for i, f in zip(at, found, strict=True) for row in (kernel(Moments(done[i][1], dims)) if f is None else f)]
        return pd.DataFrame(rows, columns=names)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (rows_of(done) for done in summed(batches, keys) if done)

    def fit_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = zip(key_rows(b, all_keys), zip(*[b[f"_{c}"] for c in SUMS], strict=True), zip(*[b[c] for c in SUMS], strict=True), strict=True)
            yield rows_of([(k, [x - y for x, y in zip(whole, own, strict=True)]) for k, whole, own in pairs])

    if not without:
        return by_key(parts, keys).mapInPandas(fit, out)
    own = merged(parts, all_keys)
    if seams is not None:
        kept = own.where(F.col(without).isNotNull())
        every = merged(own, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
        fix = merged(partial_moments(seams, [*all_keys, "sign"], z, dims), [*all_keys, "sign"])
        heads = kept.select(*all_keys).unionByName(fix.select(*all_keys)).distinct()
        total = heads.join(every, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).select(*all_keys, *SUMS)
        sums = total.unionByName(times(kept, all_keys, F.lit(-1))).unionByName(times(fix, all_keys, F.col("sign")))

        def fit_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return (rows_of([(k, s) for k, s in done if s[0] > 0]) for done in summed(batches, all_keys) if done)

        return by_key(sums, all_keys).mapInPandas(fit_sums, out)
    whole = merged(own, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in SUMS])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    both = own.join(whole, same).where(F.col(without).isNotNull() & (F.col("_n") > F.col("n"))).drop(*[f"_{k}" for k in keys])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, *all_keys).mapInPandas(fit_rest, out)


def covariance_long(df: DataFrame, keys: list[str], z: str, width: int) -> DataFrame:
    """(keys, i, j, cov): the sample covariance in long form, i <= j."""

    def kernel(m: Moments) -> list[tuple]:
        i, j = np.triu_indices(width)
        return list(zip(i, j, m.cov[i, j], strict=True))

    return fit_by(df, keys, z, [width], kernel, "i long, j long, cov double")


def slope(x: Column, y: Column) -> Column:
    """Aggregate or window input: least-squares slope without intercept of x on y."""
    return F.try_divide(F.sum(x * y), F.sum(y * y))


def regress_out(df: DataFrame, keys: list[str], x: str, confound: str, out: str) -> DataFrame:
    """Residual of ``x`` after one confound, no intercept, per ``keys``: a keyed sum joined back by key."""
    b = df.groupBy(*keys).agg(slope(F.col(x), F.col(confound)).alias("_b"))
    return df.join(b, keys).withColumn(out, F.col(x) - F.coalesce("_b", F.lit(0.0)) * F.col(confound)).drop("_b")


def regress_out_block(df: DataFrame, keys: list[str], x: str, dx: int, confound: str, dc: int, out: str) -> DataFrame:
    """Residual of an array after an array of confounds, no intercept, per ``keys``."""

    def kernel(m: Moments) -> list[tuple]:
        return [(np.linalg.lstsq(m.gram[dx:, dx:], m.gram[dx:, :dx], rcond=None)[0].T.ravel(),)]

    both = df.withColumn("_z", F.concat(x, confound))
    w = fit_by(both, keys, "_z", [dx, dc], kernel, "_w array<double>")
    fit = F.transform(F.sequence(F.lit(0), F.lit(dx - 1)), lambda i: F.aggregate(F.zip_with(F.slice("_w", i * dc + 1, F.lit(dc)), F.col(confound), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return df.join(w, keys).withColumn(out, F.zip_with(F.col(x), fit, lambda a, b: a - b)).drop("_w")
