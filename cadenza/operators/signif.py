"""Significance levels from permutations, binomial and rank tests, multiple-testing adjustment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import kernels
from cadenza.operators.ranks import running, tied

EXACT = 50  # rows up to which the null distribution of a rank sum is counted


def order_statistic(df: DataFrame, keys: list[str], value: Column, m: Column | Callable[[Column], Column], out: str = "level") -> DataFrame:
    """The m-th largest value per ``keys``; m = 0 gives the smallest. With keys ``m`` may be a function of their number of values.

    Equal values are counted first, so windows run over (key, value, count) rows instead of samples.
    """
    counted = df.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, keys, [F.desc("_v")], F.col("_c"), "_hi")
    if callable(m):
        ranked, m = ranked.withColumn("_m", m(F.sum("_c").over(Window.partitionBy(*keys)))), F.col("_m")
    hit = (F.col("_hi") >= m) & (F.col("_hi") - F.col("_c") < m)
    return ranked.groupBy(*keys).agg(F.when(F.max(m) == 0, F.min("_v")).otherwise(F.max(F.when(hit, F.col("_v")))).alias(out))


def pooled_level(permuted: DataFrame, keys: list[str], r: str, p: float, out: str = "level") -> DataFrame:
    """Significance level of |r| pooled per ``keys``: the int(n p)-th largest of n values. With keys ``permuted`` is computed once."""
    m = lambda n: F.floor(n * p)
    if not keys:
        m = F.lit(permuted.where(F.col(r).isNotNull()).agg(m(F.count(F.lit(1))).alias("_m")).first()["_m"])
    return order_statistic(permuted, keys, F.abs(r), m, out)


def ascending_level(df: DataFrame, keys: list[str], value: str, share: float, out: str = "level") -> DataFrame:
    """The value at ascending 0-based index int(share * n), per ``keys``."""
    m = lambda n: n - F.least(F.floor(n * share), n - 1)
    if not keys:
        m = F.lit(df.where(F.col(value).isNotNull()).agg(m(F.count(F.lit(1))).alias("_m")).first()["_m"])
    return order_statistic(df, keys, F.col(value), m, out)


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str, tie: list[str], out: str = "adjusted") -> DataFrame:
    """Adjusted p-values per family ``keys``: p m / rank, then the running minimum from the largest p, at most 1."""
    up = running(tests, keys, [F.col(c) for c in (p, *tie)], F.lit(1), "_rank")
    if keys:
        up = up.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        up = up.crossJoin(F.broadcast(tests.agg(F.count(F.lit(1)).alias("_m"))))  # one row
    down = running(up.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank")), keys, [F.desc(c) for c in (p, *tie)], F.col("_raw"), "_least", "min")
    return down.withColumn(out, F.least("_least", F.lit(1.0))).drop("_raw", "_rank", "_m", "_least")


def mid_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks with ties sharing their mean: values are counted, ranked once each, and joined back."""
    ranks = tied(df, keys, value).drop("c").withColumnsRenamed({c: f"_r{c}" for c in (*keys, value)})
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(ranks[f"_r{c}"]) for c in (*keys, value)])
    return df.join(ranks.withColumnRenamed("rank", "_rank"), same).withColumn(out, F.col("_rank")).drop("_rank", *[f"_r{c}" for c in (*keys, value)])


def with_groups(stats: DataFrame, ranks: DataFrame, keys: list[str], n: Column, most: int) -> DataFrame:
    """``stats`` with ``groups``, the (doubled rank, count) of each value, where a key has ``most`` rows at most; else null."""
    small = stats.where(n <= most).select(*[F.col(k).alias(f"_s{k}") for k in keys])
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys], F.lit(True))
    few = ranks.join(small, same("", "_s"), "left_semi").groupBy(*[F.col(k).alias(f"_s{k}") for k in keys])
    few = few.agg(F.array_sort(F.collect_list(F.struct((F.col("rank") * 2).cast("long").alias("twice"), "c"))).alias("groups"))  # ``most`` values at most
    few = few.where(F.size("groups") > 0)
    return stats.join(few, same("", "_s"), "left").drop(*[f"_s{k}" for k in keys])


def wilcoxon(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, w, ties, groups): signed-rank statistic of a - b: sum of the ranks of positive differences; zeros are dropped.

    ``ties`` is the sum of c^3 - c over values that occur c times; ``groups`` has the ranks themselves up to EXACT pairs.
    """
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    ranks = tied(d, keys, "_abs", {"_up": (F.col("_d") > 0).cast("long")})
    stats = ranks.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("_up")).alias("w"), tie_sum())
    return with_groups(stats, ranks, keys, F.col("n"), EXACT)


def tie_sum() -> Column:
    return F.sum(F.col("c").cast("double") * (F.col("c") * F.col("c") - 1)).alias("ties")


def one_of(alternative: str, above: Column, below: Column) -> Column:
    """The p-value of an alternative from P(statistic >= own) and P(statistic <= own)."""
    return {"greater": above, "less": below, "two-sided": F.least(F.least(above, below) * 2, F.lit(1.0))}[alternative]


def exact_tails(kernel: Callable[..., tuple[float, float]], *args: str) -> Column:
    """(above, below): the exact tails where ``groups`` is known; arguments go to the kernel with doubled ranks and their counts."""

    @F.pandas_udf("above double, below double")
    def udf(groups: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        out = []
        for g, *values in zip(groups, *rest, strict=True):
            out.append((None, None) if g is None else kernel([r["twice"] for r in g for _ in range(r["c"])], *map(float, values)))
        return pd.DataFrame(out, columns=["above", "below"], dtype="float64")

    return udf("groups", *args)


def p_values(stats: DataFrame, exact: Column, z: Callable[[float], Column], alternative: str) -> DataFrame:
    """``stats`` with ``p``: exact where ranks are known, else normal; ``z`` gives the standard score for a continuity correction."""
    known = stats.withColumn("_exact", exact)
    normal = one_of(alternative, normal_tail(z(-0.5)), normal_tail(-z(0.5)))
    return known.withColumn("p", F.when(F.col("groups").isNotNull(), one_of(alternative, F.col("_exact.above"), F.col("_exact.below"))).otherwise(normal)).drop("_exact")


def wilcoxon_p(stats: DataFrame, alternative: str = "greater") -> DataFrame:
    """p-value of ``wilcoxon``, ties included: exact over all sign patterns up to EXACT pairs, then normal with the variance that ties leave."""
    mean = F.col("n") * (F.col("n") + 1) / 4
    sd = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48)
    return p_values(stats, exact_tails(kernels.signed_rank_tails, "w"), lambda c: (F.col("w") - mean + c) / sd, alternative)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation 26.2.17 of Abramowitz and Stegun (absolute error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def mann_whitney(df: DataFrame, keys: list[str], first: Column, value: str) -> DataFrame:
    """(keys, n1, n2, u, ties, groups): U of the rows where ``first`` holds against the others; ties and groups as in ``wilcoxon``."""
    ranks = tied(df.withColumn("_f", first.cast("long")), keys, value, {"_first": F.col("_f")})
    stats = ranks.groupBy(*keys).agg(F.sum("_first").alias("n1"), F.sum(F.col("c") - F.col("_first")).alias("n2"), F.sum(F.col("rank") * F.col("_first")).alias("_w"), tie_sum())
    stats = stats.withColumn("u", F.col("_w") - F.col("n1") * (F.col("n1") + 1) / 2).drop("_w")
    return with_groups(stats, ranks, keys, F.col("n1") + F.col("n2"), EXACT)


def mann_whitney_p(stats: DataFrame, alternative: str = "greater") -> DataFrame:
    """p-value of ``mann_whitney``, ties included: exact over all ways to choose the first group up to EXACT rows in all, then normal."""
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.try_divide(F.col("n1") * F.col("n2"), F.lit(12)) * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    return p_values(stats, exact_tails(kernels.rank_sum_tails, "u", "n1"), lambda c: F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 + c, sd), alternative)
