"""Column expressions that several operators share.

Missing values are SQL NULL inside the engine; NaN is what a statistic gives when it is undefined (a constant series).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; values that round to zero are plain 0.0."""
    c = _c(c).cast("double")
    return F.when(F.abs(c) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(c, digits))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is zero or either is missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NaN for a constant side or fewer than one pair."""
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    return ratio(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from running sums."""
    return ratio(n * sxy - sx * sy, F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0))))


def top_sum(values: Column | str, k: int) -> Column:
    """Sum of the ``k`` largest elements of an array."""
    return F.aggregate(F.slice(F.sort_array(_c(values), asc=False), 1, k), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for X binomial(n, 1/2); the log of the coefficient is carried along, so large n do not overflow."""
    start = F.struct(F.lit(0.0).alias("logc"), F.lit(0.0).alias("tail"))

    def step(acc: Column, i: Column) -> Column:
        logc = F.when(i == 0, F.lit(0.0)).otherwise(acc["logc"] + F.ln((n - i + 1).cast("double") / i))
        return F.struct(logc.alias("logc"), (acc["tail"] + F.when(i >= k, F.exp(logc - n * LN2)).otherwise(0.0)).alias("tail"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), start, step, lambda a: F.least(a["tail"], F.lit(1.0)))


def binomial_critical(n: Column, p: float) -> Column:
    """Smallest c with P(X > c) <= p for X binomial(n, 1/2)."""
    start = F.struct(F.lit(0.0).alias("logc"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("c"))

    def step(acc: Column, i: Column) -> Column:
        logc = F.when(i == 0, F.lit(0.0)).otherwise(acc["logc"] + F.ln((n - i + 1).cast("double") / i))
        cdf = acc["cdf"] + F.exp(logc - n * LN2)
        return F.struct(logc.alias("logc"), cdf.alias("cdf"), F.when((acc["c"] < 0) & (cdf >= 1 - p - 1e-12), i).otherwise(acc["c"]).alias("c"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), start, step, lambda a: a["c"])


def log_gamma(z: Column) -> Column:
    """Log of the gamma function for positive values: Stirling's series eight steps on, and back by the recurrence."""
    w = z + 8
    series = (w - 0.5) * F.ln(w) - w + math.log(2 * math.pi) / 2 + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * F.pow(w, F.lit(5.0)))
    product = reduce(lambda a, b: a * b, [z + i for i in range(8)])
    return series - F.ln(product)


def beta_share(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """The regularised incomplete beta integral from 0 to x, by its continued fraction, evaluated front to back.

    The fraction converges fast below the integrand's mean; above it the other part is computed and taken from one.
    """
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    tiny = F.lit(1e-300)
    whole = lambda v: F.when(F.abs(v) < 1e-300, tiny).otherwise(v)

    def advance(s: Column, term: Column) -> Column:
        up, down = whole(1 + term / s["up"]), 1 / whole(1 + term * s["down"])
        return F.struct(up.alias("up"), down.alias("down"), (s["value"] * up * down).alias("value"))

    def step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return advance(s, F.when(i % 2 == 0, even).otherwise(odd))

    first = F.struct(F.lit(1.0).alias("up"), (1 / whole(1 - (p + q) * y / (p + 1))).alias("down"), (1 / whole(1 - (p + q) * y / (p + 1))).alias("value"))
    value = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), first, step, lambda s: s["value"])
    front = F.exp(p * F.ln(y) + q * F.ln(1 - y) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    part = F.when(y <= 0, F.lit(0.0)).otherwise(front * value)
    return F.when(swap, 1 - part).otherwise(part)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation over n pairs; NaN below three pairs or without a correlation."""
    nu = n.cast("double") - 2
    inside = beta_share(1 - r * r, nu / 2, F.lit(0.5))
    return F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(float("nan"))).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(F.least(inside, F.lit(1.0)))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
