"""Gap filling, trimming, normalisation, velocities and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cadenza.functions.expr import dot
from cadenza.operators.halo import over, with_known
from cadenza.operators.segment import segments, with_length


def fill_linear(df: DataFrame, keys: list[str], t: str, col: str, out: str | None = None, rows: int | None = None) -> DataFrame:
    """Linear interpolation of nulls; ends extrapolate from the two nearest known points; fewer than two: unchanged.

    With ``rows`` in pieces of so many numbers of ``t``, each with the two nearest known points on both sides; no task sorts a whole sequence.
    """
    if rows is not None:
        pieces = with_known(df, keys, t, F.col(col).isNotNull(), 2, rows)
        return fill_linear(pieces, [*keys, "_piece"], t, col, out).where(~F.col("_halo")).drop("_piece", "_halo")
    w = Window.partitionBy(*keys).orderBy(t)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    point = F.when(F.col(col).isNotNull(), F.struct(F.col(t).cast("double").alias("t"), F.col(col).alias("x")))
    df = df.withColumn("_k", point)
    df = df.withColumns({"_p": F.last("_k", ignorenulls=True).over(back), "_n": F.first("_k", ignorenulls=True).over(ahead)})
    pair = lambda c: F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("a"), F.col(c).alias("b")))
    df = df.withColumns({"_pp": F.last(pair("_p"), ignorenulls=True).over(back), "_nn": F.first(pair("_n"), ignorenulls=True).over(ahead)})

    def line(a: Column, b: Column) -> Column:
        return a["x"] + (b["x"] - a["x"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])

    filled = (
        F.when(F.col("_k").isNotNull(), F.col(col))
        .when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), line(F.col("_p"), F.col("_n")))
        .when(F.col("_n").isNull() & F.col("_pp.b").isNotNull(), line(F.col("_pp.b"), F.col("_pp.a")))
        .when(F.col("_p").isNull() & F.col("_nn.b").isNotNull(), line(F.col("_nn.a"), F.col("_nn.b")))
    )
    return df.withColumn(out or col, filled).drop("_k", "_p", "_n", "_pp", "_nn")


def blank(df: DataFrame, where: Column, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.when(where, F.lit(None)).otherwise(F.col(col)))


def trim_and_center(df: DataFrame, keys: list[str], t: str, cols: list[str], edge: int) -> DataFrame:
    """Drop the first and last ``edge`` samples of each sequence, then subtract the mean of what is left."""
    kept = with_length(df, keys, "_len").where((F.col(t) >= edge) & (F.col(t) < F.col("_len") - edge)).drop("_len")
    w = Window.partitionBy(*keys)
    return kept.withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})


def difference(col: str, w: WindowSpec) -> Column:
    """First difference; 0 for the first sample."""
    return F.col(col) - F.coalesce(F.lag(col).over(w), F.col(col))


def velocity(df: DataFrame, keys: list[str], t: str, x: str, y: str, out: str = "vel", rows: int | None = None) -> DataFrame:
    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        dx, dy = difference(x, w), difference(y, w)
        return d.withColumn(out, F.sqrt(dx * dx + dy * dy))

    return over(df, keys, [t], 1, 0, add, rows)


def normalize_segments(df: DataFrame, keys: list[str], t: str, cols: list[str], length: int) -> DataFrame:
    """Per segment: centre each channel, then divide by the Frobenius norm over all channels."""
    cut = segments(df, keys, t, length)
    w = Window.partitionBy(*keys, "segment")
    cut = cut.withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})
    norm = F.sqrt(F.sum(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))).over(w))
    return cut.withColumn("_norm", norm).withColumns({c: F.when(F.col("_norm") > 0, F.col(c) / F.col("_norm")).otherwise(0.0) for c in cols}).drop("_norm")


def peaks(df: DataFrame, keys: list[str], t: str, col: str, out: str = "peak") -> DataFrame:
    """Local maxima; of a plateau with lower sides the middle sample (the left one of two) is the peak."""
    w = Window.partitionBy(*keys).orderBy(t)
    prev, change = F.lag(col).over(w), F.coalesce((F.col(col) != F.lag(col).over(w)).cast("long"), F.lit(1))
    df = df.withColumns({"_prev": prev, "_new": change, "_next": F.lead(col).over(w)}).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run")
    ends = {"_a": F.min(t).over(run), "_b": F.max(t).over(run), "_left": F.min_by("_prev", t).over(run), "_right": F.max_by("_next", t).over(run)}
    df = df.withColumns(ends)
    high = (F.col("_left") < F.col(col)) & (F.col("_right") < F.col(col))
    return df.withColumn(out, F.coalesce(high & (F.col(t) == F.floor((F.col("_a") + F.col("_b")) / 2)), F.lit(False))).drop("_prev", "_new", "_next", "_run", "_a", "_b", "_left", "_right")


def average_reference(ch: Column) -> Column:
    """Each channel less the mean of all channels."""
    mean = F.aggregate(ch, F.lit(0.0), lambda a, x: a + x) / F.size(ch)
    return F.transform(ch, lambda x: x - mean)


def frobenius(ch: Column) -> Column:
    """Aggregate: Frobenius norm of the rows of an array column."""
    return F.sqrt(F.sum(dot(ch, ch)))


def peak_scale(df: DataFrame, keys: list[str], t: str, cols: list[str], last: int) -> DataFrame:
    """The last ``last`` samples, each series divided by its maximum there."""
    tail = with_length(df, keys, "_len").where(F.col(t) >= F.col("_len") - last).drop("_len")
    w = Window.partitionBy(*keys)
    return tail.withColumns({c: F.try_divide(F.col(c), F.max(c).over(w)) for c in cols})


def bucket_mean(df: DataFrame, keys: list[str], t: str, cols: list[str], size: int) -> DataFrame:
    """Mean of each ``size`` samples: resampling to a lower rate."""
    return df.groupBy(*keys, F.floor(F.col(t) / size).alias("bucket")).agg(*[F.avg(c).alias(c) for c in cols])


def align_window(df: DataFrame, keys: list[str], t: str, offset: int, length: int) -> DataFrame:
    """``length`` samples from ``offset`` on; where they would pass the end the window slides back."""
    df = with_length(df, keys, "_len")
    end = F.least(F.lit(offset + length).cast("long"), F.col("_len"))
    return df.where((F.col(t) >= end - length) & (F.col(t) < end)).drop("_len")
