"""Boolean series: which samples to keep. With ``rows`` windows run in pieces of so many rows; see ``halo``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.halo import over


def event_mask(df: DataFrame, keys: list[str], order: list[str], event: Column, before: int, after: int, out: str = "keep", rows: int | None = None) -> DataFrame:
    """False from ``before`` samples ahead of an event to ``after`` samples past it; true everywhere without events."""
    add = lambda d, w: d.withColumn(out, ~F.coalesce(F.max(event).over(w.rowsBetween(-after, before)), F.lit(False)))
    return over(df, keys, order, after, before, add, rows)


def expand_mask(df: DataFrame, keys: list[str], order: list[str], mask: str, lags: int, offset: int, out: str = "keep", rows: int | None = None) -> DataFrame:
    """False where a lagged row would read a masked sample; samples beyond the ends count as kept."""
    add = lambda d, w: d.withColumn(out, F.coalesce(F.min(mask).over(w.rowsBetween(offset - lags + 1, offset)), F.lit(True)))
    return over(df, keys, order, lags - 1 - offset, offset, add, rows)


def data_loss(df: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """Share of samples that a mask drops, per ``keys``."""
    return df.groupBy(*keys).agg((1 - F.avg(F.col(mask).cast("double"))).alias("loss"))


def without_blinks(event: str, blink: str) -> Column:
    """Events that are not blinks."""
    return F.col(event) & ~F.col(blink)


def by_role(masks: DataFrame, role: str) -> DataFrame:
    """The masks of one role (train or test); the role is a column, never guessed from a length."""
    return masks.where(F.col("role") == role).drop("role")
