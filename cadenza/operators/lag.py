"""Lagged (Hankel) windows. ``keys`` names the sequence that lags must not leave, and is always explicit.

With ``rows`` a sequence is cut into pieces of so many rows (see ``halo``), so that no task sorts a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.halo import over


def sequence_number(df: DataFrame, keys: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """0-based position within the concatenation that ``keys`` and ``order`` define."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def hankel(df: DataFrame, keys: list[str], order: list[str], cols: list[str], lags: int, offset: int = 0, rows: int | None = None) -> DataFrame:
    """Adds ``{col}_{k}`` = col at position t + offset - k for k below ``lags``, 0 beyond either end."""
    add = lambda d, w: d.withColumns({f"{c}_{k}": F.lag(c, k - offset, 0.0).over(w) for c in cols for k in range(lags)})
    return over(df, keys, order, lags - 1 - offset, offset, add, rows)


def block_hankel(df: DataFrame, keys: list[str], order: list[str], ch: str, width: int, lags: int, offset: int = 0, out: str = "h", rows: int | None = None) -> DataFrame:
    """Adds array ``out`` of width * lags values, channel by channel: value c * lags + k is channel c at t + offset - k."""
    zero = F.array_repeat(F.lit(0.0), width)
    shifted = [f"_lag{k}" for k in range(lags)]
    add = lambda d, w: d.withColumns({n: F.coalesce(F.lag(ch, k - offset).over(w), zero) for k, n in enumerate(shifted)})
    df = over(df, keys, order, lags - 1 - offset, offset, add, rows)
    mixed = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array(*[F.get(F.col(n), i) for n in shifted])))
    return df.withColumn(out, mixed).drop(*shifted)


def zero_lag_rows(weights: DataFrame, feature: str, lags: int, offset: int) -> DataFrame:
    """Of rows per lagged feature those at lag zero; ``channel`` is the feature's channel."""
    return weights.where(F.col(feature) % lags == offset).withColumn("channel", F.floor(F.col(feature) / lags))


def channel_lags(h: Column, channels: list[int], lags: int) -> Column:
    """The lagged values of some channels of a block Hankel row."""
    return F.flatten(F.array(*[F.slice(h, c * lags + 1, lags) for c in channels]))


def split_features(weights: DataFrame, feature: str, widths: list[tuple[str, int]]) -> DataFrame:
    """Adds ``modality`` and ``local`` to rows of stacked features, by the widths of the stacked parts."""
    modality = local = None
    at = 0
    for name, n in widths:
        here = (F.col(feature) >= at) & (F.col(feature) < at + n)
        modality = F.when(here, F.lit(name)) if modality is None else modality.when(here, F.lit(name))
        local = F.when(here, F.col(feature) - at) if local is None else local.when(here, F.col(feature) - at)
        at += n
    return weights.withColumns({"modality": modality, "local": local})
