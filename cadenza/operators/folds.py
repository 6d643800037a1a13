"""Cross-validation folds as tables: the fold is a key, so all folds run in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.segment import with_length


def contiguous(df: DataFrame, keys: list[str], t: str, folds: int, out: str = "fold") -> DataFrame:
    """The fold (from 1) whose test part a sample is in; null for the remainder, which only ever trains."""
    size = F.floor(F.col("_len") / folds)
    at = F.floor(F.col(t) / F.greatest(size, F.lit(1))) + 1
    return with_length(df, keys, "_len").withColumn(out, F.when((size > 0) & (at <= folds), at)).drop("_len")


def roles(df: DataFrame, fold: str, folds: int) -> DataFrame:
    """Every sample once per fold k, with ``role`` test or train."""
    spread = df.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long"))))
    return spread.withColumn("role", F.when(F.col(fold).eqNullSafe(F.col("k")), "test").otherwise("train"))


def leave_out(videos: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, fold, vid, role): groups of ``size`` consecutive recordings are tested in turn, the others train.

    ``videos`` holds (keys, vid). Raises nothing for a last group that is smaller; ``check_divisible`` does.
    """
    held = videos.select(*keys, "vid").distinct().withColumn("own", F.floor(F.col("vid") / size))
    folds = held.select(*keys, F.col("own").alias("fold")).distinct()
    out = folds.join(held, keys) if keys else folds.crossJoin(held)
    return out.select(*keys, "fold", "vid", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("role"))


def nested_validation(df: DataFrame, keys: list[str], t: str, folds: int) -> DataFrame:
    """Within each (keys) training part: ``val`` for the first of ``folds`` equal pieces, else ``train``."""
    return with_length(df, keys, "_len").withColumn("part", F.when(F.col(t) < F.floor(F.col("_len") / folds), "val").otherwise("train")).drop("_len")


def check_recordings(videos: DataFrame, keys: list[str], size: int) -> None:
    """Raises unless each of ``keys`` has a multiple of ``size`` recordings, so that all folds are of one size; a row a key is looked at."""
    n = videos.select(*keys, "vid").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    odd = n.where(F.col("n") % size != 0).orderBy(*keys).first()
    if odd:
        check_divisible(odd["n"], size)


def check_divisible(n: int, size: int) -> None:
    if n % size:
        raise ValueError(f"{n} recordings do not divide into folds of {size}")
