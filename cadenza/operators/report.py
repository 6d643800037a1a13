"""Result tables: loading, reshaping, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def natural_key(label: Column) -> Column:
    """The first number in a label, for sorting 'Subj 2' before 'Subj 10'."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, names: list, value: str, prefix: str = "") -> DataFrame:
    """One column per given name; naming them spares a pass over the data."""
    out = df.groupBy(*ids).pivot(name, names).agg(F.max(value))
    return out.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names})


def subjects_above(df: DataFrame, keys: list[str], subject: str, value: Column, level: Column) -> DataFrame:
    """(keys, n_subjects, n_above): subjects with any row above the level, and all of them."""
    each = df.groupBy(*keys, subject).agg(F.bool_or(value > level).alias("_any"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if("_any").alias("n_above"))


def paired(df: DataFrame, condition: str, first: str, second: str, keys: list[str], value: str) -> DataFrame:
    """(keys, a, b) for the keys that both conditions have; several rows of one key are averaged."""
    mean = df.where(F.col(condition).isin(first, second)).groupBy(*keys).agg(*[F.avg(F.when(F.col(condition) == c, F.col(value))).alias(n) for c, n in ((first, "a"), (second, "b"))])
    return mean.where("a is not null and b is not null")


def best_of_grid(df: DataFrame, keys: list[str], grid: str, metric: str, last_wins: bool = False) -> DataFrame:
    """The grid value with the largest metric; ties go to the first value, or to the last."""
    order = F.struct(F.col(metric), F.col(grid) if last_wins else -F.col(grid))
    return df.groupBy(*keys).agg(F.max_by(grid, order).alias(grid), F.max(metric).alias(metric))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What a box plot shows: exact quartiles, extremes and the mean."""
    q = lambda p: F.percentile(value, p)
    return df.groupBy(*keys).agg(F.min(value).alias("low"), q(0.25).alias("q1"), q(0.5).alias("med"), q(0.75).alias("q3"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
