"""Running sums and ranks of a whole table without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.sources.tables import settled


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, how: str = "sum") -> DataFrame:
    """Adds ``out``: the sum (or ``how="min"``) of ``value`` over the rows of ``keys`` up to and including each, in ``order``.

    Without keys the table is cut into ranges of ``order`` by Spark's range partitioning and settled; sums run within ranges, and
    the totals of the ranges before, a row each, are added. Rows that are equal in ``order`` are in one range.
    """
    agg = {"sum": F.sum, "min": F.min}[how]
    upto = (Window.unboundedPreceding, 0)
    if keys:
        return df.withColumn(out, agg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("_run", value).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    cut = settled(cut, "ranges")
    totals = cut.groupBy(F.col("_part").alias("_of")).agg(agg("_run").alias("_total"))
    before = totals.withColumn("_before", agg("_total").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)))  # a row a range
    own = cut.withColumn("_own", agg("_run").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*upto)))
    both = own.join(before.drop("_total"), F.col("_part") == F.col("_of"))
    whole = F.coalesce("_before", F.lit(0)) + F.col("_own") if how == "sum" else F.least("_before", "_own")
    return both.withColumn(out, whole).drop("_run", "_part", "_of", "_before", "_own")


def tied(df: DataFrame, keys: list[str], value: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, c, rank, ...): each distinct value once with its number of rows and their mean rank; ``more`` are further sums."""
    sums = [F.sum(e).alias(n) for n, e in (more or {}).items()]
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"), *sums)
    ranked = running(counted, keys, [F.col(value)], F.col("c"), "_hi")
    return ranked.withColumn("rank", F.col("_hi") - (F.col("c") - 1) / 2).drop("_hi")
