"""Views of stored tables in the engine's canonical schemas.

signal: (u, vid, t, x, y, z, sacc, blink, kind): subject, recording, sample number, a signal, two features, two event
series and the event's name. array_signal: (vec, group, ch): a multichannel recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIDEO = 10  # samples of one recording


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event; samples are numbered per subject by time, then event_id."""
    e = table(spark, folder, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    rows = e.select(
        F.col("user_id").alias("u"),
        t.alias("t"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.minute("ts").cast("double").alias("z"),
        F.col("event_type").isin("click", "view").alias("sacc"),
        F.col("event_type").isin("view", "error").alias("blink"),
        F.col("event_type").alias("kind"),
    )
    return rows.withColumn("vid", F.floor(F.col("t") / VIDEO))


def array_signal(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("vec"), F.col("label").cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("ch"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(modality, component, subject, value, trial): a long result table; 997 keeps averages of prices off rounding ties."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    both = o.join(c, o["o_custkey"] == c["c_custkey"])
    return both.select(F.col("c_mktsegment").alias("modality"), F.col("o_orderpriority").alias("component"), F.col("c_custkey").alias("subject"), (F.col("o_totalprice") / 997).alias("value"), F.col("o_orderkey").alias("trial"))


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("tax"))
