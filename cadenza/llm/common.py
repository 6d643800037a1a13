"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets one
    of its own; on a cluster that is an error, as no folder of one machine serves the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of a table of texts at a time: rows go to it in batches of about 4 MB.

    A longer text is a batch of its own. Sets the session's Arrow limits, which Spark reads when a query runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cadenza-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` is the same on pure ASCII and much faster there."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def numbered(df: DataFrame, part: list[str], order: list[str], bucket: Column, out: str, rank: str | None = None) -> DataFrame:
    """``out``: 0-based gapless position of each row within ``part``, ordered by ``rank``, bucket, then ``order``.

    No task sorts a whole ``part``: rows are ranked inside (part, rank, bucket) and shifted by the counts of the
    buckets before. The counts table has one row per (part, rank, bucket).
    """
    keys = [*part, *([rank] if rank else []), "_cz_b"]
    df = df.withColumn("_cz_b", bucket)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cz_n"))
    before = Window.partitionBy(*part).orderBy(*keys[len(part) :]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_cz_n").over(before), F.lit(0)).alias("_cz_off"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_cz_rn", F.row_number().over(inner) - 1)
    cond = None
    for k in keys:
        c = ranked[k].eqNullSafe(offsets[k])
        cond = c if cond is None else cond & c
    kept = [ranked[c] for c in df.columns if c != "_cz_b"]
    return ranked.join(offsets, cond).select(*kept, (ranked["_cz_rn"] + offsets["_cz_off"]).cast("long").alias(out))


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number that tells rows apart by id and text, nulls included; rows equal in both share it."""
    return F.xxhash64(doc_id, text, F.col(doc_id).isNull(), F.col(text).isNull())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps; (a, b) longs in, (node, comp) out.

    ``comp`` is the smallest node of the component. Each step is one grouped minimum (combined before the shuffle)
    and one join; tables are written between steps. Only nodes with an edge appear.

    Edges are settled once they are stars: a node with a smaller neighbour has no other one. That is counted while the minima
    are written, so neither the end nor a step takes a query of its own.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, seen = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), Observation()
        low = low.observe(seen, F.count_if(F.expr("m < a and n > 1")).alias("open")).select("a", F.least("m", "a").alias("m"))
        low = stored(low, "low")  # so that the join can split a hub
        if not seen.get.get("open"):
            break
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(tops)
