"""The corpus queries op1 to op13: operators with production parameters over whole tables, in the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import audit, chat, decontam, exact_dedup, langid, licenses, mixing, pivots, secrets, sharding, simhash, vptree, warc
from cadenza.llm.common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = mixing.cells(table(spark, sf_dir, "documents")).select("doc_id", "_cz_src", "_cz_lng", "_cz_top", "_cz_tok", "_cz_rid")
    mixed = mixing.weigh(stored(cells, "cells"))
    return mixed.select("doc_id", F.col("_cz_top").alias("topic"), F.col("_cz_tok").alias("n_tokens"), F.col("_cz_weight").alias("weight"), F.col("_cz_p").alias("p"), F.col("_cz_kept").alias("kept"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    n = [count(k).alias(f"n_{k}") for k, *_ in secrets.BASE]
    return found.select("doc_id", *n, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), keep="max")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.assign_groups(table(spark, sf_dir, "documents"), shingle=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: 256 * x.cast("double"))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))  # all larger doubles are whole
    return pivots.mine(rows.select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 100 == 0)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return vptree.search(rows, F.col("vec_id") % 20 == 0, k=20)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_decontamination, op3_mixing, op4_license_scan, op5_secret_scan, op6_exact_dedup, op7_sharding, op8_warc, op9_chat_format, op10_simhash, op11_hard_negatives, op12_nearest, op13_filter_audit)
}
