"""Exact deduplication with a log-structured merge index, in DataFrame functions only.

Rows reach the index in flushes. A flush combines its memtables (each task's digests) and writes them as a run sorted by digest:
digest, identifier to keep, row count, with a Bloom filter. Digests that the filter of an older run might hold are looked
up in that run; what is found there, and what a memtable holds twice, are hits. When ``fan_in`` runs have gathered,
compaction merges them into one, keeping for each digest the identifier to keep and the sum of the counts. The texts of
hits are fetched and compared byte by byte.

Edge cases: null counts as empty text, and equal texts differ at most in the case of A-Z. Rows that repeat a doc_id
count as rows of their own; of equal texts every row with the kept doc_id has ``kept`` true. A null doc_id loses to any
other. Only ``doc_id`` and ``text`` are read. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, scratch, stored
from cadenza.llm.filters import KeyFilter


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class MergeIndex:
    """Sorted runs of (digest, keep_id, n) in the shared folder, each with a filter. ``keep``: ``min`` or ``max`` identifier."""

    def __init__(self, spark: SparkSession, keep: str = "min", fan_in: int = 4):
        self.spark, self.keep, self.fan_in = spark, {"min": F.min, "max": F.max}[keep], fan_in
        self.path, self.written = scratch(spark, "runs"), 0
        self.runs: list[tuple[DataFrame, KeyFilter]] = []
        self.found: list[DataFrame] = []

    def write(self, table: DataFrame) -> DataFrame:
        to = f"{self.path}/run={self.written}"
        table.sortWithinPartitions("digest").write.parquet(to)
        self.written += 1
        return self.spark.read.schema(table.schema).parquet(to)

    def flush(self, rows: DataFrame) -> None:
        """Write rows (doc_id, digest) as a run, and look its digests up in the older ones."""
        run = self.write(rows.groupBy("digest").agg(self.keep("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        self.found.append(run.where("n > 1").select("digest"))
        for old, held in self.runs:
            self.found.append(run.where(held.might_hold(F.col("digest"))).join(old, "digest", "left_semi").select("digest"))
        self.runs.append((run, KeyFilter(run.select("digest"))))
        if len(self.runs) >= self.fan_in:
            self.compact()

    def compact(self) -> DataFrame:
        """Merge all runs into one and return it: digest, keep_id, n."""
        if len(self.runs) > 1:
            merged = reduce(DataFrame.unionByName, [run for run, _ in self.runs])
            run = self.write(merged.groupBy("digest").agg(self.keep("keep_id").alias("keep_id"), F.sum("n").alias("n")))
            self.runs = [(run, KeyFilter(run.select("digest")))]
        return self.runs[0][0]

    def hits(self) -> DataFrame:
        """The digests that more than one row holds."""
        return stored(reduce(DataFrame.unionByName, self.found).distinct(), "hits")


def deduplicate(docs: DataFrame, keep: str = "min", digest=sha256, flushes: int = 4, fan_in: int = 4) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row, dropped ones too.

    The rows come in ``flushes`` parts. The byte check groups the hits by digest and whole text, combined before the
    shuffle, so a text that a third of the rows share leaves each task once; texts that the hit filter rules out are not
    shuffled at all. Digests under which texts differ are resolved by the texts themselves.
    """
    index = MergeIndex(docs.sparkSession, keep, fan_in)
    flushed = stored(docs.select("doc_id", digest(ascii_lower("text")).alias("digest")), "digests")
    for i in range(flushes):
        index.flush(flushed.where(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(flushes)) == i))
    level, hits = index.compact(), index.hits()
    texts = docs.select("doc_id", ascii_lower("text").alias("norm")).withColumn("digest", digest(F.col("norm")))
    suspects = texts.where(KeyFilter(hits).might_hold(F.col("digest")))
    groups = suspects.groupBy("digest", "norm").agg(index.keep("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = groups.join(hits, "digest", "left_semi")
    clash = stored(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("digest"), "clash")
    if clash.isEmpty():
        whole = flushed.join(level, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.lower(F.hex("digest")).alias("sha"))
    else:
        plain = flushed.join(level.join(clash, "digest", "left_anti"), "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest")
        lone = suspects.join(clash, "digest", "left_semi")
        parts = lone.groupBy("norm").agg(index.keep("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        mixed = lone.join(parts, "norm").select("doc_id", "keep_id", "group_size", "digest")
        whole = plain.unionByName(mixed).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("sha"))
    if digest is not sha256:
        whole = whole.withColumn("sha", F.lit(None).cast("string"))
    return whole.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
