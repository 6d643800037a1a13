"""From raw documents to shards: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents. All stages but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; what it returns of them is said below. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontam, langid, mixing, sharding, simhash
from cadenza.llm.common import stored

LEAST_SCORE = 0.3  # of language ID; a text without letters scores 0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: rejects those without letters and those whose score is below LEAST_SCORE.

    A null text has no letter. A null lang or doc_id does not matter: a row is judged by its text, equal rows alike, and ties
    between languages go to the first by name. The model is learnt from all rows with a lang; without any, all rows go.
    """
    named = langid.identify(docs, langid.fit(docs), "_cz_lang", "_cz_score")
    return named.where((F.col("_cz_lang") != "und") & (F.col("_cz_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar texts: that of the smallest doc_id, nulls last.

    All texts without words, null ones too, are one group. Rows that share a doc_id are told apart by their texts: of one
    group the smallest hash of the text stays. Of rows equal in id and text one stays, whatever their other columns.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, or nearly so.

    Null and empty texts and items match nothing. Rows and items with a null id are compared like others; a contaminated row
    takes no other row of its id along, but those with the same text. An empty benchmark drops nothing.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents towards flatter token weights of sources, languages and topics: 90 % of the tokens stay.

    A null source or lang is a category of its own. Texts without words carry no weight and stay. Rows equal in id and text
    stay or go together; the draw is a hash of both, so a second run gives the same rows.
    """
    return mixing.mix(docs).where("_cz_kept").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal what is left to 16 shards: counts at most one apart, equal texts together as far as that allows.

    A null text counts as empty. Repeated rows are dealt one by one; with fewer rows than shards some stay empty.
    """
    return sharding.shard(docs, shards=16)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Language ID, SimHash, raking and label propagation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
