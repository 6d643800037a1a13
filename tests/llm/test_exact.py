import pytest
from corpus import docs, odd, rows
from oracle import connect, same
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup
from cadenza.llm.oracle import ORACLES
from cadenza.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLES[name])


def test_keeps_one_and_checks_bytes(spark):
    d = docs(spark, ["a", "A", "b", None, "", "\u00c9", "\u00e9"])
    want = [(0, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True)]
    assert rows(exact_dedup.deduplicate(d, "max"), "doc_id", "keep_id", "group_size", "kept") == want
    weak = lambda t: F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 0)  # noqa: E731  every digest collides
    assert rows(exact_dedup.deduplicate(d, "max", weak), "doc_id", "keep_id", "group_size", "kept") == want


def test_runs_merge(spark):
    rows_of = lambda *r: spark.createDataFrame([(i, t.encode()) for i, t in r], "doc_id long, digest binary")
    index = exact_dedup.MergeIndex(spark, "min", fan_in=3)
    index.flush(rows_of((5, "x"), (6, "y"), (8, "w"), (4, "w")))
    index.flush(rows_of((2, "x"), (9, "z")))
    assert len(index.runs) == 2 and index.runs[0][1].log_bits < 20
    index.flush(rows_of((7, "y")))
    assert len(index.runs) == 1  # compacted
    assert rows(index.compact(), "keep_id", "n") == [(2, 2), (4, 2), (6, 2), (9, 1)]
    assert rows(index.hits(), "digest") == [(b"w",), (b"x",), (b"y",)]
    digests = [r.digest for f in index.runs[0][0].inputFiles() for r in spark.read.parquet(f).collect()]
    assert sorted(digests) == [b"w", b"x", b"y", b"z"]


def test_several_flushes_and_compactions_change_nothing(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.deduplicate(d, "max", flushes=1), *cols) == rows(exact_dedup.deduplicate(d, "max", flushes=5, fan_in=2), *cols)


def test_odd_rows(spark):
    df, n = odd(spark)
    out = exact_dedup.deduplicate(df)
    assert out.count() == n and exact_dedup.deduplicate(df.limit(0)).count() == 0
    assert rows(out.where("doc_id in (3, 4)"), "keep_id", "group_size") == [(3, 2), (3, 2)]
