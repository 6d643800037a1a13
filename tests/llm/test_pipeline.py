import corpus_pipeline
import pytest
from corpus import WIDE, odd, rows
from pyspark.sql import functions as F

from cadenza.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """Documents before the first stage and after each, with planted cases."""
    d = spark.read.parquet(f"{small}/documents.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    plain = d.where("length(text) > 1500").orderBy("doc_id").first().text
    words = plain.split()
    near = " ".join("changed" if i == len(words) // 2 else w for i, w in enumerate(words))
    extra = [(9001, "123 456 !!", "en", "s", 10), (9002, None, "en", "s", 0), (9003, plain, "en", "s", 1), (9004, near, "en", "s", 1), (9005, f"Own words before it. {item} And own words after it.", "en", "s", 1)]
    out = [stored(d.unionByName(spark.createDataFrame(extra, d.schema)), "start")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small), name))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix", "shard"]


def test_decisions_take_effect(stages):
    start, named, single, clean, mixed, dealt = (ids(s) for s in stages)
    assert start - named == {9001, 9002}
    assert {9003, 9004} & single == set() and named - single < named
    assert 9005 in single and 9005 not in clean
    assert mixed <= clean and dealt == mixed
    assert len(single) > 0.8 * len(named) and len(clean) > 0.8 * len(single)


def test_rows_stay_as_they_are(stages):
    first = {r.doc_id: tuple(r) for r in stages[0].collect()}
    assert all(first[r.doc_id] == tuple(r) for r in stages[4].collect())


def test_shards_are_even(stages):
    sizes = [r[0] for r in stages[5].groupBy("shard").agg(F.count(F.lit(1))).select("count(1)").collect()]
    assert max(sizes) - min(sizes) <= 1


def test_run(spark, small):
    assert rows(corpus_pipeline.run(spark, small), "doc_id") == rows(corpus_pipeline.run(spark, small), "doc_id")


def test_stages_on_odd_rows(spark, small):
    """Nulls, very long texts, repeated rows, wide ids beside nulls and clashing columns through all stages."""
    df, _ = odd(spark)
    wide = df.where("doc_id = 8").withColumn("doc_id", F.explode(F.array(*[F.lit(i) for i in WIDE])))
    wide = wide.withColumn("text", F.concat("text", F.lit(" et quelques mots de plus pour "), F.col("doc_id").cast("string")))
    now = stored(df.unionByName(wide), "start")
    columns, left = now.columns, now.count()
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, small), name)
        assert now.count() <= left and (name == "shard" or now.columns == columns)
        left = now.count()
        known = {0, 1, 3, 4, 5, 6, 7, 8, None, *WIDE}
        assert left > 0 and ids(now) <= known


def test_stages_on_an_empty_table(spark, small, tmp_path):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    few = spark.read.parquet(f"{small}/documents.parquet").limit(5)
    assert corpus_pipeline.decontaminate(spark, few, str(tmp_path)).count() == few.count()
