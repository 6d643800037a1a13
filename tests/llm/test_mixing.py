import numpy as np
import pytest
from corpus import docs, odd, rows
from pyspark.sql import functions as F

from cadenza.llm import mixing
from cadenza.llm.common import stored


def corpus(spark):
    """Two topics, languages and sources; 200 to 1,600 documents a cell."""
    d = None
    for i, (text, lang, source) in enumerate((t, g, s) for t in ("plain words of prose", "12345 67890 1234 5678 90") for g in ("en", "de") for s in ("a", "b")):
        part = docs(spark, [(10_000 * i + j, text) for j in range(200 + 200 * i)], lang, source)
        d = part if d is None else d.unionByName(part)
    return d


def brute(tokens, aims, keep, rounds=3000):
    """Raking in numpy: axes of the array are source, language and topic; weights never pass capacity."""
    free = tokens / tokens.sum()
    cap, factors = free / keep, [np.ones(n) for n in tokens.shape]
    for _ in range(rounds):
        for axis in range(3):
            w = np.minimum(cap, free * np.einsum("i,j,k->ijk", *factors))
            factors[axis] = factors[axis] * aims[axis] / w.sum(axis=tuple(x for x in range(3) if x != axis))
    return np.minimum(cap, free * np.einsum("i,j,k->ijk", *factors))


def test_raked_expected_and_drawn_shares_meet_targets(spark):
    aims = {"lang": {"en": 0.4}, "source": {"a": 0.6, "b": 0.4, "absent": 0.5}, "topics": {"prose": 0.45, "numeric": 0.55}}
    out = stored(mixing.mix(corpus(spark), **aims, keep=0.4), "mixed")
    want = {("lng", "en"): 0.4, ("lng", "de"): 0.6, ("src", "a"): 0.6, ("src", "b"): 0.4, ("top", "prose"): 0.45, ("top", "numeric"): 0.55}
    got = {(r.axis, r.category): r for r in mixing.shares(out).collect()}
    for k, share in want.items():
        assert got[k].raked == pytest.approx(share, abs=1e-3) and got[k].expected == pytest.approx(share, abs=1e-3) and got[k].drawn == pytest.approx(share, abs=0.02)
    t = {(r._cz_src, r._cz_lng, r._cz_top): r for r in out.groupBy("_cz_src", "_cz_lng", "_cz_top").agg(F.sum("_cz_tok").alias("t"), F.sum("_cz_weight").alias("w")).collect()}
    names = (("a", "b"), ("en", "de"), ("prose", "numeric"))
    table = np.array([[[t[s, g, x].t for x in names[2]] for g in names[1]] for s in names[0]], float)
    w = brute(table, [[0.6, 0.4], [0.4, 0.6], [0.45, 0.55]], 0.4)
    assert w == pytest.approx(np.array([[[t[s, g, x].w for x in names[2]] for g in names[1]] for s in names[0]]), abs=1e-3)
    total = out.agg((F.sum(F.col("_cz_p") * F.col("_cz_tok")) / F.sum("_cz_tok")).alias("x"), F.max("_cz_p").alias("p")).first()
    assert total.x == pytest.approx(0.4, abs=1e-3) and total.p <= 1


def test_default_targets_are_met_by_the_sample(spark, small):
    got = mixing.shares(mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))).collect()
    assert len(got) > 6 and all(r.expected == pytest.approx(r.raked, abs=1e-3) and r.raked <= r.present / 0.9 + 1e-3 for r in got)


def test_targets_out_of_reach_are_told(spark):
    d = docs(spark, ["some prose"] * 9, "en", "a").unionByName(docs(spark, ["more prose"] * 5, "de", "b"))
    with pytest.warns(UserWarning, match="largest error"):
        out = mixing.mix(d, lang={"en": 0.5, "de": 0.5}, source={"a": 0.7, "b": 0.3}, keep=0.5)
    assert out.count() == 14 and out.where("_cz_p is null or _cz_p < 0 or _cz_p > 1").count() == 0


def test_sampling_repeats_and_follows_the_probability(spark):
    d = docs(spark, ["five words are in here"] * 3000, source="a").unionByName(docs(spark, ["five words are in here"] * 1000, source="b").withColumn("doc_id", F.col("doc_id") + 10_000))
    a, b = (stored(mixing.mix(d, source={"a": 0.5, "b": 0.5}, keep=0.5), "mixed") for _ in range(2))
    assert rows(a.where("_cz_kept"), "doc_id") == rows(b.where("_cz_kept"), "doc_id")
    kept = {r[0]: r[1] for r in a.where("_cz_kept").groupBy("source").count().collect()}
    assert abs(kept["a"] - 1000) < 100 and kept["b"] == 1000


def test_odd_rows(spark):
    df, n = odd(spark)
    out = mixing.mix(df)
    assert out.count() == n and {r[0] for r in out.where("_cz_tok = 0").select("_cz_kept").collect()} == {True}
    assert mixing.mix(df.limit(0)).count() == 0


def test_a_pass_of_raking_has_few_jobs(spark, monkeypatch):
    """The driver keeps the plans and broadcasts of what it ran a while, so raking of some cells may not take hundreds of jobs."""
    d, jobs = stored(corpus(spark), "corpus"), spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    passes, real = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, label: passes.append(label) or real(df, label))
    before = jobs()
    mixing.mix(d, source={"a": 0.6, "b": 0.4}, keep=0.4)
    assert 1 < passes.count("factors") < 10 and jobs() - before <= 40 + 10 * passes.count("factors")


def test_an_axis_of_raking_is_one_join(spark, monkeypatch):
    """Plans that nest the axes of a pass double with each, and so do the broadcasts that the driver holds at once."""
    joins, real = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, label: joins.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join "))) or real(df, label))
    mixing.mix(stored(corpus(spark), "corpus"), source={"a": 0.6, "b": 0.4}, keep=0.4)
    passes = [n for label, n in joins if label.startswith("factors")][1:]  # the first brings the targets of all axes
    assert passes and set(passes) == {1}
