import zlib

import pytest
from corpus import docs, odd

from cadenza.llm import sharding


def check(out, texts, shards=16):
    got = out.collect()
    assert len(got) == len(texts)
    count = [sum(r.shard == s for r in got) for s in range(shards)]
    assert max(count) - min(count) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    return {r.doc_id: r for r in got}


@pytest.mark.parametrize("n", [0, 1, 5, 40, 333])
def test_law_of_rows(spark, n):
    texts = [f"text {i % 37} \u00e9" if i % 3 else None for i in range(n)]
    got = check(sharding.shard(docs(spark, texts)), texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len(raw) + 1, zlib.crc32(raw), "rows")


def cut_edges(got, texts):
    """Pairs of equal texts in different shards, counted one by one."""
    ids = range(len(texts))
    return sum(texts[a] == texts[b] and got[a].shard != got[b].shard for a in ids for b in ids if a < b)


def test_copies_come_together(spark):
    texts = [f"copy {i // 4}" for i in range(400)] + [f"single {i}" for i in range(400)]
    got = check(sharding.shard(docs(spark, texts)), texts)
    assert cut_edges(got, texts) <= 12  # of 600; shards are full to the row


def test_a_group_that_fits_a_shard_stays_whole(spark):
    texts = ["hot"] * 45 + ["warm"] * 20 + [f"single {i}" for i in range(735)]  # shards of 50
    got = check(sharding.shard(docs(spark, texts)), texts)
    assert cut_edges(got, texts) == 0


def test_a_group_larger_than_a_shard(spark):
    texts = ["hot"] * 300 + [f"single {i}" for i in range(100)]
    got = check(sharding.shard(docs(spark, texts)), texts)
    assert len({got[i].shard for i in range(300)}) <= 16


def test_buckets_smaller_than_groups_change_no_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 7)
    texts = ["hot"] * 60 + ["warm"] * 30 + [f"single {i}" for i in range(200)]
    check(sharding.shard(docs(spark, texts)), texts)


def test_odd_rows(spark):
    df, n = odd(spark)
    got = sharding.shard(df).collect()
    assert len(got) == n and sorted(r.shard for r in got) == list(range(n)) and {r.slot for r in got} == {0}
    assert {r.size for r in got if r.doc_id in (0, 1)} == {1} and sharding.shard(df.limit(0)).count() == 0
