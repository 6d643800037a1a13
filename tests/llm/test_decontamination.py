import random
import re
from collections import Counter

import pytest
from corpus import WIDE, docs, odd, rows

from cadenza.llm import decontam


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(documents, items, similarity=0.8):
    found = set()
    for item, text in items:
        m = words(text)
        if not m:
            continue
        k = min(5, len(m))
        b = bag(m, k)
        for doc, t in documents:
            w = words(t)
            if not bag(w, k).keys() & b.keys():
                continue
            for i in range(max(1, len(w) - len(m) + 1)):
                a = bag(w[i : i + len(m)], k)
                both = sum((a & b).values())
                if both / (sum(a.values()) + sum(b.values()) - both) >= similarity:
                    found.add((doc, item))
                    break
    return found


def test_equals_brute_force(spark, small):
    d, b = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = {(r.doc_id, i) for r in decontam.contaminated(d, b).collect() for i in r.item_ids}
    assert got == brute([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()])


ITEM = " ".join(f"word{i}" for i in range(40))


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "only three words"), (3, None), (4, ""), (5, "tick tock " * 10)], "item_id long, text string")


def test_planted_cases(spark, bench):
    w = ITEM.split()
    one_off = " ".join([*w[:20], "other", *w[21:]])
    far_off = " ".join(x if i % 6 else "other" for i, x in enumerate(w))
    texts = [ITEM, f"before {ITEM.upper()}, after", one_off, far_off, " ".join(w[:20]), "we have only three words here", "clean text", None, "", "tick tock " * 12]
    got = {r.doc_id: r for r in decontam.contaminated(docs(spark, texts), bench).collect()}
    assert {i: r.item_ids for i, r in got.items()} == {0: [1], 1: [1], 5: [2], 9: [5]} | ({2: [1]} if 2 in got else {})
    assert brute(list(enumerate(texts)), [tuple(r) for r in bench.collect()]) == {(i, x) for i, r in got.items() for x in r.item_ids}
    assert got[1].first_word <= 1 and got[0].max_similarity == 1.0


def test_near_copies_of_items_are_found(spark):
    """Items of 20 to 60 words with words changed, as wholes, inside texts and cut short, against brute force."""
    rnd = random.Random(6)
    items = [(i, " ".join(f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(20, 60)))) for i in range(40)]
    texts = []
    for _, t in items:
        for edits in range(4):
            w = t.split()
            for _ in range(edits):
                w[rnd.randrange(len(w))] = f"y{rnd.randrange(999)}"
            around = [" ".join(f"o{rnd.randrange(999)}" for _ in range(30)) for _ in range(2)]
            texts += [" ".join([around[0], *w, around[1]]), " ".join(w[: len(w) - edits])]
    got = {(r.doc_id, i) for r in decontam.contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect() for i in r.item_ids}
    want = brute(list(enumerate(texts)), items)
    assert got <= want and len(want) > 100 and len(got) >= 0.98 * len(want)


def test_blocks_of_items_change_nothing(spark, bench):
    d = docs(spark, [ITEM, "only three words", "clean"])
    one, many = decontam.leaks(d, bench), decontam.leaks(d, bench, most_shingles=10)
    assert rows(one, *one.columns) == rows(many, *one.columns)


def test_odd_rows(spark, bench):
    df, n = odd(spark)
    assert decontam.clean(df, bench).count() == n and decontam.clean(df, bench).columns == df.columns
    assert decontam.clean(df.limit(0), bench).count() == 0 and decontam.clean(df, bench.limit(0)).count() == n
    extra = bench.unionByName(spark.createDataFrame([(None, "an item whose id is null stands here in full")], bench.schema))
    d = docs(spark, [(None, ITEM), (None, "clean words"), (1, "x"), (2, ITEM), (2, "clean"), (2, ITEM), (3, "so an item whose id is null stands here in full text")])
    assert rows(decontam.clean(d, extra), "doc_id", "text") == [(1, "x"), (2, "clean"), (None, "clean words")]
    assert sorted((str(r.doc_id), r.item_ids, r.n_items) for r in decontam.contaminated(d, extra).collect()) == [("2", [1], 1), ("3", [], 1), ("None", [1], 1)]


def test_wide_ids_beside_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = docs(spark, [(WIDE[1], text), (None, text + " more"), (WIDE[0], "clean words of another text")]).coalesce(1)
    b = spark.createDataFrame([(WIDE[1], text), (None, "other item of some words here")], "item_id long, text string").coalesce(1)
    assert sorted(map(str, [(r.doc_id, r.item_ids) for r in decontam.contaminated(d, b).collect()])) == sorted(map(str, [(WIDE[1], [WIDE[1]]), (None, [WIDE[1]])]))
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == [WIDE[0]]
