import random

import pytest
import xxhash
from corpus import WIDE, docs, odd, rows
from pyspark.sql import functions as F

from cadenza.llm import simhash
from cadenza.llm.common import components, stored
from cadenza.llm.queries import op10_simhash

SPACE = b" \t\n\x0b\x0c\r"


def brute_print(text, k=3):
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    w = [x for x in raw.translate(bytes.maketrans(SPACE, b" " * 6)).split(b" ") if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    comp = {i: i for i in prints}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}


def test_equals_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in d}
    comps = brute_components(prints)
    assert rows(op10_simhash(spark, small), "doc_id", "fingerprint", "component_id") == sorted([(i, f"{p:016x}", comps[i]) for i, p in prints.items()], key=str)


def test_links_reach_every_pair_within_two_bits(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    got = {r.node: r.comp for r in components(simhash.ball_links(df)).collect()}
    want = brute_components({s: f for f, s in signed.items()})
    assert {s: got.get(s, s) for s in signed.values()} == want


def test_look_ups_are_verified_by_the_complete_distance(spark):
    fps = [0, 0xFFFF << 48, 0x7, 0x3, (1 << 63) | 1]  # the second and third share three segments with the first
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    met = {(r.fp, r.other) for r in simhash.probes(df).join(simhash.tables(df), "key").where("fp <> other").collect()}
    assert (0, simhash.signed(fps[1])) in met and (0, 7) in met
    links = {tuple(sorted((r.a, r.b))) for r in simhash.ball_links(df).collect()}
    assert links == {tuple(sorted(map(simhash.signed, p))) for p in ((0, 3), (7, 3), (0, fps[4]), (3, fps[4])) if bin(p[0] ^ p[1]).count("1") <= 2}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.comp for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_components_of_random_edges(spark):
    """Chains, stars, cycles and cliques, repeated and turned edges, loops: the same components as by hand, in few jobs."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, x) for x in range(201, 260)] + [(7, 7), (-5, 300), (300, -5)]
    comp = {x: x for p in pairs for x in p}
    for _ in comp:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    edges = stored(spark.createDataFrame(pairs, "a long, b long"), "pairs")
    alone = {x for x in comp if all(a == b for a, b in pairs if x in (a, b))}
    assert {r.node: r.comp for r in components(edges).collect()} == {x: c for x, c in comp.items() if x not in alone}
    star = stored(edges.where("a = 200"), "star")
    before = jobs()
    found = components(star)
    assert jobs() - before <= 6
    assert {r.comp for r in found.collect()} == {200}


def similar(spark, texts):
    p, g = simhash.similar_groups(docs(spark, texts))
    return [r[1] for r in rows(p.join(g, ["f1", "f2", "f5"]), "doc_id", "component_id")] if len(texts) < 10 else {r.doc_id: r.component_id for r in p.join(g, ["f1", "f2", "f5"]).collect()}


def test_near_copies_are_grouped_and_others_left(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, family = [], []
    for f in range(60):
        base = [rnd.choice(vocabulary) for _ in range(250)]
        for c in range(4):
            w = base.copy()
            for _ in range((0, 2, 4, 5)[c]):
                w[rnd.randrange(250)] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
            family.append(f)
    got = similar(spark, texts)
    found = sum(got[i] == 4 * family[i] for i in range(len(texts)))
    assert found >= 0.97 * len(texts) and all(family[got[i]] == family[i] for i in got)


def test_short_and_empty_texts(spark):
    assert similar(spark, ["one", "One!", "two", "", None, "a b c", "a b c", "a b d"]) == [0, 0, 2, 3, 3, 5, 5, 7]


def test_keep_one_keeps_one_row_of_a_group(spark):
    df, n = odd(spark)
    out = simhash.keep_one(df)
    # 1 copies 0 (no words), 4 copies 3, and one of the two equal rows of 6 goes; both texts of 5 stay
    assert out.columns == df.columns and rows(out, "doc_id") == sorted([(0,), (3,), (5,), (5,), (6,), (7,), (8,), (None,)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0
    a, b, c = ("one text of some words that others copy", "a second text that has its own words", "third words of somebody else here")
    more = [(1, a), (1, a), (11, b), (5, b), (5, "another text of id five"), (20, c), (None, c), (None, "own words of a null id")]
    assert rows(simhash.keep_one(docs(spark, more)), "doc_id", "text") == sorted([(1, a), (5, b), (5, "another text of id five"), (20, c), (None, "own words of a null id")], key=str)


def test_odd_rows(spark):
    df, _ = odd(spark)
    got = simhash.assign_groups(df)
    assert rows(got, "doc_id", "component_id") == sorted([(0, 0), (1, 0), (None, None), (3, 3), (4, 3), (5, 5), (5, 5), (6, 6), (6, 6), (7, 7), (8, 8)], key=str)
    assert {r.fp for r in got.where("doc_id < 2").collect()} == {0} and simhash.assign_groups(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies_equals_brute_force(spark):
    """Copies of one text from hardly to much changed: exact links decide, also between copies that the original lacks."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(base)]
    for i in range(220):
        w = base.copy() if i % 3 else texts[-1].split()
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w[: rnd.choice((len(w), len(w) - 4))]))
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if root(a) != root(b) and jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    got = similar(spark, texts)
    want = {i: root(i) for i in range(len(texts))}
    assert len(set(want.values())) > 20 and sum(got[i] != want[i] for i in want) <= 1


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def edited(rnd, n, edit, share):
    """A text of ``n`` words and a copy of which ``share`` is scattered changes, appended, cut off or a block replaced."""
    w, m = [f"v{rnd.randrange(10**9)}" for _ in range(n)], max(1, round(share * n))
    new = [f"x{rnd.randrange(10**9)}" for _ in range(m)]
    if edit == "scattered":
        v = w.copy()
        for i, x in zip(rnd.sample(range(n), m), new, strict=True):
            v[i] = x
    else:
        at = rnd.randrange(n - m)
        v = {"appended": w + new, "cut": w[:-m], "block": w[:at] + new + w[at + m :]}[edit]
    return " ".join(w), " ".join(v)


def test_only_pairs_of_the_similarity_are_linked(spark):
    rnd = random.Random(8)
    pairs = [edited(rnd, 300, "scattered", share) for share in (0.003, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06) for _ in range(30)]
    got = similar(spark, [t for p in pairs for t in p])
    low = [got[2 * i] == got[2 * i + 1] for i, p in enumerate(pairs) if jaccard(*p) < 0.8]
    high = [got[2 * i] == got[2 * i + 1] for i, p in enumerate(pairs) if jaccard(*p) >= 0.8]
    assert len(low) > 100 and not any(low) and sum(high) >= 0.9 * len(high)
    assert 0.5 < min(jaccard(*p) for p in pairs) < 0.6


def test_near_copies_are_found_whatever_the_edit(spark):
    rnd = random.Random(9)
    kinds = [("appended", 0.1), ("appended", 0.24), ("cut", 0.1), ("cut", 0.19), ("block", 0.05), ("block", 0.09), ("scattered", 0.02)]
    pairs = [edited(rnd, n, edit, share) for edit, share in kinds for n in (100, 250, 600) for _ in range(10)]
    pairs = [p for p in pairs if jaccard(*p) >= 0.8]
    got = similar(spark, [t for p in pairs for t in p])
    assert len(pairs) > 150 and sum(got[2 * i] != got[2 * i + 1] for i in range(len(pairs))) <= 1


def test_a_repeated_line_does_not_join_texts(spark):
    line = "the very same line of eight words again "
    own = [" ".join(f"{c}{i}" for i in range(200)) for c in "ab"]
    assert similar(spark, [line * 100 + own[0], line * 100 + own[1], line * 90 + own[0]]) == [0, 1, 0]


def test_wide_ids_beside_nulls(spark):
    a, b = ("one text of some words that others copy", "a second text that has its own words")
    more = [(WIDE[1], a), (WIDE[2], a), (None, b), (WIDE[0], "words of the smallest id of all")]
    assert rows(simhash.keep_one(docs(spark, more).coalesce(1)), "doc_id") == sorted([(WIDE[1],), (None,), (WIDE[0],)], key=str)
    assert rows(simhash.assign_groups(docs(spark, more).coalesce(1)), "doc_id", "component_id") == sorted([(WIDE[1], WIDE[1]), (WIDE[2], WIDE[1]), (None, None), (WIDE[0], WIDE[0])], key=str)


def family(n, seed, low, high, parts):
    """``n`` copies of one text with ``low`` to ``high`` words changed; each appendix stands in every second, fourth, ... run of them."""
    rnd = random.Random(seed)
    base, out = [f"b{i}" for i in range(200)], []
    for i in range(n):
        w = base.copy()
        for j in rnd.sample(range(200), rnd.randint(low, high)):
            w[j] = f"x{rnd.randrange(10**9)}"
        out.append(" ".join(w + [f"{p}{k}" for p in range(parts) if i >> p & 1 for k in range(12)]))
    return out


@pytest.mark.parametrize("seed,low,high,parts", [(1, 4, 13, 1), (2, 1, 6, 3)])
def test_copies_with_shared_passages_equal_brute_force(spark, seed, low, high, parts):
    texts = family(240, seed, low, high, parts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    got = similar(spark, texts)
    assert sum(got[i] != root(i) for i in range(len(texts))) <= 1


def test_work_in_a_group_grows_with_its_rows(spark, monkeypatch):
    """Copies with a shared appendix that are hardly ever linked: few pairs are compared, a copy is in a bounded number of rows.

    A copy is around one pivot for each of its bands at most, and has a row for each shingle in which it differs from that.
    """
    real, made = simhash.stored, {}

    def counted(df, label):
        out = real(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    for n in (400, 1600):
        made = {}
        simhash.similar_groups(docs(spark, family(n, 1, 4, 13, 1)))
        assert made["pairs"] < n / 20 and made["apart"] <= simhash.BANDS * n
        assert max(made.pop("often"), made.pop("places")) <= 200 * n and max(made.values()) <= simhash.BANDS * n


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rnd = random.Random(4)
    sets = [([rnd.getrandbits(62) for _ in range(40)], [rnd.getrandbits(62) for _ in range(rnd.randrange(60))]) for _ in range(50)]
    df = spark.createDataFrame([(a, a[: rnd.randrange(40)] + b) for a, b in sets], "x array<long>, y array<long>")
    df = df.withColumns({c: simhash.odd_sketch(F.col(d), F.lit(8)) for c, d in (("sx", "x"), ("sy", "y"))})
    for r in df.select("x", "y", simhash.bits_apart("sx", "sy").alias("bits")).collect():
        n = len(set(r.x) ^ set(r.y))
        assert r.bits <= n and r.bits >= 0.7 * n


def test_similar_groups_come_from_the_simhash_index_too(spark, monkeypatch):
    """Without bands, texts within two bits are grouped if their similarity is 0.8, and no others."""
    monkeypatch.setattr(simhash, "BANDS", 0)
    rnd = random.Random(12)
    line = "a line that is in it time and again "
    pairs = [edited(rnd, 900, "scattered", 0.002) for _ in range(30)] + [(line * 400 + "one two three four five", line * 400 + "six seven eight nine ten eleven twelve")]
    pairs.append(tuple(t.replace(" ", p, 9) for t, p in ((pairs[0][0], ". "), (pairs[0][1], " - "))))  # sets as before, other words for the index
    texts = [t for p in pairs for t in p]
    comp = brute_components({i: brute_print(t) for i, t in enumerate(texts)})
    got = similar(spark, texts)
    linked = [i for i, p in enumerate(pairs) if comp[2 * i] == comp[2 * i + 1]]
    assert 5 < len(linked) < 31 and jaccard(*pairs[30]) < 0.8 and comp[60] == comp[61] and got[60] != got[61]
    assert all((got[2 * i] == got[2 * i + 1]) == (i in linked) for i in range(1, 30))
    assert got[62] == got[0] and got[63] == got[1]
