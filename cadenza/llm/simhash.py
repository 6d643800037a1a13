"""SimHash near-duplicates by multi-index hashing.

``near_duplicates`` links 64-bit fingerprints of word shingles within two bits, exactly.

``similar_groups`` finds texts with a Jaccard similarity of 0.8 and more over their sets of five-word shingles. Its first
candidates are those of the same index: every text has its fingerprint, and texts that links of two bits join are compared. At
0.8, five-word SimHashes differ in about 10 of 64 bits whatever the edit, and two-word ones do so for appended, cut or
replaced passages: too many for small balls. Pairs beyond the balls come from tables of minima: equal least hashes of the
set in all four places of any of 20 bands. A pair at 0.8 meets with a chance of 1 - (1 - 0.8^4)^20, or 99.997 %, whatever
was edited. Each link of either is then verified by the exact similarity of the whole sets before components are built.

Edge cases: null and empty texts have no words and share fingerprint zero, so they form one group. Rows that repeat a
doc_id are rows of their own, whose group may differ if their texts do. A null doc_id never becomes a component's label
unless all ids in it are null. ``keep_one`` keeps one row of each group, also where rows are equal in every column. Only
``doc_id`` and ``text`` are read, so other columns may have any name. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import components, row_id, small_batches, stored
from cadenza.llm.filters import KeyFilter
from cadenza.llm.words import BASE, mix, slices, split_words

SEED = 42
BITS = 64
SEGMENTS, WIDTH, RADIUS = 4, 16, 2
BANDS, PLACES = 20, 4  # tables of similar_groups, and the minima that a key of each holds
FIRST = 4  # bands that are compared before all others
SKETCH = 64  # longs of the sketch of a set at most; larger sets are told apart less before they are compared


def signed(x: int) -> int:
    """An unsigned 64-bit number as a long."""
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(text: str | None, k: int) -> int:
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(w) - k + 1))
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 65_536):  # bounded memory for very long texts
        part = h[lo : lo + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int) -> Column:
    """64-bit SimHash, as a long, of all ``shingle``-word shingles (XXH64, seed 42) of the ASCII-lower-cased text."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, shingle) for t in texts], dtype="int64")

    return udf(text)


def dealt(fps: DataFrame, per_task: int = 10_000) -> DataFrame:
    """``fps`` in tasks of about ``per_task`` rows: each row is about to become many."""
    return fps.repartition(max(1, fps.count() // per_task))


def probes(fps: DataFrame) -> DataFrame:
    """(fp, key): the keys under which each fingerprint looks for others in the segment tables.

    In the table of segment j these are its own key there and, for the segments before j, the Hamming ball of radius
    one: the key with one bit changed. Only bits that the fingerprint lacks are set, as of two fingerprints that differ
    in a bit one lacks it and looks for the other.
    """
    flips = F.array(*[F.struct(F.lit(1 << i).alias("flip"), F.lit(j).alias("j")) for j in range(SEGMENTS) for i in range(j * WIDTH)], *[F.struct(F.lit(0).cast("long").alias("flip"), F.lit(j).alias("j")) for j in range(SEGMENTS)])
    each = dealt(fps).select("fp", F.explode(flips).alias("x")).where(F.col("fp").bitwiseAND(F.col("x.flip")) == 0)
    masks = F.array(*[F.lit(signed(((1 << BITS) - 1) ^ ((1 << WIDTH) - 1) << j * WIDTH)) for j in range(SEGMENTS)])
    return each.select("fp", F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(F.get(masks, F.col("x.j"))).alias("key"))


def tables(fps: DataFrame) -> DataFrame:
    """(other, key): the segment tables. Table j holds each fingerprint under its other three segments, 48 bits."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(((1 << BITS) - 1) ^ ((1 << WIDTH) - 1) << j * WIDTH))) for j in range(SEGMENTS)])
    return fps.select(F.col("fp").alias("other"), F.explode(keys).alias("key"))


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) of all fingerprints within two bits, by a multi-index over four segments of 16 bits.

    Two such fingerprints differ in two segments at most. Let j be the last of them: in the segments before j they
    differ in one bit at most, after it in none, so one finds the other in table j by a ball of radius one. What a look-up
    fetches may differ in any of the 16 bits of segment j; the join's condition is the complete distance. A bucket holds at most
    65,536 fingerprints, all different, however many rows have one of them. Spark takes exploded tables for smaller than
    they are, so the join is told not to broadcast.
    """
    found = probes(fps).join(tables(fps).hint("merge"), "key").where("fp <> other")
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("other").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(prints, groups)``: (doc_id, fp) for every row, and (fp, component_id, group_rows) for every fingerprint.

    ``component_id`` is the smallest doc_id that links of two bits or less reach. Fingerprints are grouped before they
    are linked, so copies, however many, count once.
    """
    small_batches(docs.sparkSession)
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "prints")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    return prints, labelled(fps, "fp", stored(components(ball_links(fps)), "comps")).select("fp", "component_id", "group_rows")


def labelled(fps: DataFrame, node: str, comps: DataFrame) -> DataFrame:
    """``fps`` with ``component_id`` (smallest ``first`` of the component) and ``group_rows``."""
    known = fps.join(comps.withColumnRenamed("node", node), node, "left").withColumn("comp", F.coalesce("comp", node))
    tops = known.groupBy("comp").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_rows"))
    return known.join(stored(tops, "tops"), "comp").drop("comp")  # stored, so that the join can split a hot component


def five_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct five-word shingles of each text, one text after the other, and how many each has.

    Words are runs of letters and digits. A text with fewer than five words has one shingle, the whole of it.
    """
    w = split_words([(t or "").lower() for t in texts])
    words = np.diff(w.first)
    h, inside = w.shingles(5)
    h, doc = h[inside], w.doc[: len(inside)][inside]
    short = np.flatnonzero((words > 0) & (words < 5))
    whole = [mix(np.bitwise_xor.reduce(mix(w.hash[w.first[i] : w.first[i + 1]] + np.arange(words[i], dtype=np.uint64)), keepdims=True))[0] for i in short]
    h, doc = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def wide_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, f1, f2, f5, keys, fp): a row's shingle set by 128 bits and its size, all zero without words, its keys and SimHash.

    Equal ``f1``, ``f2`` (order-free hashes of the set) and ``f5`` (its number of five-word shingles) are equal sets. Only texts
    go to Python, so ids stay exact whatever nulls stand beside them.
    """
    odd = mix(np.arange(1, BANDS * PLACES + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)

    def prints(texts: list[str | None]) -> pd.DataFrame:
        h, n = five_words(texts)
        some = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[some]
        out = {c: np.zeros(len(n), np.uint64) for c in ("f1", "f2")}
        keys = np.zeros((len(n), BANDS), np.uint64)
        if len(some):
            for i, c in enumerate(out):
                out[c][some] = mix(np.add.reduceat(mix(h + np.uint64(SEED + i)), at))
            for i in range(BANDS):
                key = np.full(len(some), i, np.uint64)
                for m in odd[i * PLACES : (i + 1) * PLACES]:
                    key = mix(key * BASE + np.minimum.reduceat(h * m, at))
                keys[some, i] = key
        rows = [k if c else k[:0] for k, c in zip(keys.view(np.int64), n, strict=True)]
        fp = np.array([_fingerprint(t, 3) for t in texts], np.int64)
        return pd.DataFrame({"f1": out["f1"].view(np.int64), "f2": out["f2"].view(np.int64), "f5": n, "keys": rows, "fp": fp})

    @F.pandas_udf("f1 long, f2 long, f5 long, keys array<long>, fp long")
    def udf(texts: pd.Series) -> pd.DataFrame:
        every = list(texts)
        return pd.concat([prints([]), *(prints(every[lo:hi]) for lo, hi in slices(every, 250_000))], ignore_index=True).astype({"f1": "int64", "f2": "int64", "f5": "int64", "fp": "int64"})

    return docs.select("doc_id", row_id().alias("rid"), udf("text").alias("_p")).select("doc_id", "rid", "_p.*")


def relabelled(df: DataFrame, cls: str, edges: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the component of its class under edges (a, b) between classes."""
    joined = stored(components(edges), "classes").withColumnsRenamed({"node": cls, "comp": out})
    return df.join(joined, cls, "left").withColumn(out, F.coalesce(out, cls))


def overlaps(pairs: DataFrame, sets: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b, ...) of nodes with their shingles ``_sa`` and ``_sb``, how many they share (``both``), and whether ``linked``.

    ``sets`` has the sets of a, and of b as well unless ``others`` does.
    Linked are sets with an exact Jaccard similarity of 0.8 or more: n / (a + b - n) >= 4 / 5.
    """
    one, two = (x.select(F.col("node").alias(c), F.col("shingles").alias(f"_s{c}")) for x, c in ((sets, "a"), (others or sets, "b")))
    met = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("_sa", "_sb")))
    return met.withColumn("linked", F.col("both") * 9 >= (F.size("_sa") + F.size("_sb")) * 4)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles), stored: the distinct five-word shingles of the text of each row that ``wanted`` (rid, node) names.

    Texts are read again, and only those wanted are shuffled. A text with fewer words than five has one shingle.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in slices(list(b["text"]), 250_000):
                h, n = five_words(list(b["text"].iloc[lo:hi]))
                yield pd.DataFrame({"node": b["node"].iloc[lo:hi].array, "shingles": np.split(h.view(np.int64), np.cumsum(n)[:-1])})

    texts = docs.select(row_id().alias("rid"), "text").where(KeyFilter(wanted.select("rid")).might_hold(F.col("rid")))
    found = stored(texts.join(wanted, "rid").select("node", "text").mapInPandas(task, "node long, shingles array<long>"), "shingles")
    return stored(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # a row may be repeated


def centres(around: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, centre): of the members (p, a, na) of each group the one closest to the shingles that over half of the group hold."""
    sizes = stored(around.groupBy("p").agg(F.count(F.lit(1)).alias("m")), "sizes")
    held = around.join(sets, F.col("a") == F.col("node")).select("p", F.explode("shingles").alias("s")).groupBy("p", "s").agg(F.count(F.lit(1)).alias("c"))
    core = held.join(sizes, "p").where("c * 2 > m").groupBy(F.col("p").alias("node")).agg(F.collect_list("s").alias("shingles"))
    met = overlaps(around.withColumn("b", F.col("p")), sets, stored(core, "core"))
    return met.groupBy("p").agg(F.max(F.struct(F.col("both") * 2 - F.col("na"), "a"))["a"].alias("centre"))


NEAR = "least(na, nb) * 5 >= greatest(na, nb) * 4"  # sets of other sizes can't be alike


def joined_classes(classes: DataFrame, links: DataFrame, cls: str, out: str) -> DataFrame:
    """``classes`` (node, ``cls``, ...) with ``out``, after links (a, b) of nodes."""
    one, two = (classes.select(F.col("node").alias(k), F.col(cls).alias(f"c{k}")) for k in ("a", "b"))
    edges = links.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return stored(relabelled(classes, cls, edges, out), out)


def ball_members(marks: DataFrame) -> DataFrame:
    """(node, f5, lo), stored: the nodes that share a component of fingerprints (node, f5, fp) with others, and the smallest of it.

    Links are those of two bits and less, from the segment tables. A node has as many fingerprints as different texts.
    """
    found = stored(relabelled(marks, "fp", ball_links(stored(marks.select("fp").distinct(), "fps")), "ball"), "balls")
    shared = found.groupBy("ball").agg(F.min(F.struct("node", "f5")).alias("lo"), F.max("node").alias("hi")).where("lo.node <> hi").select("ball", "lo")
    return stored(found.join(stored(shared, "shared"), "ball").select("node", "f5", "lo").distinct(), "members")


def first_classes(fps: DataFrame, marks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, sets, members)``: a class ``c1`` for every node, the sets of those in a component of SimHashes or a bucket of the first bands.

    Each member of a component or bucket is compared with the smallest of it alone, which makes one class of most of a group of
    copies. Others of its pairs are left to the bands.
    """
    body = F.struct("node", "f5")
    near = ball_members(marks)
    opening = dealt(fps, 50_000).select("node", "rid", "f5", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    shared = opening.groupBy("key").agg(F.min(body).alias("lo"), F.max("node").alias("hi")).where("lo.node <> hi").select("key", "lo")
    members = stored(opening.join(stored(shared, "shared"), "key"), "members")
    seen = stored(members.select("node").unionByName(near.select("node")).distinct(), "seen")
    sets = shingle_sets(docs, fps.select("rid", "node").join(seen, "node", "left_semi"))
    star = members.select("node", "f5", "lo").unionByName(near).select(F.col("node").alias("a"), F.col("lo.node").alias("b"), F.col("f5").alias("na"), F.col("lo.f5").alias("nb"))
    star = stored(star.where(f"a <> b and {NEAR}").select("a", "b").distinct(), "star")
    nodes = stored(relabelled(fps, "node", overlaps(star, sets).where("linked").select("a", "b"), "c1"), "nodes")
    return nodes, sets, seen


def mixed_buckets(nodes: DataFrame) -> DataFrame:
    """(key, n, node, rid, f5, c1): the members of the buckets, of all bands, that still mix classes; n rows each."""
    every = dealt(nodes).select("node", "rid", "f5", "c1", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    shared = stored(shared, "shared")
    return stored(every.where(KeyFilter(shared.select("key")).might_hold(F.col("key"))).join(shared, "key"), "mixed")


def most_common(rows: DataFrame, by: str, of: str) -> DataFrame:
    """(``by``, ``of``): the value of ``of`` that most rows of each ``by`` have, the largest on ties."""
    return rows.groupBy(by, of).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max(F.struct("n", of))[of].alias(of))


def pivot_groups(mixed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(around, links)``: groups (p, a, na) of members around a pivot, any two of a bucket in one; links (a, b) found meanwhile.

    A bucket's first pivot is the member with the most bucket neighbours. Buckets whose members share most with the same
    pivot form a group, whose centre is its pivot from then on; groups whose members share more with another centre join that.
    """
    near = stored(mixed.groupBy("node").agg(F.sum("n").alias("near")), "near")
    pivots = stored(mixed.join(near, "node").groupBy("key").agg(F.max(F.struct("near", "node"))["node"].alias("p")), "pivots")
    around = stored(mixed.join(pivots, "key").select("key", "p", F.col("node").alias("a"), F.col("f5").alias("na")), "around")
    pairs = around.where("p <> a").select("a", F.col("p").alias("b"), "na").distinct()
    met = stored(overlaps(pairs, sets).select("a", "b", "both", "linked"), "met")
    best = stored(met.groupBy("a").agg(F.max(F.struct("both", "b"))["b"].alias("best")), "best")
    mode = most_common(around.join(best, "a", "left").select("key", F.coalesce("best", "a").alias("p")), "key", "p")
    around = stored(around.drop("p").join(stored(mode, "mode"), "key").select("p", "a", "na").distinct(), "around")
    middle = stored(centres(around, sets), "middle")
    around = stored(around.join(middle, "p", "left").select(F.coalesce("centre", "p").alias("p"), "a", "na").distinct(), "around")
    close = stored(overlaps(around.withColumn("b", F.col("p")), sets).select("a", "p", (F.col("both") * 2 - F.col("na")).alias("both")), "close")
    best = stored(close.groupBy("a").agg(F.max(F.struct("both", "p"))["p"].alias("to")), "best")  # centres of one group of copies give way to the best
    mode = most_common(around.join(best, "a").select("p", "to"), "p", "to")
    around = stored(around.join(stored(mode, "mode"), "p").select(F.col("to").alias("p"), "a", "na").distinct(), "around")
    return around, met.where("linked").select("a", "b")


def odd_sketch(items: Column, words: Column) -> Column:
    """64 ``words`` bits, each the parity of the items that hash to it; ``words`` is a power of two.

    Two sketches differ in no more bits than their sets do in items, as each item turns one bit.
    """

    @F.pandas_udf("array<long>")
    def udf(every: pd.Series, many: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(every, many, strict=True):
            bits = mix(np.asarray(x, np.int64).view(np.uint64)) & np.uint64(64 * n - 1)
            odd = np.bincount(bits.astype(np.int64), minlength=64 * n).astype(np.uint8) & 1
            out.append(np.packbits(odd).view(np.int64))
        return pd.Series(out)

    return udf(items, words)


def bits_apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def differences(around: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, a, na, linked, d, apart, sketch), stored: the shingles that only one of member and pivot has, ``d`` in number."""
    met = overlaps(around.withColumn("b", F.col("p")), sets)
    apart = F.concat(F.array_except("_sa", "_sb"), F.array_except("_sb", "_sa"))
    words = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("_sb") / 24, F.lit(1))))).cast("int")  # over two bits a shingle
    known = met.select("p", "a", "na", "linked", apart.alias("apart"), F.least(words, F.lit(SKETCH)).alias("words"))
    return stored(known.withColumns({"d": F.size("apart").cast("long"), "sketch": odd_sketch(F.col("apart"), F.col("words"))}).drop("words"), "apart")


def certain_links(known: DataFrame) -> DataFrame:
    """(a, b): links to the member of each group that is closest to the pivot, of those that no comparison is needed for.

    Members x and y differ by d(x) + d(y) shingles at most, and sets that differ by no more than (|x| + |y|) / 9 are linked. If
    that holds for any two members it holds for each of them with the member of least 9 d - n, so these links join all such pairs.
    """
    low = F.col("d") * 9 - F.col("na")
    first = stored(known.groupBy("p").agg(F.min(F.struct(low.alias("low"), F.col("a").alias("b"))).alias("first")), "first")
    return known.join(first, "p").where((low + F.col("first.low") <= 0) & (F.col("a") != F.col("first.b"))).select("a", F.col("first.b").alias("b"))


def doubtful_pairs(known: DataFrame) -> DataFrame:
    """(a, b), stored: pairs of members of different classes (ca) of a group that may be linked and are not by ``certain_links``.

    Let D(x) be the shingles in which x differs from the pivot. Then x and y differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so a link needs
    o = (|D(x)| + |D(y)| - t) / 2 of them in common, t = (|x| + |y|) / 9. All D are in one order, those first that fewest members
    have. If the first common one has places i and j, |D(x)| - i and |D(y)| - j are at least o, and with that i + j is at most t. As
    sizes differ by a quarter at most, one place is within an eighth of its set's size and the other within a quarter.
    Shingles that many members share, such as an appendix of a part of the group, come late: within an eighth they stand in those
    sets only that have few others, and such sets are so close to each other that they are linked and of one class. Pairs that share
    a shingle are left out where their sketches alone differ in more than t bits.
    """
    each = known.select("p", "a", "ca", "na", "d", "sketch", F.explode("apart").alias("s"))
    often = stored(each.groupBy("p", "s").agg(F.count(F.lit(1)).alias("often"), F.min("ca").alias("lo"), F.max("ca").alias("hi")), "often")
    mixed = each.join(often, ["p", "s"]).where("often > 1")
    own = Window.partitionBy("p", "a")
    mixed = mixed.withColumn("at", F.row_number().over(own.orderBy("often", "s")) - 1 + F.col("d") - F.count(F.lit(1)).over(own))
    mixed = stored(mixed.where("lo <> hi and 4 * at <= na").select("p", "s", "a", "ca", "na", "d", "at", "sketch"), "places")
    short = mixed.where("8 * at <= na")
    long = mixed.select("p", "s", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("na").alias("nb"), F.col("d").alias("db"), F.col("at").alias("bt"), F.col("sketch").alias("other"))
    least = "9 * (d + db) - na - nb"
    met = short.join(long.hint("merge"), ["p", "s"]).where(f"ca <> cb and {NEAR} and 18 * (d - at) >= {least} and 18 * (db - bt) >= {least}").where(bits_apart("sketch", "other") * 9 <= F.col("na") + F.col("nb"))
    return stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def set_classes(fps: DataFrame, marks: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, comp): classes of shingle sets (node, rid, f5, keys) that links join; a link has 0.8, and its sets share a component of
    their SimHashes ``marks`` (node, f5, fp) or a key.

    Buckets are joined to their members only where that can add a link, and no bucket is paired with itself: members are
    compared with the smallest of their bucket, then, where buckets still mix classes, with the pivot of a group; what two members
    share beyond that decides which few pairs are left. Those are verified on the whole sets. No link is lost.
    """
    nodes, sets, seen = first_classes(fps, marks, docs)
    mixed = mixed_buckets(nodes)
    more = mixed.select("rid", "node").distinct().join(seen, "node", "left_anti")
    sets = sets.unionByName(shingle_sets(docs, stored(more, "more")))
    around, links = pivot_groups(mixed, sets)
    known = differences(around, sets)
    links = links.unionByName(known.where("linked and a <> p").select("a", F.col("p").alias("b"))).unionByName(certain_links(known))
    classes = stored(nodes.select("node", "c1").join(mixed.select("node").distinct(), "node", "left_semi"), "some")
    classes = joined_classes(classes, links, "c1", "c2")

    known = known.join(classes.select(F.col("node").alias("a"), F.col("c2").alias("ca")), "a")
    still = known.groupBy("p").agg(F.min("ca").alias("lo"), F.max("ca").alias("hi")).where("lo <> hi").select("p")
    pairs = doubtful_pairs(stored(known.join(stored(still, "still"), "p"), "known"))
    classes = joined_classes(classes, overlaps(pairs, sets).where("linked").select("a", "b"), "c2", "comp")
    ends = stored(classes.select("c1", "comp").distinct(), "ends")
    return nodes.select("node", "c1").join(ends, "c1", "left").select("node", F.coalesce("comp", "c1").alias("comp"))


def similar_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(prints, groups)``: (doc_id, rid, f1, f2, f5, fp) of every row, and (f1, f2, f5, component_id, best, group_rows).

    ``best`` is the rid of the component's first row: the smallest doc_id, nulls last, then the smallest rid.
    """
    small_batches(docs.sparkSession)
    prints = stored(wide_prints(docs), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    fps = prints.groupBy("f1", "f2", "f5").agg(first, F.count(F.lit(1)).alias("n"))
    fps = stored(fps.withColumn("node", F.xxhash64("f1", "f2", "f5")), "fps")
    named = prints.select("rid", "f5", "keys").join(fps.select("node", F.col("first.rid").alias("rid")), "rid").dropDuplicates(["node"])
    marks = stored(prints.select(F.xxhash64("f1", "f2", "f5").alias("node"), "f5", "fp").distinct(), "marks")
    comps = stored(set_classes(stored(named, "named"), marks, docs), "comps")
    groups = labelled(fps, "node", comps)
    return prints, groups.select("f1", "f2", "f5", F.col("component_id.doc_id").alias("component_id"), F.col("component_id.rid").alias("best"), "group_rows")


def assign_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, group_rows), one row per input row."""
    prints, groups = near_duplicates(docs, shingle)
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id", "group_rows")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, all columns kept: that of the smallest doc_id, nulls last.

    Of rows with one doc_id in a group the smallest hash of the text stays, and of rows equal in both one row. Only rows that
    may have to go are shuffled, after a Bloom filter.
    """
    prints, groups = similar_groups(docs)
    rids = prints.groupBy("rid", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    known = stored(rids.join(groups.select(F.col("best").alias("rid"), F.lit(True).alias("stays")), "rid", "left"), "known")
    drop = stored(known.where("stays is null").select(F.col("rid").alias("_cz_drop"), F.col("doc_id").alias("_cz_id")), "drop")
    doubt = KeyFilter(known.where("stays is null or times > 1").select("rid")).might_hold(row_id())
    rows = docs.where(doubt).select(row_id().alias("_cz_rid"), F.struct(*docs.columns).alias("_cz_row"))
    left = rows.join(drop, (F.col("_cz_rid") == F.col("_cz_drop")) & F.col("_cz_row.doc_id").eqNullSafe(F.col("_cz_id")), "left_anti")
    one = left.groupBy("_cz_rid", F.col("_cz_row.doc_id").alias("_cz_id")).agg(F.min_by("_cz_row", F.xxhash64(F.to_json("_cz_row"))).alias("_cz_row")).select("_cz_row.*")
    return docs.where(~doubt).unionByName(one)
