"""Benchmark decontamination by SimHash of item-sized windows.

An item of m words is compared with windows of m words, and with the whole of a text that is shorter. Both are bags of five-word shingles (the whole item where it
has fewer words) weighted by their counts; similarity is the weighted Jaccard of the bags. Windows get a SimHash; a
multi-index over four 16-bit blocks with Hamming balls of radius three guarantees every window within 15 bits of an
item of its size; the exact similarity then verifies each candidate.

Windows are taken where they can matter: a window of s shingles needs 2 s t / (1 + t) shingles in common with an item
to reach similarity t, so windows with fewer shingles known to items of their size are not fingerprinted. That bound
is exact.

Edge cases: words are runs of letters and digits, lower-cased; null texts are empty and never match, nor do items
without words. Ids go through Python as strings, so they stay exact beside nulls. Rows equal in id and text are one document, others that repeat an id each count; items and rows with a null
id are compared like any other. Texts are read whole. Only doc_id, text, item_id
are read. An empty benchmark or document table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import row_id, small_batches, stored
from cadenza.llm.filters import KeyFilter
from cadenza.llm.words import mix, slices, split_words

K = 5
BLOCKS, WIDTH, BALL = 4, 16, 3
RADIUS = BLOCKS * (BALL + 1) - 1
MOST_SHINGLES = 2_000_000  # shingles sent to every task in one pass: 16 MB and a 4 MB bit table
TABLE_BITS = 25


def simhash(counts: np.ndarray, s: int) -> np.ndarray:
    """Fingerprints of rows of 64 bit counts over ``s`` shingles."""
    return np.packbits(counts * 2 > s, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def bit_sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32, out=out[1:])
    return out


def need(s: int, similarity: float, n: int | None = None) -> int:
    """Shingles that a window of n (s unless given) and an item of s need in common."""
    return max(1, int(np.ceil((s + (s if n is None else n)) * similarity / (1 + similarity) - 1e-9)))


def describe_items(items: DataFrame) -> DataFrame:
    """(item_id, ik, m, fp, shingles): the item's number, size in words, SimHash and sorted shingle hashes of each item with words."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, out = split_words([(t or "").lower() for t in b["text"]]), []
            for i, (item, ik) in enumerate(zip(b["item_id"], b["ik"], strict=True)):
                m = int(w.first[i + 1] - w.first[i])
                if m:
                    k = min(K, m)
                    h, _ = w.shingles(k)
                    h = h[w.first[i] : w.first[i] + m - k + 1]
                    fp = simhash(bit_sums(h)[-1:], len(h))[0]
                    out.append((item, ik, m, fp, np.sort(h.view(np.int64))))
            yield pd.DataFrame(out, columns=["item_id", "ik", "m", "fp", "shingles"])

    numbered = items.select(F.col("item_id").cast("string").alias("item_id"), F.monotonically_increasing_id().alias("ik"), "text")
    found = numbered.mapInPandas(task, "item_id string, ik long, m int, fp long, shingles array<long>")
    return found.withColumn("item_id", F.col("item_id").cast("long"))


def windows(docs: DataFrame, shingles: np.ndarray, masks: np.ndarray, sizes: list[int], similarity: float) -> DataFrame:
    """(doc_id, rid, start, m, fp, wkey, shingles): windows of the sizes that hold enough of the shingles of items of that size.

    ``shingles`` is sorted; bit i % 64 of its mask says that an item of ``sizes[i]`` words holds a shingle. With more
    than 64 sizes a bit stands for several, which only lets more windows pass.
    """
    table = np.zeros(1 << TABLE_BITS >> 3, np.uint8)
    slot = (shingles & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    np.bitwise_or.at(table, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast((shingles, masks, table, sizes))

    def known(h: np.ndarray) -> np.ndarray:
        """Masks of the shingles; 0 for those that no item holds."""
        every, mask, bits, _ = shared.value
        at = (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        maybe = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        pos = np.minimum(np.searchsorted(every, h[maybe]), len(every) - 1)
        out = np.zeros(len(h), np.uint64)
        out[maybe] = np.where(every[pos] == h[maybe], mask[pos], np.uint64(0))
        return out

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_k: dict[int, list[tuple[int, int]]] = {}
        for i, m in enumerate(shared.value[3]):
            by_k.setdefault(min(K, m), []).append((m, i % 64))
        places = np.arange(64, dtype=np.uint64)
        for b in batches:
            for lo, hi in slices(list(b["text"]), 500_000):
                w = split_words([(t or "").lower() for t in b["text"].iloc[lo:hi]])
                ids, rids = b["doc_id"].iloc[lo:hi].to_numpy(), b["rid"].iloc[lo:hi].to_numpy()
                out: list[tuple] = []
                for k, ms in by_k.items():
                    h, same = w.shingles(k)
                    mask = np.where(same, known(h), np.uint64(0))
                    hits = np.flatnonzero(mask)
                    per = np.bincount(w.doc[hits], minlength=hi - lo)
                    for d in np.flatnonzero(per >= need(ms[0][0] - k + 1, similarity, 0)):
                        first, n = w.first[d], w.first[d + 1] - w.first[d] - k + 1
                        g, own = h[first : first + n], mask[first : first + n]
                        count = (own[own > 0][:, None] >> places & np.uint64(1)).sum(axis=0)
                        for m, bit in ms:
                            s = m - k + 1
                            if n < s * similarity:
                                break
                            least = need(s, similarity, min(n, s))
                            if count[bit] < least:
                                continue
                            s = min(n, s)  # a shorter text is one window
                            c = np.concatenate([[0], np.cumsum((own >> np.uint64(bit) & np.uint64(1)).astype(np.int64))])
                            for at in np.flatnonzero(c[s:] - c[:-s] >= least):
                                x = g[at : at + s]
                                fp = simhash(np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)[None], s)[0]
                                x = np.sort(x)
                                with np.errstate(over="ignore"):
                                    key = mix(np.add.reduce(mix(x + np.arange(s, dtype=np.uint64)), keepdims=True)).view(np.int64)[0]
                                out.append((ids[d], rids[d], int(at), m, fp, key, x.view(np.int64)))
                                if len(out) >= 20_000:
                                    yield frame(out)
                                    out = []
                if out:
                    yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "rid", "start", "m", "fp", "wkey", "shingles"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), row_id().alias("rid"), "text")
    found = rows.mapInPandas(task, "doc_id string, rid long, start int, m int, fp long, wkey long, shingles array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def ball(width: int, radius: int) -> list[int]:
    """All ``width``-bit masks with ``radius`` bits set at most."""
    out, last = [0], [0]
    for _ in range(radius):
        last = sorted({x | 1 << i for x in last for i in range(width) if not x >> i & 1})
        out += last
    return out


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def candidates(contents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of window contents and items of one size within ``RADIUS`` bits: (m, wkey, ik, a, b)."""
    near = F.array(*[F.lit(x) for x in ball(WIDTH, BALL)])
    index = items.select("ik", F.col("m").alias("im"), F.col("fp").alias("ifp"), F.col("shingles").alias("b"))
    keys = index.select("ik", "im", "ifp", F.explode(near).alias("flip"))
    keys = keys.select("ik", "im", "ifp", F.posexplode(F.array(*[block(F.col("ifp"), i).bitwiseXOR(F.col("flip")) for i in range(BLOCKS)])).alias("i", "v"))
    probe = contents.select("m", "wkey", "fp", F.posexplode(F.array(*[block(F.col("fp"), i) for i in range(BLOCKS)])).alias("i", "v"))
    keys = keys.hint("merge")  # the balls are many rows more than Spark expects of so few items
    met = probe.join(keys, (probe["m"] == keys["im"]) & (probe["i"] == keys["i"]) & (probe["v"] == keys["v"]))
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("m", "wkey", "ik").distinct()
    pairs = met.join(contents.select("m", "wkey", F.col("shingles").alias("a")), ["m", "wkey"])
    return pairs.join(index.select("ik", F.col("im").alias("m"), "b"), ["ik", "m"])


def bag_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two bags, as arrays with repeats."""
    u, cu = np.unique(x, return_counts=True)
    v, cv = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(cu[i], cv[j]).sum())
    return both / (len(x) + len(y) - both)


def weighted_jaccard(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bag_similarity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return udf(a, b)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(doc_id, rid, item_id, ik, start, n_words, similarity): each window of a document that matches an item of its size.

    ``rid`` is the hash of a document's id and text, ``ik`` a number of the item.
    A benchmark with more than ``most_shingles`` shingles is taken in blocks of items, one pass over the texts each.
    Windows with equal contents are compared once, however many documents share a passage.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = stored(describe_items(benchmark), "items")
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n_blocks = -(-total // most_shingles) if total else 0
    found = None
    for i in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("ik"), F.lit(n_blocks)) == i)
        sizes = sorted(r["m"] for r in part.select("m").distinct().collect())
        if not sizes:
            continue
        bit = F.create_map(*[F.lit(x) for i, m in enumerate(sizes) for x in (m, (1 << i % 64) - (1 << 64 if i % 64 == 63 else 0))])
        known = part.select(F.explode("shingles").alias("h"), bit[F.col("m")].cast("long").alias("bit")).groupBy("h").agg(F.bit_or("bit").alias("mask")).toPandas()
        h, mask = (known[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "mask"))
        order = np.argsort(h)
        wins = stored(windows(docs, h[order], mask[order], sizes, similarity), "windows")
        contents = stored(wins.groupBy("m", "wkey").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles")), "contents")
        pairs = candidates(contents, part).withColumn("similarity", weighted_jaccard("a", "b")).where(F.col("similarity") >= similarity)
        pairs = stored(pairs.select("m", "wkey", "ik", "similarity"), "matches").join(part.select("ik", "item_id"), "ik")
        got = wins.select("doc_id", "rid", "start", "m", "wkey").join(pairs, ["m", "wkey"]).select("doc_id", "rid", "item_id", "ik", "start", F.col("m").alias("n_words"), "similarity")
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], "doc_id long, rid long, item_id long, ik long, start int, n_words int, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per contaminated document: doc_id, rid, item_ids (sorted, without nulls), n_items, max_similarity, first_word."""
    per_item = leaks(docs, benchmark, similarity).groupBy("doc_id", "rid", "ik").agg(F.first("item_id").alias("item_id"), F.max("similarity").alias("s"), F.min("start").alias("f"))
    return per_item.groupBy("doc_id", "rid").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_items"), F.max("s").alias("max_similarity"), F.min("f").alias("first_word")
    )


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the contaminated rows; all columns kept. Only rows that a Bloom filter can't clear are shuffled."""
    bad = stored(contaminated(docs, benchmark, similarity).select(F.col("rid").alias("_cz_bad"), F.col("doc_id").alias("_cz_id")), "bad")
    doubt = KeyFilter(bad.select("_cz_bad")).might_hold(row_id())
    return docs.where(~doubt).unionByName(docs.where(doubt).join(bad, (row_id() == F.col("_cz_bad")) & docs["doc_id"].eqNullSafe(F.col("_cz_id")), "left_anti"))
