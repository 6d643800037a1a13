"""Audit of how document filters interact, from one histogram of failure masks.

Each row gets a mask with a bit for each filter that it fails; per part the rows are counted in 32 cells by mask. Whatever
order the filters run in, what each step removes is a sum over cells, so all 120 orders are read off the cells.

Filters, on whole texts (null: empty; words: maximal runs of what is not ASCII white space):
A under 100 words; B under 80 % distinct words; C over 10 % of the code points in A-Z; D holds one of ``#$%&*|``; E identical to the text
of a smaller doc_id anywhere in the table, kept or not.

E needs the smallest doc_id of each text. Texts are grouped whole, combined before the shuffle; only texts with several ids are
kept, and only rows whose text a Bloom filter finds among them are joined to these, so that other texts are not moved again. The
table that is joined is stored and has unique keys, so the join can split a text that a third of the rows share.

Edge cases: a null doc_id fails no E, and is no smaller id of others; its row has no labels. Rows that repeat a doc_id and text count
each, and fail E only by another, smaller id. Labels that repeat a doc_id count as good or toxic if any of them is. A null
lang is the part '', as an empty one. An empty table has no part and gives no row. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import UPPER, stored
from cadenza.llm.filters import KeyFilter

FILTERS = "ABCDE"
BIT = {x: 1 << i for i, x in enumerate(FILTERS)}
CELLS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Mask of the filters that look at one text alone: A to D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}
    return reduce(Column.bitwiseOR, [F.when(c, BIT[x]).otherwise(0) for x, c in fails.items()])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = stored(ids.where("first < last").select("text", "first"), "first")
    again = KeyFilter(first.select(F.xxhash64("text"))).might_hold(F.xxhash64("text"))
    mask = text_failures(F.col("text"))
    doubt = rows.where(again).join(first, "text", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), BIT["E"]).otherwise(0)
    return rows.where(~again).select("doc_id", "part", mask.alias("mask")).unionByName(doubt.select("doc_id", "part", mask.bitwiseOR(copy).alias("mask")))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic), stored: at most 32 rows a part."""
    any_of = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    rows = masks(docs).join(known, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return stored(rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic")), "cells")


def steps(held: DataFrame) -> DataFrame:
    """Each part once for every order and step: the step's filter as a bit, ``own``, and those of the filters ``before`` it."""
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    each = held.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("i", "x"))
    bits = lambda where: reduce(Column.bitwiseOR, [F.when(where(x), bit).otherwise(0) for x, bit in BIT.items()])
    return each.withColumns({"step": F.col("i") + 1, "own": bits(lambda x: F.col("x") == x), "before": bits(lambda x: F.instr("filter_order", x) <= F.col("i"))})


def report(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    Of the 120 orders a row with p failures falls to each of its filters in 120 / p.
    """
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def total(what: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[what]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails, gone = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), c["n"] * F.get(F.array(*map(F.lit, (0, 120, 60, 40, 30, 24))), F.bit_count(c["mask"]))).otherwise(0))
    return steps(held).select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(cells(docs, labels))
