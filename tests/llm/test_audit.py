"""The audit of filters against a plain loop over rows and orders."""

from collections import Counter
from itertools import permutations
import re

from corpus import docs, odd
from oracle import connect, same
from pyspark.sql import functions as F

from cadenza.llm import audit, oracle, queries

LABELS = "doc_id long, quality int, toxic int"


def masks(rows):
    """(doc_id, part, failures) of (doc_id, text, lang) rows."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))), ("E", i is not None and i > first[t])]
        yield i, lang or "", {x for x, f in fails if f}


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    known = list(masks(rows))
    for part in {p for _, p, _ in known}:
        own = [(i, f) for i, p, f in known if p == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for s, x in enumerate(order):
                before = set(order[:s])
                gone = [i for i, f in own if x in f and not f & before]
                removed_by[x] += len(gone)
                out[part, order, s + 1] = [sum(1 for _, f in own if not f & (before | {x})), len(gone), sum(1 for _, f in own if x in f and f & before), sum(1 for _, f in own if f == {x}),
                                           sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(removed_by[order[s - 1]])
    return sorted((*k, *v) for k, v in out.items())


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql(spark, small):
    same(queries.op13_filter_audit(spark, small), connect(small), oracle.ORACLES["op13_filter_audit"])


def test_crafted(spark):
    long = " ".join(f"w{i}" for i in range(100))
    texts = [(0, long), (1, long), (2, " ".join(["same"] * 120)), (3, " ".join(f"W{i}" for i in range(99))), (4, long + " #"), (5, "A b"), (6, "A b"), (7, long.replace("w", "W")), (8, "ÄÖÜ " * 60), (9, "a b" * 5), (10, " ".join(["x y z v"] * 30)), (2, long)]
    df = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, None).otherwise("y"))
    labels = [(0, 1, 0), (1, None, 1), (5, 1, 1), (5, 0, 0), (None, 1, 1), (77, 1, 1), (6, 0, 1)]
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
    assert got(audit.audit(df, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_odd_rows(spark):
    df, n = odd(spark)
    df = df.unionByName(df.withColumns({"doc_id": F.col("doc_id") + 2**53, "lang": F.lit(None).cast("string")}))
    df = df.withColumns({c: F.lit(1) for c in ("part", "mask", "first", "last", "good", "toxic", "cells")})
    labels = [(5, 1, 1), (2**53 + 3, 1, 0), (2**53 + 2, 0, 1)]
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
    out = got(audit.audit(df, spark.createDataFrame(labels, LABELS).withColumns({"text": F.lit(""), "mask": F.lit(0)})))
    assert out == brute(rows, labels)
    first = [r for r in out if r[1] == "ABCDE"]
    assert sum(r[3] + r[4] for r in first if r[2] == 1) == 2 * n
    assert got(audit.audit(df.limit(0), spark.createDataFrame(labels, LABELS))) == []
    assert len(got(audit.audit(df, spark.createDataFrame([], LABELS)))) == len(out)
