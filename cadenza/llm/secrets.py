"""Secret scan by multipart credential linking, in DataFrame functions only.

Strong findings (``assign``, ``access``, ``hex``) are always reported. Weak candidates (``user``: an account
assignment or e-mail address; ``key``: a long mixed token; ``host``: an address or URL) are reported only where
complementary parts co-occur: an identifier, a secret and an endpoint are the three roles, and a weak candidate needs a
part of each other role within its scope, the ``scope`` code points before and after its start.

Edge cases: null counts as empty; whole texts are read. Rows that repeat a doc_id and text get the same findings, and
rows that share a doc_id but not the text are linked apart. Only ``doc_id`` and ``text`` are read. Empty tables give
empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stored

# Kind, pattern, least length, group whose length counts.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]{12,}", 16, 0),  # as AKIA[A-Z0-9]+ of 16 and more: a run's first match is its longest
    ("hex", r"[0-9a-f]{32,}", 32, 0),  # as [0-9a-f]+ of 32 and more: matches are whole runs
)
# Runs begin where no character of theirs stands before and are taken whole (possessive): each is read once, however long.
WEAK = (
    ("user", r"""(?i:(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}+)|(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9])[A-Za-z0-9.-]*[A-Za-z0-9]""", 5, 0),
    ("key", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])", 20, 0),
    ("host", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])|(?<![A-Za-z0-9+_])[a-z][a-z0-9+]++://[A-Za-z0-9.:@/_-]{4,}+", 7, 0),
)
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "key": "secret", "host": "end"}
ORDER = [k for k, *_ in (*BASE, *WEAK)]


def spans(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Array of (start, kind index, end, kind) of a pattern's matches, leftmost and non-overlapping, in code points.

    The pieces between matches give the positions: a match starts after all pieces and matches before it. Matches
    shorter than ``least`` take part in that and are dropped afterwards. Growing an array copies it, so n matches are
    summed in about the square root of n blocks: each block from zero, then the blocks' own starts.
    """
    pat = F.lit(pattern)
    lengths = lambda g: F.transform(F.regexp_extract_all(text, pat, F.lit(g)), F.length)
    sized = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), lengths(0).alias("len"), *([lengths(group).alias("part")] if group else []))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(ORDER.index(kind)).alias("k"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["part" if group else "len"] >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def blocks(z: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(z))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(z), size), lambda at: F.aggregate(F.slice(z, at, size), F.struct(F.lit(0).alias("at"), none.alias("found")), step))

    def shifted(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(parts, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        moved = lambda x, by: F.struct((x["start"] + by).alias("start"), x["k"].alias("k"), (x["end"] + by).alias("end"), x["kind"].alias("kind"))
        pairs = F.arrays_zip(parts.alias("part"), starts.alias("by"))
        return F.flatten(F.transform(pairs, lambda p: F.transform(p["part"]["found"], lambda x: moved(x, p["by"]))))

    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value computed once and used twice
    return F.when(F.regexp_like(text, pat), bound(sized, lambda z: bound(blocks(z), shifted))).otherwise(none)


def joined(found: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def link(parts: DataFrame, scope: int) -> DataFrame:
    """The weak rows of ``parts`` (doc_id, tk, start, k, end, kind, weak, role) with a part of each other role in scope.

    An interval join: positions fall into windows of ``scope`` code points; for each window and role only the first
    and last start matter, so a weak part meets at most three summary rows a role, however many parts a text holds.
    """
    at = F.floor(F.col("start") / scope).cast("int")
    summary = parts.groupBy("doc_id", "tk", at.alias("w"), "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    seen = summary.groupBy("doc_id", "tk", "w").agg(*[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("id", "secret", "end") for c in ("lo", "hi")])
    spread = seen.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d")).withColumn("w", F.col("w") + F.col("d"))
    weak = parts.where("weak").withColumn("w", at)
    m = weak.join(spread.withColumnRenamed("doc_id", "_cz_id"), F.col("doc_id").eqNullSafe(F.col("_cz_id")) & (weak["tk"] == spread["tk"]) & (weak["w"] == spread["w"])).drop(spread["tk"], spread["w"])

    def near(r: str) -> Column:  # the summary stands in window w - d
        return F.when(F.col("d") == 0, F.col(f"{r}_lo").isNotNull()).when(F.col("d") == 1, F.col(f"{r}_hi") >= F.col("start") - scope).otherwise(F.col(f"{r}_lo") <= F.col("start") + scope)

    keys = ["doc_id", "tk", "start", "k", "end", "kind", "role"]
    met = m.groupBy(*keys).agg(*[F.coalesce(F.max(near(r)), F.lit(False)).alias(f"has_{r}") for r in ("id", "secret", "end")])
    every = reduce(lambda a, b: a & b, [(F.col("role") == r) | F.col(f"has_{r}") for r in ("id", "secret", "end")])
    return met.where(every).select("doc_id", "tk", F.struct("start", "k", "end", "kind").alias("x"))


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """(doc_id, base, found): arrays of (start, k, end, kind) of the strong and of all reported spans of each row.

    Only spans are shuffled, never texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    got = rows.select(
        "doc_id",
        F.xxhash64("t").alias("tk"),
        F.array_sort(F.concat(*[spans(F.col("t"), *x) for x in BASE])).alias("base"),
        F.array_sort(F.concat(*[spans(F.col("t"), *x) for x in WEAK])).alias("weak"),
    )
    got = stored(got, "spans")
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    parts = got.where("size(weak) > 0").select("doc_id", "tk", F.explode(F.concat(F.transform("base", lambda x: F.struct(x.alias("x"), F.lit(False).alias("weak"))), F.transform("weak", lambda x: F.struct(x.alias("x"), F.lit(True).alias("weak"))))).alias("p"))
    parts = parts.select("doc_id", "tk", "p.x.*", "p.weak").withColumn("role", role[F.col("kind")]).distinct()
    linked = link(parts, scope).groupBy("doc_id", "tk").agg(F.collect_set("x").alias("more")).select(F.col("doc_id").alias("_cz_id"), F.col("tk").alias("_cz_tk"), "more")
    out = got.join(linked, got["doc_id"].eqNullSafe(linked["_cz_id"]) & (got["tk"] == linked["_cz_tk"]), "left")
    more = F.coalesce("more", F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)"))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("found"))
