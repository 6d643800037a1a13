"""Sharding by balanced label propagation under row quotas.

Documents with equal texts are linked; an edge is cut when linked documents lie in different shards. Each round every
group's label is the shard that most of its members are in; members move there as far as quotas allow. A shard admits
its stayers and arrivals first and documents without links last; who does not fit fills the gaps of other shards. Every
round ends with counts at most one apart (law ``rows``). Rounds end once no fewer rows lie outside their group's main
shard. A group larger than a quota is cut into parts of a quota, since no shard can hold it.

Edge cases: null text counts as empty (size 1). Repeated rows and ids are rows of their own, told apart by a number
given once and stored. Ids may be null. Fewer documents than shards leave shards empty. Only ``doc_id`` and ``text``
are read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import numbered, stored

BUCKET = 50_000  # rows that one task ranks, about


def spread(n: int):
    """Numbers of buckets of about ``BUCKET`` rows. Groups follow one another; one larger than a bucket has several in a row."""
    place = F.pmod(F.xxhash64("unit"), F.lit(max(1, n // BUCKET)))
    return place * F.lit(n // BUCKET + 2) + F.when(F.col("parts") > 1, F.pmod(F.xxhash64("uid"), F.col("parts"))).otherwise(0)


def fit_quotas(wanted: DataFrame, shards: int, n: int, tag: str) -> DataFrame:
    """Replace ``want`` by ``shard``: the first quota rows of each shard by ``rank`` stay, the others fill gaps.

    Overflowing rows are numbered, and so are the free places: place ranges per shard are a table of ``shards`` rows.
    """
    quota = F.lit(n // shards) + F.when(F.col("want") < n % shards, 1).otherwise(0)
    placed = numbered(wanted, ["want"], ["unit", "uid"], spread(n), "pos", rank="rank").withColumn("over", F.col("pos") >= quota)
    placed = stored(placed, tag)
    spark = wanted.sparkSession
    took = placed.groupBy("want").agg(F.count_if(~F.col("over")).alias("took"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("want")).join(took, "want", "left")
    free = every.select(F.col("want").alias("shard"), (quota - F.coalesce("took", F.lit(0))).alias("free")).where("free > 0")
    w = Window.partitionBy(F.lit(0)).orderBy("shard")
    free = free.withColumn("hi", F.sum("free").over(w)).select("shard", (F.col("hi") - F.col("free")).alias("lo"), "hi")
    keep = placed.where("not over").withColumnRenamed("want", "shard")
    extra = placed.where("over").drop("pos", "rank")
    extra = numbered(extra.withColumn("one", F.lit(0)), ["one"], ["unit", "uid"], spread(n), "place").drop("one", "want")
    ranges = F.broadcast(free.select(F.col("shard").alias("to"), "lo", "hi"))  # one row per shard
    moved = extra.join(ranges, (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).withColumnRenamed("to", "shard")
    cols = ["uid", "doc_id", "size", "crc", "unit", "parts", "linked", "shard"]
    return stored(keep.select(*cols).unionByName(moved.select(*cols)), tag)


def apart(state: DataFrame) -> int:
    """Rows that lie outside the shard that holds most of their group, where fewer mean fewer cut edges."""
    held = state.where("linked").groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("c"))
    return held.groupBy("unit").agg((F.sum("c") - F.max("c")).alias("out")).agg(F.sum("out")).first()[0] or 0


def shard(docs: DataFrame, shards: int = 16, most_rounds: int = 10) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked), one row per input row.

    Texts are read once and never shuffled: rounds work on (number, unit, shard) rows. The round with the fewest rows
    ``apart`` counts; ``most_rounds`` bounds rounds that gain little, not their result's law.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("g"), F.monotonically_increasing_id().alias("uid"))
    base = stored(base, "rows")
    n = base.count()
    quota = max(1, n // shards)
    groups = stored(base.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "groups")  # so that the join can split a hot text
    rows = base.join(groups, "g", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    pieces = F.ceil(F.col("rows") / quota).cast("long")
    unit = F.xxhash64("g", F.pmod(F.xxhash64("uid"), pieces))
    rows = rows.select("uid", "doc_id", "size", "crc", unit.alias("unit"), F.ceil(F.least("rows", F.lit(quota)) / BUCKET).cast("long").alias("parts"), (F.col("rows") > 1).alias("linked"))
    start = rows.withColumn("want", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int")).withColumn("rank", F.when(F.col("linked"), 0).otherwise(2))
    state = fit_quotas(start, shards, n, "state")
    off = apart(state)
    for _ in range(most_rounds):
        if not off:
            break
        held = state.where("linked").groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("c"))
        labels = held.groupBy("unit").agg(F.max(F.struct("c", F.xxhash64("unit", "shard").alias("tie"), "shard"))["shard"].alias("label"))
        wanted = state.join(stored(labels, "labels"), "unit", "left").withColumn("want", F.coalesce("label", "shard"))
        rank = F.when(~F.col("linked"), 2).when(F.col("want") != F.col("shard"), 1).otherwise(0)
        moved = fit_quotas(wanted.withColumn("rank", rank).drop("label", "shard"), shards, n, "state")
        now = apart(moved)
        if now >= off:
            break
        state, off = moved, now
    out = numbered(state, ["shard"], ["unit", "uid"], spread(n), "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
