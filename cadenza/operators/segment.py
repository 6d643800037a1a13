"""Cutting sequences into trials, blocks and distractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_length(df: DataFrame, keys: list[str], out: str = "len") -> DataFrame:
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def tumbling(df: DataFrame, keys: list[str], t: str, length: int, out: str = "trial") -> DataFrame:
    """Trials of ``length`` samples side by side; an incomplete tail is dropped."""
    cut = with_length(df, keys, "_len").withColumn(out, F.floor(F.col(t) / length))
    return cut.where(F.col(out) < F.floor(F.col("_len") / length)).drop("_len")


def overlapping(df: DataFrame, keys: list[str], t: str, starts: DataFrame, length: int) -> DataFrame:
    """Trials from a table of starts (keys, trial, start): an equi-join on each sample that a trial wants."""
    wanted = starts.select(*keys, "trial", "start", F.explode(F.sequence(F.col("start"), F.col("start") + (length - 1))).alias(t))
    return wanted.join(df, [*keys, t])


def equal_blocks(df: DataFrame, keys: list[str], t: str, n: int, out: str = "block") -> DataFrame:
    """``n`` blocks of equal length; the remainder is dropped."""
    cut = with_length(df, keys, "_len").withColumn(out, F.floor(F.col(t) / F.floor(F.col("_len") / n)))
    return cut.where(F.col(out) < n).drop("_len")


def segments(df: DataFrame, keys: list[str], t: str, length: int, out: str = "segment") -> DataFrame:
    """len div length + 1 segments, the first ones a sample longer where they do not divide evenly; no sample dropped."""
    df = with_length(df, keys, "_len").withColumn("_n", F.floor(F.col("_len") / length) + 1)
    base, extra = F.floor(F.col("_len") / F.col("_n")), F.col("_len") % F.col("_n")
    head = extra * (base + 1)
    at = F.when(F.col(t) < head, F.floor(F.col(t) / (base + 1))).otherwise(extra + F.floor((F.col(t) - head) / F.greatest(base, F.lit(1))))
    return df.withColumn(out, at).drop("_len", "_n")


def rotate(df: DataFrame, keys: list[str], t: str, by: Column, out: str = "pos") -> DataFrame:
    """Circular shift: the sample at ``t`` moves to (t + by) mod length."""
    return with_length(df, keys, "_len").withColumn(out, F.pmod(F.col(t) + by, F.col("_len"))).drop("_len")


def bootstrap_starts(lengths: DataFrame, keys: list[str], length: int, per: int, most: int = 1000, seed: int = 0) -> DataFrame:
    """(keys, trial, start): min(len div per, most) seeded starts, uniform where a whole trial fits, in order.

    ``lengths`` holds (keys, len). A sequence of exactly one trial's length starts at 0; shorter ones have no trial.
    """
    n = F.least(F.floor(F.col("len") / per), F.lit(most)).cast("int")
    room = F.greatest(F.col("len") - length, F.lit(1))
    drawn = lengths.where(F.col("len") >= length).select(*keys, "len", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("i"))
    start = F.pmod(F.xxhash64(F.lit(seed), *keys, "i"), room)
    order = Window.partitionBy(*keys).orderBy("start", "i")
    return drawn.withColumn("start", start).withColumn("trial", F.row_number().over(order).cast("long") - 1).select(*keys, "trial", "start")


def start_array(n: Column, keys: list[str], length: int, per: int | None, most: int = 1000, seed: int = 0) -> Column:
    """The starts of ``bootstrap_starts`` for a sequence of ``n`` samples as one array, in order; without ``per`` those of trials side by side."""
    none = F.array().cast("array<bigint>")
    if per is None:
        side = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(n / length) - 1), lambda i: i * length)
        return F.when(n >= length, side).otherwise(none)
    count = F.greatest(F.least(F.floor(n / per), F.lit(most)).cast("int"), F.lit(1))
    drawn = F.transform(F.sequence(F.lit(1), count), lambda i: F.pmod(F.xxhash64(F.lit(seed), *keys, i), F.greatest(n - length, F.lit(1))))
    return F.when(n >= length, F.array_sort(drawn)).otherwise(none)


def distractor_array(starts: Column, n: Column, keys: list[str], length: int, margin: int, seed: int = 0) -> Column:
    """``first`` of ``distractor_starts`` for each of an array of starts; null where a trial gets none."""

    def first(start: Column, k: Column) -> Column:
        free = F.greatest(start - margin, F.lit(0)) + F.greatest(n - (start + length + margin), F.lit(0))
        return F.when(free >= length, F.pmod(F.xxhash64(F.lit(seed), *keys, k.cast("long")), F.greatest(free - length, F.lit(1))))

    return F.transform(starts, first)


def distractor_pool(df: DataFrame, keys: list[str], t: str, starts: DataFrame, length: int, margin: int) -> DataFrame:
    """(keys, trial, pos, ...): samples outside [start - margin, start + length + margin), renumbered from 0.

    ``t`` numbers the samples of ``keys`` from 0 without gaps, so positions follow from the two free stretches. This gives every
    free sample of every trial; to draw one window use ``distractor_starts``, which touches no samples.
    """
    rest = starts.join(df, keys).where((F.col(t) < F.col("start") - margin) | (F.col(t) >= F.col("start") + length + margin))
    lead = F.greatest(F.col("start") - margin, F.lit(0))
    return rest.withColumn("pos", F.when(F.col(t) < F.col("start"), F.col(t)).otherwise(F.col(t) - (F.col("start") + length + margin) + lead).cast("long"))


def distractor_starts(starts: DataFrame, lengths: DataFrame, keys: list[str], length: int, margin: int, seed: int = 0) -> DataFrame:
    """(keys, trial, start, first): where, among a trial's free samples, its distractor starts; seeded.

    ``lengths`` holds (keys, len). The free samples are the two stretches beside the trial and its margin; trials with fewer than ``length``
    free samples get none.
    """
    lead, tail = F.greatest(F.col("start") - margin, F.lit(0)), F.greatest(F.col("len") - (F.col("start") + length + margin), F.lit(0))
    free = starts.join(lengths, keys).withColumn("_free", lead + tail).where(F.col("_free") >= length)
    first = F.pmod(F.xxhash64(F.lit(seed), *keys, "trial"), F.greatest(F.col("_free") - length, F.lit(1)))
    return free.select(*keys, "trial", "start", first.alias("first"))


def distractor_samples(length: int, margin: int) -> Column:
    """The sample numbers of a distractor from ``start`` and ``first``: consecutive free samples, passing over the trial and its margin."""
    lead = F.greatest(F.col("start") - margin, F.lit(0))
    places = F.sequence(F.col("first"), F.col("first") + (length - 1))
    return F.transform(places, lambda i: F.when(i < lead, i).otherwise(i - lead + F.col("start") + (length + margin)))


def draw_distractor(df: DataFrame, keys: list[str], t: str, starts: DataFrame, length: int, margin: int, seed: int = 0) -> DataFrame:
    """(keys, trial, pos, ...): one window of ``length`` free samples for each trial, by an equi-join on the samples wanted."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"))
    drawn = distractor_starts(starts, n, keys, length, margin, seed)
    wanted = drawn.select(*keys, "trial", F.posexplode(distractor_samples(length, margin)).alias("pos", t))
    return wanted.join(df, [*keys, t]).withColumn("pos", F.col("pos").cast("long"))


def random_subset(items: DataFrame, keys: list[str], item: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` of the distinct items per ``keys``, by a seeded hash: the same draw wherever and whenever it runs."""
    drawn = items.select(*keys, item).distinct().withColumn("_h", F.xxhash64(F.lit(seed), *keys, item))
    if not keys:
        return drawn.orderBy("_h", item).limit(n).drop("_h")
    order = Window.partitionBy(*keys).orderBy("_h", item)
    return drawn.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_h", "_k")


def permute_rows(df: DataFrame, keys: list[str], t: str, cols: list[str], seed: int = 0) -> DataFrame:
    """``df`` with the values of ``cols`` dealt anew over the samples of each of ``keys``, in a seeded random order, rows together."""
    w = Window.partitionBy(*keys)
    places = df.withColumn("_k", F.row_number().over(w.orderBy(t)))
    drawn = df.withColumn("_k", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), *keys, t), t))).select(*keys, "_k", *cols)
    return places.drop(*cols).join(drawn, [*keys, "_k"]).select(*df.columns)


def random_rotation(df: DataFrame, keys: list[str], t: str, least: int, seed: int = 0, out: str = "pos") -> DataFrame:
    """Circular shift of each sequence by a seeded amount of at least ``least`` samples either way, where it is long enough."""
    df = with_length(df, keys, "_n")
    room = F.greatest(F.col("_n") - 2 * least + 1, F.lit(1))
    by = F.least(F.lit(least), F.col("_n")) + F.pmod(F.xxhash64(F.lit(seed), *keys), room)
    return rotate(df.withColumn("_by", by), keys, t, F.col("_by"), out).drop("_n", "_by")
