"""Windows over long sequences in pieces: each piece brings along the few rows before and after it that its windows reach.

A window over one key's rows sorts all of them in one task. Where frames are bounded, a sequence can be cut into pieces of a fixed number
of rows; rows near a cut are copied to the piece next to it (its halo), windows run within pieces, and halo rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ROWS = 100_000  # of a piece


def same(a: DataFrame, b: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of keys with their prefixed namesakes; true without keys."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"{prefix}{k}"]) for k in keys], F.lit(True))


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "seq", rows: int = ROWS, total: str | None = None) -> DataFrame:
    """0-based gapless position of each row within ``keys`` in order of ``order``, without a task that sorts a whole key.

    The last column of ``order`` is a whole number that grows with time, such as a sample number: rows are cut where it passes a multiple of ``rows``
    (and where an earlier column changes), numbered within these cuts, and shifted by the counts of the cuts before. The table of
    counts has a row for each cut. ``total`` names a column for the number of rows of ``keys``.
    """
    *early, t = order
    df = df.withColumn("_cut", F.floor(F.col(t) / rows))
    cut = [*keys, *early, "_cut"]
    counts = df.groupBy(*cut).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy(*early, "_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = [F.sum("_n").over(whole).alias(total)] if total else []
    counts = counts.select(*[F.col(c).alias(f"_o{c}") for c in cut], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *sizes)
    df = df.withColumn("_in", F.row_number().over(Window.partitionBy(*cut).orderBy(t)) - 1)
    joined = df.join(counts, same(df, counts, cut, "_o"))
    return joined.withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_cut", "_in", "_before", *[f"_o{c}" for c in cut])


def windowed(df: DataFrame, keys: list[str], seq: str, behind: int, ahead: int, add: Callable[[DataFrame, WindowSpec], DataFrame], rows: int = ROWS, total: str | None = None) -> DataFrame:
    """``add(df, window)`` for windows ordered by ``seq`` within ``keys`` whose frames reach ``behind`` rows back and ``ahead`` rows on.

    ``seq`` numbers the rows of ``keys`` from 0 without gaps, ``total`` has their number: no row is copied to pieces beyond the last one. The result equals that of windows over whole keys, also at both ends
    of a sequence, as long as frames stay within these bounds.
    """
    piece = F.floor(F.col(seq) / rows)
    first, last = F.floor((F.col(seq) - ahead) / rows), F.floor((F.col(seq) + behind) / rows)
    if total:
        last = F.least(last, F.floor((F.col(total) - 1) / rows))
    spread = df.withColumn("_piece", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    done = add(spread, Window.partitionBy(*keys, "_piece").orderBy(seq))
    return done.where(F.col("_piece") == piece).drop("_piece")


def over(df: DataFrame, keys: list[str], order: list[str], behind: int, ahead: int, add: Callable[[DataFrame, WindowSpec], DataFrame], rows: int | None) -> DataFrame:
    """``add(df, window)`` over whole keys, or in pieces of ``rows`` rows where that is given; see ``positions`` and ``windowed``."""
    if rows is None:
        return add(df, Window.partitionBy(*keys).orderBy(*order))
    return windowed(positions(df, keys, order, "_seq", rows, "_total"), keys, "_seq", max(0, behind), max(0, ahead), add, rows, "_total").drop("_seq", "_total")


def with_known(df: DataFrame, keys: list[str], t: str, known: Column, count: int, rows: int = ROWS) -> DataFrame:
    """``df`` in pieces (``_piece``), each with copies (``_halo``) of the ``count`` nearest known rows before it and after it, however far away.

    For frames without a bound, such as the last known value. Of each piece the first and last known rows can be nearest to
    others; only this small table is put in order as a whole. A row is copied to all pieces up to that of the ``count``-th known row after it, and
    before it. ``t`` is a whole number that grows with time; it may have gaps.
    """
    df = df.withColumn("_piece", F.floor(F.col(t) / rows))
    inside = Window.partitionBy(*keys, "_piece")
    first, last = F.row_number().over(inside.orderBy(t)), F.row_number().over(inside.orderBy(F.desc(t)))
    ends = df.where(known).withColumns({"_f": first, "_l": last}).where((F.col("_f") <= count) | (F.col("_l") <= count)).drop("_f", "_l")
    tops = df.groupBy(*keys).agg(F.min("_piece").alias("_low"), F.max("_piece").alias("_top")).withColumnsRenamed({k: f"_t{k}" for k in keys})
    line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(t)
    ends = ends.withColumns({"_to": F.lead("_piece", count).over(line), "_from": F.lag("_piece", count).over(line)}).join(tops, same(ends, tops, keys, "_t"))
    ends = ends.withColumns({"_to": F.coalesce("_to", "_top"), "_from": F.coalesce("_from", "_low")})
    places = F.filter(F.sequence("_from", "_to"), lambda i: i != F.col("_piece"))
    copies = ends.withColumn("_piece", F.explode(places)).select(*df.columns, F.lit(True).alias("_halo"))
    return df.withColumn("_halo", F.lit(False)).unionByName(copies)
