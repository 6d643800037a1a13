"""Mixing sources to target weights by iterative proportional fitting.

Token counts are grouped into cells (source, language, topic). Raking scales the cells until their sums by source, by
language and by topic meet the targets, never beyond a cell's capacity: documents are drawn once at most, so a sample of
a share ``keep`` of the tokens can take no more than all of a cell. A document's probability follows from its cell's
calibrated weight over its present tokens, and a hash of its id and text decides; the expected sample has the raked shares.

Edge cases: null source or language is a category of its own (``?``); null and empty texts have no tokens and are
kept, as they carry no weight. Targets name any categories; those absent from the data are left out and the rest
rescaled, and categories without a target share what remains by their present weight. A target above what a sample without
repeats can hold is lowered to that, and the others take up the rest. Where combinations are missing from the data so that
no weights meet all targets, raking ends when it stops gaining and says by how much in a warning. Rows equal in
id and text get the same decision. Clashing column names are safe: only doc_id, text, lang and source are read, and
results are joined back under reserved names. Empty tables give empty results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cadenza.llm.common import row_id, stored

AXES = ("src", "lng", "top")
WHOLE = 1e12  # the first factor of a category that is taken whole: its cells are at capacity from the start


def tokens(text: Column) -> Column:
    """Number of whitespace-separated words of the whole text."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"\S+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of content, from the whole text's shape: table, markup, numeric, shouting or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    share = lambda chars: (F.char_length(t) - F.char_length(F.translate(t, chars, ""))) / n
    lines = F.greatest(F.char_length(t) - F.char_length(F.replace(t, F.lit("|"), F.lit(""))), F.lit(0))
    return (
        F.when(lines * 50 > n, "table")
        .when(share("<>{}#$%&*=;") > 0.05, "markup")
        .when(share("0123456789") > 0.08, "numeric")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "shouting")
        .otherwise("prose")
    )


def cells(docs: DataFrame) -> DataFrame:
    """``docs`` with _cz_src, _cz_lng, _cz_top, _cz_tok and _cz_rid."""
    return docs.withColumns({"_cz_src": F.coalesce("source", F.lit("?")), "_cz_lng": F.coalesce("lang", F.lit("?")), "_cz_top": topic(F.col("text")), "_cz_tok": tokens(F.col("text")), "_cz_rid": row_id()})


def marginals(table: DataFrame, total: int, targets: dict[str, dict[str, float] | None], flatten: float, keep: float) -> DataFrame:
    """(axis, category, target, full), stored: shares over the categories present, each within what the sample can hold of it.

    Given shares, or with None the present ones to the power ``flatten``. Shares above capacity are cut to it and the
    rest is scaled up, until none is above. ``full`` are those that the sample takes whole. All axes are done at once.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in AXES])).alias("x")
    present = table.select(each, "tok").groupBy("x.axis", "x.category").agg(F.sum("tok").alias("t")).where("t > 0")
    raw = F.pow(F.col("t") / F.lit(float(max(1, total))), F.lit(flatten))
    for a, shares in targets.items():
        if shares is not None:
            given = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("category")] if shares else F.lit(None).cast("double")
            other = present.where((F.col("axis") == a) & given.isNull()).agg(F.sum("t")).first()[0] or 1
            raw = F.when(F.col("axis") == a, F.coalesce(given, F.lit(max(0.0, 1.0 - sum(shares.values())) / other) * F.col("t"))).otherwise(raw)
    held = stored(present.select("axis", "category", raw.alias("raw"), (F.col("t") / F.lit(keep * max(1, total))).alias("cap")), "marginals")
    scale, full, before = dict.fromkeys(AXES, 1.0), F.lit(False), F.lit(True)
    while True:
        c, r, more = F.sum(F.when(full, F.col("cap"))).alias("c"), F.sum(F.when(~full, F.col("raw"))).alias("r"), F.max(full != before).alias("more")
        sums = held.groupBy("axis").agg(c, r, more).collect()  # a row an axis
        scale |= {x["axis"]: (1.0 - (x["c"] or 0.0)) / x["r"] for x in sums if x["r"]}
        scaled = F.col("raw") * F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])[F.col("axis")]
        if not any(x["more"] for x in sums):
            return stored(held.select("axis", "category", F.when(full, F.col("cap")).otherwise(scaled).alias("target"), full.alias("full")), "targets")
        before, full = full, full | (scaled > F.col("cap") * (1 + 1e-12))


def rake(table: DataFrame, targets: dict[str, dict[str, float] | None], flatten: float = 0.5, keep: float = 0.9, tolerance: float = 5e-4) -> tuple[DataFrame, float, int]:
    """``((src, lng, top, tok, w), error, total)``: shares ``w`` of the cells, raked over every axis, the largest error of a marginal, and all tokens.

    ``w`` is the present share times one factor an axis, or the cell's capacity tok / (keep * total) where that is less. Cells
    bring their factors along. An axis is one query with one join, whose error is observed as it is written: plans that nest the
    axes of a pass join seven times, and the driver has to hold them and their broadcasts. Sums combine before the shuffle, so no
    task meets all cells. Ends once sums meet targets or, with targets that no weights can meet, once three passes gain less
    than a tenth.
    """
    table = stored(table, "cells")
    total = table.agg(F.sum("tok")).first()[0] or 0
    aims, now = marginals(table, total, targets, flatten, keep), table
    for a in AXES:
        now = now.join(aims.where(F.col("axis") == a).select(F.col("category").alias(a), F.col("target").alias(f"to_{a}"), F.when(F.col("full"), WHOLE).otherwise(1.0).alias(f"f_{a}")), a)
    now = stored(now, "factors")
    free = F.col("tok") / F.lit(float(max(1, total)))
    w = F.least(free * F.col("f_src") * F.col("f_lng") * F.col("f_top"), free / F.lit(keep))
    errors: list[float] = []
    while total:
        error = 0.0
        for a in AXES:
            f, to, s, seen = F.col(f"f_{a}"), F.col(f"to_{a}"), F.col("s"), Observation()
            step = now.join(now.groupBy(a).agg(F.sum(w).alias("s")), a).observe(seen, F.max(F.abs(s - to)).alias("off"))
            step = step.withColumn(f"f_{a}", F.when(s > 0, f * to / s).otherwise(0.0)).drop("s")
            now = stored(step, "factors" if a == AXES[-1] else f"factors_{a}")
            error = max(error, seen.get.get("off") or 0.0)
        errors.append(error)
        if error <= tolerance or (len(errors) > 3 and error > 0.9 * errors[-4]):
            break
    return now.select(*AXES, "tok", w.alias("w")), errors[-1] if errors else 0.0, total


def weigh(tagged: DataFrame, source: dict[str, float] | None = None, lang: dict[str, float] | None = None, topics: dict[str, float] | None = None, keep: float = 0.9, seed: int = 7, flatten: float = 0.5) -> DataFrame:
    """``tagged``, as ``cells`` gives it, with _cz_weight (share of the mix), _cz_p (probability) and _cz_kept.

    Targets are shares by category; None means the present shares to the power ``flatten`` (1: as they are, 0: equal).
    ``keep`` is the share of all tokens wanted in the sample.
    """
    table = tagged.where("_cz_tok > 0").groupBy(F.col("_cz_src").alias("src"), F.col("_cz_lng").alias("lng"), F.col("_cz_top").alias("top")).agg(F.sum("_cz_tok").alias("tok"))
    raked, error, total = rake(table, {"src": source, "lng": lang, "top": topics}, flatten, keep)
    if error > 0.01:
        warnings.warn(f"no weights meet all targets: the largest error of a share is {error:.4f}", stacklevel=2)
    p = raked.select(F.col("src").alias("_cz_a"), F.col("lng").alias("_cz_b"), F.col("top").alias("_cz_c"), F.col("w").alias("_cz_w"), F.col("tok").alias("_cz_all"), F.least(F.lit(1.0), F.col("w") * keep * float(max(1, total)) / F.col("tok")).alias("_cz_p"))
    out = tagged.join(p, (F.col("_cz_src") == F.col("_cz_a")) & (F.col("_cz_lng") == F.col("_cz_b")) & (F.col("_cz_top") == F.col("_cz_c")), "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), "_cz_rid"), F.lit(1 << 52)) / float(1 << 52)
    p_doc = F.when(F.col("_cz_tok") == 0, F.lit(1.0)).otherwise(F.coalesce("_cz_p", F.lit(0.0)))
    return out.withColumns({"_cz_p": p_doc, "_cz_weight": F.coalesce(F.col("_cz_w") * F.col("_cz_tok") / F.col("_cz_all"), F.lit(0.0)), "_cz_kept": draw < p_doc}).drop("_cz_a", "_cz_b", "_cz_c", "_cz_w", "_cz_all", "_cz_rid")


def shares(mixed: DataFrame) -> DataFrame:
    """(axis, category, present, raked, expected, drawn): token shares by category of what ``weigh`` gives."""
    axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"_cz_{a}").alias("category")) for a in AXES])).alias("x")
    rows = mixed.select(axis, F.col("_cz_tok").alias("present"), F.col("_cz_weight").alias("raked"), (F.col("_cz_p") * F.col("_cz_tok")).alias("expected"), F.when(F.col("_cz_kept"), F.col("_cz_tok")).otherwise(0).alias("drawn"))
    names = ("present", "raked", "expected", "drawn")
    sums = stored(rows.groupBy("x.axis", "x.category").agg(*[F.sum(c).cast("double").alias(c) for c in names]), "shares")
    whole = sums.groupBy("axis").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    return sums.join(whole, "axis").select("axis", "category", *[(F.col(c) / F.col(f"all_{c}")).alias(c) for c in names])


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their cells and what ``weigh`` adds. Texts are read twice rather than written or shuffled."""
    return weigh(cells(docs), **options)
