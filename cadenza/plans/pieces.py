"""Windows over long sequences in pieces: the same rows as windows over whole keys, with the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.expr import dot, rounded, safe_corr
from cadenza.operators import clean, filters, halo, lag, masks, signif
from cadenza.plans.registry import ORACLES, RES, query, rd
from cadenza.plans.windows import K, T
from cadenza.sources import npy
from cadenza.sources.adapters import array_signal, results, signal, table
from cadenza.sources.tables import shared_folder

ROWS = 8  # a subject has some dozens of samples: about eight pieces


@query(ORACLES["hankel_lag_corr"])
def hankel_lag_corr_pieces(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), K, T, ["x"], lags=3, offset=1, rows=ROWS)
    c = {"c0": safe_corr("x_1", "y"), "c1": safe_corr("x_0", "y"), "cm": safe_corr("x_2", "y"), "g": F.covar_samp("x_1", "x_0")}
    return h.groupBy("u").agg(*[rounded(v).alias(n) for n, v in c.items()])


@query(ORACLES["hankel_block"])
def hankel_block_pieces(spark: SparkSession, d: str) -> DataFrame:
    h = lag.block_hankel(array_signal(spark, d), ["grp"], ["vec"], "ch", 64, lags=2, offset=1, rows=100)
    place = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: i.cast("double"))
    return h.select("grp", "vec", F.size("h").cast("long").alias("width"), rounded(dot(F.col("h"), place), 4).alias("checksum"))


@query(ORACLES["hankel_masked"])
def hankel_masked_pieces(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), K, T, ["x"], lags=2, rows=ROWS)
    m = masks.event_mask(h, K, T, F.col("sacc"), before=2, after=3, out="one", rows=ROWS)
    kept = masks.expand_mask(m, K, T, "one", lags=2, offset=0, rows=ROWS).where("keep")
    return kept.groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("x_0") * F.col("x_1"))).alias("s"))


@query(ORACLES["velocity"])
def velocity_pieces(spark: SparkSession, d: str) -> DataFrame:
    return clean.velocity(signal(spark, d), K, "t", "x", "y", rows=ROWS).select("u", "t", rounded("vel").alias("vel"))


@query(ORACLES["gap_fill_linear"])
def gap_fill_pieces(spark: SparkSession, d: str) -> DataFrame:
    s = clean.blank(signal(spark, d), (F.col("y") > 60) | (F.col("t") < 2), "x")
    return clean.fill_linear(s, K, "t", "x", rows=ROWS).select("u", "t", rounded("x").alias("x"))


ALL = "OVER (ORDER BY event_id)"


@query(f"""WITH h AS (SELECT user_id, value AS x, lag(value, 1, CAST(0 AS DOUBLE)) {ALL} AS back, lead(value, 1, CAST(0 AS DOUBLE)) {ALL} AS next,
  NOT bool_or(event_type = 'click') OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS keep, row_number() {ALL} - 1 AS seq FROM events)
SELECT user_id AS u, count(*) AS n, count(*) FILTER (WHERE keep) AS kept, CAST(max(seq) AS BIGINT) AS last, {rd("sum(x * back)", 4)} AS sb, {rd("sum(x * next)", 4)} AS sn FROM h GROUP BY user_id""")
def whole_series_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All events as one sequence without a key, in pieces of 500: lags, masks and positions, and no task that sorts all of it."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("u"), F.col("value").alias("x"), (F.col("event_type") == "click").alias("click"))
    line = halo.positions(e, [], ["event_id"], "seq", 500)
    h = lag.hankel(line, [], ["event_id"], ["x"], lags=3, offset=1, rows=500)
    m = masks.event_mask(h, [], ["event_id"], F.col("click"), before=1, after=2, rows=500)
    return m.groupBy("u").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.max("seq").alias("last"), rounded(F.sum(F.col("x") * F.col("x_2")), 4).alias("sb"), rounded(F.sum(F.col("x") * F.col("x_0")), 4).alias("sn")
    )


@query(f"""WITH {RES}, r AS (SELECT value AS v, row_number() OVER (ORDER BY value DESC) AS k, count(*) OVER () AS n FROM res)
SELECT {rd("max(v) FILTER (WHERE k = 7)")} AS seventh, {rd("max(v) FILTER (WHERE k = CAST(floor(n * 0.01) AS BIGINT))")} AS pooled, {rd("max(v) FILTER (WHERE k = n - CAST(floor(n * 0.975) AS BIGINT))")} AS upper FROM r""")
def levels_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Order statistics of a whole table, without keys: ranges and their counts, no task that sorts all of it."""
    r = results(spark, d)
    seventh = signif.order_statistic(r, [], F.col("value"), F.lit(7), "seventh")
    pooled, upper = signif.pooled_level(r, [], "value", 0.01, "pooled"), signif.ascending_level(r, [], "value", 0.975, "upper")
    rows = seventh.withColumn("of", F.lit("seventh")).unionByName(pooled.select(F.col("pooled").alias("seventh"), F.lit("pooled").alias("of"))).unionByName(upper.select(F.col("upper").alias("seventh"), F.lit("upper").alias("of")))
    return rows.agg(*[rounded(F.max(F.when(F.col("of") == c, F.col("seventh")))).alias(c) for c in ("seventh", "pooled", "upper")])


@query(f"""WITH {RES}, t AS (SELECT modality, subject, avg(value % 1) AS p FROM res GROUP BY modality, subject),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, modality, subject) AS raw, rank() OVER (ORDER BY round(p, 2)) + (count(*) OVER (PARTITION BY round(p, 2)) - 1) / 2 AS rank FROM t)
SELECT modality, subject, {rd("least(1.0, min(raw) OVER (ORDER BY p, modality, subject ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS adjusted, CAST(rank AS DOUBLE) AS rank FROM r""")
def ranks_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg adjustment and mean ranks over all tests as one family."""
    t = results(spark, d).groupBy("modality", "subject").agg(F.avg(F.col("value") % 1).alias("p"))
    adj = signif.benjamini_hochberg(t, [], "p", ["modality", "subject"]).withColumn("p2", F.round("p", 2))
    return signif.mid_ranks(adj, [], "p2").select("modality", "subject", rounded("adjusted").alias("adjusted"), F.col("rank").cast("double").alias("rank"))


@query()
def bandpass_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All events as one recording, band-passed in pieces of 2,000 samples."""
    e = table(spark, d, "events").select(F.col("event_id").alias("t"), F.col("value").alias("x"))
    return filters.band_pass(e, [], "t", ["x"], 30.0, 1.0, 9.0, rows=2000).select("t", rounded("x", 5).alias("x"))


@query()
def envelope_chain(spark: SparkSession, d: str) -> DataFrame:
    """Envelope of the band from 5 to 10 Hz, low-passed and kept at a third of the rate, normalised by segments."""
    out = filters.envelope(signal(spark, d), K, "t", ["x"], 30.0, 5.0, 10.0, every=3, rows=40)
    return clean.normalize_segments(out, K, "t", ["x"], 10).select("u", "t", rounded("x", 5).alias("x"))


@query(ORACLES["gap_fill_linear"])
def npy_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's series with gaps written as a .npy file, read by ranges of 16 samples, gaps filled in pieces."""
    folder = shared_folder(spark, "npy")
    s = clean.blank(signal(spark, d), (F.col("y") > 60) | (F.col("t") < 2), "x")
    npy.write_npy(s, "u", "t", ["x"], folder).count()
    back = npy.filled(npy.read_npy(spark, folder, 16), 16)
    return back.select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("long").alias("u"), "t", rounded(F.get("ch", 0)).alias("x"))
