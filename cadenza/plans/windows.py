"""Queries on lags, masks, cleaning, segments and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.expr import dot, rounded, safe_corr
from cadenza.operators import clean, folds, lag, masks, segment
from cadenza.plans.registry import EMB, SIG, query, rd
from cadenza.sources.adapters import array_signal, signal

K, T = ["u"], ["t"]
OVER = "OVER (PARTITION BY u ORDER BY t)"


@query(f"""WITH {SIG}, h AS (
  SELECT u, t, y, x AS h0, lead(x, 1, CAST(0 AS DOUBLE)) {OVER} AS h1, lag(x, 1, CAST(0 AS DOUBLE)) {OVER} AS hm FROM sig)
SELECT u, {rd("corr(h0, y)")} AS c0, {rd("corr(h1, y)")} AS c1, {rd("corr(hm, y)")} AS cm, {rd("covar_samp(h0, h1)")} AS g FROM h GROUP BY u""")
def hankel_lag_corr(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), K, T, ["x"], lags=3, offset=1)
    return h.groupBy("u").agg(
        rounded(safe_corr("x_1", "y")).alias("c0"), rounded(safe_corr("x_0", "y")).alias("c1"), rounded(safe_corr("x_2", "y")).alias("cm"), rounded(F.covar_samp("x_1", "x_0")).alias("g")
    )


@query(f"""WITH {EMB}, h AS (SELECT grp, vec, ch, lead(ch) OVER (PARTITION BY grp ORDER BY vec) AS nx FROM emb)
SELECT grp, vec, CAST(128 AS BIGINT) AS width, {rd("list_sum(list_transform(range(64), lambda c: coalesce(nx[c + 1], 0) * (2 * c + 1) + ch[c + 1] * (2 * c + 2)))", 4)} AS checksum FROM h""")
def hankel_block(spark: SparkSession, d: str) -> DataFrame:
    h = lag.block_hankel(array_signal(spark, d), ["grp"], ["vec"], "ch", 64, lags=2, offset=1)
    place = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: i.cast("double"))
    return h.select("grp", "vec", F.size("h").cast("long").alias("width"), rounded(dot(F.col("h"), place), 4).alias("checksum"))


@query(f"""WITH {SIG}, m AS (
  SELECT u, t, x, lag(x, 1, CAST(0 AS DOUBLE)) {OVER} AS x1,
         NOT bool_or(sacc) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS keep FROM sig),
e AS (SELECT *, bool_and(keep) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS ok FROM m)
SELECT u, count(*) AS n, {rd("sum(x * x1)")} AS s FROM e WHERE ok GROUP BY u""")
def hankel_masked(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), K, T, ["x"], lags=2)
    m = masks.event_mask(h, K, T, F.col("sacc"), before=2, after=3, out="one")
    kept = masks.expand_mask(m, K, T, "one", lags=2, offset=0).where("keep")
    return kept.groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("x_0") * F.col("x_1"))).alias("s"))


@query(f"""WITH {SIG}, h AS (SELECT u, vid, t, x, lag(x, 1, CAST(0 AS DOUBLE)) OVER (PARTITION BY u, vid ORDER BY t) AS x1 FROM sig)
SELECT u, vid, {rd("sum(x * x1)")} AS s, {rd("sum(x1)")} AS s1 FROM h GROUP BY u, vid""")
def hankel_multisubject(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), ["u", "vid"], T, ["x"], lags=2)
    return h.groupBy("u", "vid").agg(rounded(F.sum(F.col("x_0") * F.col("x_1"))).alias("s"), rounded(F.sum("x_1")).alias("s1"))


@query(f"""WITH {EMB}, w AS (SELECT grp, vec, ch[i + 1] AS w, i FROM emb, (SELECT unnest(range(64)) AS i))
SELECT grp, i // 4 AS channel, {rd("avg(w)")} AS w FROM w WHERE i % 4 = 1 GROUP BY grp, i // 4""")
def hankel_zero_lag_pick(spark: SparkSession, d: str) -> DataFrame:
    w = array_signal(spark, d).select("grp", "vec", F.posexplode("ch").alias("feature", "w"))
    return lag.zero_lag_rows(w, "feature", lags=4, offset=1).groupBy("grp", "channel").agg(rounded(F.avg("w")).alias("w"))


REGIONS = {"front": [0, 3, 5], "back": [10, 12, 20]}


@query(f"""WITH {EMB}, h AS (SELECT grp, vec, ch, lag(ch) OVER (PARTITION BY grp ORDER BY vec) AS pv FROM emb),
r AS (SELECT 'front' AS region, [1, 4, 6] AS cs UNION ALL SELECT 'back', [11, 13, 21])
SELECT grp, vec, region, {rd("list_sum(list_transform(cs, lambda c: ch[c] - coalesce(pv[c], 0)))")} AS v FROM h, r""")
def channel_region_subset(spark: SparkSession, d: str) -> DataFrame:
    h = lag.block_hankel(array_signal(spark, d), ["grp"], ["vec"], "ch", 64, lags=2)
    sign = F.array([F.lit(1.0), F.lit(-1.0)] * 3)
    parts = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), lag.channel_lags(F.col("h"), c, 2).alias("sub")) for r, c in REGIONS.items()]))
    return h.select("grp", "vec", parts.alias("p")).select("grp", "vec", "p.region", rounded(dot(F.col("p.sub"), sign)).alias("v"))


@query(f"""WITH {EMB}, w AS (SELECT grp, ch[i + 1] AS w, i FROM emb, (SELECT unnest(range(64)) AS i))
SELECT CASE WHEN i < 40 THEN 'eeg' WHEN i < 44 THEN 'eog' ELSE 'gaze' END AS modality,
       CASE WHEN i < 40 THEN i WHEN i < 44 THEN i - 40 ELSE i - 44 END AS local, {rd("avg(w)")} AS w, count(*) AS n
FROM w GROUP BY ALL""")
def weights_split_by_modality(spark: SparkSession, d: str) -> DataFrame:
    w = array_signal(spark, d).select("grp", F.posexplode("ch").alias("feature", "w"))
    w = lag.split_features(w, "feature", [("eeg", 40), ("eog", 4), ("gaze", 20)])
    return w.groupBy("modality", F.col("local").cast("long").alias("local")).agg(rounded(F.avg("w")).alias("w"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIG} SELECT u, t, NOT bool_or(sacc) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS keep FROM sig""")
def mask_event_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return masks.event_mask(signal(spark, d), K, T, F.col("sacc"), before=1, after=2).select("u", "t", "keep")


@query(f"""WITH {SIG}
SELECT u, t, coalesce(bool_and(NOT sacc) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), true) AS keep FROM sig""")
def mask_expand_lag(spark: SparkSession, d: str) -> DataFrame:
    m = signal(spark, d).withColumn("one", ~F.col("sacc"))
    return masks.expand_mask(m, K, T, "one", lags=3, offset=1).select("u", "t", "keep")


@query(f"""WITH {SIG}, m AS (SELECT u, bool_and(NOT sacc) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS keep FROM sig)
SELECT u, {rd("1 - avg(CASE WHEN keep THEN 1.0 ELSE 0.0 END)")} AS loss FROM m GROUP BY u""")
def mask_data_loss(spark: SparkSession, d: str) -> DataFrame:
    m = masks.expand_mask(signal(spark, d).withColumn("one", ~F.col("sacc")), K, T, "one", lags=3, offset=1)
    return masks.data_loss(m, K, "keep").select("u", rounded("loss").alias("loss"))


@query(f"""WITH {SIG}, m AS (SELECT u, vid, t, x, CASE WHEN vid % 2 = 0 THEN 'test' ELSE 'train' END AS role, NOT sacc AS keep FROM sig)
SELECT u, role, count(*) AS n, count(*) FILTER (WHERE keep) AS n_kept, {rd("sum(CASE WHEN keep THEN x ELSE 0 END)")} AS s FROM m GROUP BY u, role""")
def mask_by_role(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).withColumns({"role": F.when(F.col("vid") % 2 == 0, "test").otherwise("train"), "keep": ~F.col("sacc")})
    parts = [masks.by_role(s, r).withColumn("role", F.lit(r)) for r in ("test", "train")]
    return parts[0].unionByName(parts[1]).groupBy("u", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("n_kept"), rounded(F.sum(F.when(F.col("keep"), F.col("x")).otherwise(0.0))).alias("s"))


@query(f"WITH {SIG} SELECT u, t, sacc AND NOT blink AS saccade FROM sig")
def saccade_refine(spark: SparkSession, d: str) -> DataFrame:
    return signal(spark, d).select("u", "t", masks.without_blinks("sacc", "blink").alias("saccade"))


@query(f"""WITH {SIG}, e AS (SELECT u, t, x, NOT bool_or(sacc) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS keep FROM sig)
SELECT u, count(*) AS n, {rd("sum(x)")} AS s FROM e WHERE keep GROUP BY u""")
def delete_near_events(spark: SparkSession, d: str) -> DataFrame:
    kept = masks.event_mask(signal(spark, d), K, T, F.col("sacc"), before=1, after=2).where("keep")
    return kept.groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"""WITH {SIG}, v AS (SELECT u, t, x - lag(x, 1, x) {OVER} AS dx, y - lag(y, 1, y) {OVER} AS dy FROM sig)
SELECT u, t, {rd("sqrt(dx * dx + dy * dy)")} AS vel FROM v""")
def velocity(spark: SparkSession, d: str) -> DataFrame:
    return clean.velocity(signal(spark, d), K, "t", "x", "y").select("u", "t", rounded("vel").alias("vel"))


@query(f"""WITH {EMB}, p AS (SELECT grp, vec, ch[1] - ch[2] AS v, ch[3] - ch[4] AS h FROM emb),
q AS (SELECT grp, vec, v - lag(v, 1, v) OVER (PARTITION BY grp ORDER BY vec) AS dv, h - lag(h, 1, h) OVER (PARTITION BY grp ORDER BY vec) AS dh FROM p)
SELECT grp, vec, {rd("sqrt(dv * dv + dh * dh)")} AS vel FROM q""")
def velocity_differential(spark: SparkSession, d: str) -> DataFrame:
    p = array_signal(spark, d).select("grp", "vec", (F.get("ch", 0) - F.get("ch", 1)).alias("v"), (F.get("ch", 2) - F.get("ch", 3)).alias("h"))
    return clean.velocity(p, ["grp"], "vec", "v", "h").select("grp", "vec", rounded("vel").alias("vel"))


def filled_sql(gap: str) -> str:
    """Linear fill of x where ``gap``; both neighbours, or the two nearest known points at an end."""
    return f"""WITH {SIG}, k AS (SELECT u, t, CASE WHEN {gap} THEN NULL ELSE x END AS x FROM sig),
known AS (SELECT u, t, x, lag(t) {OVER} AS pt, lag(x) {OVER} AS px, lead(t) {OVER} AS nt, lead(x) {OVER} AS nx FROM k WHERE x IS NOT NULL),
near AS (SELECT u, t, x, max(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                min(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM k)
SELECT n.u, n.t, CASE
  WHEN n.x IS NOT NULL THEN {rd("n.x")}
  WHEN n.a IS NOT NULL AND n.b IS NOT NULL THEN {rd("ka.x + (kb.x - ka.x) * (n.t - ka.t) / (kb.t - ka.t)")}
  WHEN n.b IS NULL AND ka.pt IS NOT NULL THEN {rd("ka.px + (ka.x - ka.px) * (n.t - ka.pt) / (ka.t - ka.pt)")}
  WHEN n.a IS NULL AND kb.nt IS NOT NULL THEN {rd("kb.x + (kb.nx - kb.x) * (n.t - kb.t) / (kb.nt - kb.t)")} END AS x
FROM near n LEFT JOIN known ka ON ka.u = n.u AND ka.t = n.a LEFT JOIN known kb ON kb.u = n.u AND kb.t = n.b"""


@query(filled_sql("blink"))
def blink_interpolate(spark: SparkSession, d: str) -> DataFrame:
    s = clean.blank(signal(spark, d), F.col("blink"), "x")
    return clean.fill_linear(s, K, "t", "x").select("u", "t", rounded("x").alias("x"))


@query(filled_sql("y > 60 OR t < 2"))
def gap_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    s = clean.blank(signal(spark, d), (F.col("y") > 60) | (F.col("t") < 2), "x")
    return clean.fill_linear(s, K, "t", "x").select("u", "t", rounded("x").alias("x"))


@query(f"""WITH {SIG} SELECT u, t, {rd("x - avg(x) OVER (PARTITION BY u)")} AS x, {rd("y - avg(y) OVER (PARTITION BY u)")} AS y FROM (SELECT * FROM sig WHERE t >= 5 AND t < n - 5)""")
def trim_and_center(spark: SparkSession, d: str) -> DataFrame:
    return clean.trim_and_center(signal(spark, d), K, "t", ["x", "y"], edge=5).select("u", "t", rounded("x").alias("x"), rounded("y").alias("y"))


@query(f"""WITH {SIG}, a AS (SELECT u, t, x, y, n // 20 + 1 AS k, n FROM sig), b AS (SELECT *, n // k AS base, n % k AS extra FROM a),
c AS (SELECT *, CASE WHEN t < extra * (base + 1) THEN t // (base + 1) ELSE extra + (t - extra * (base + 1)) // base END AS seg FROM b),
e AS (SELECT u, t, seg, x - avg(x) OVER (PARTITION BY u, seg) AS x, y - avg(y) OVER (PARTITION BY u, seg) AS y FROM c),
f AS (SELECT *, sqrt(sum(x * x + y * y) OVER (PARTITION BY u, seg)) AS nrm FROM e)
SELECT u, t, seg AS segment, {rd("x / nrm")} AS x, {rd("y / nrm")} AS y FROM f""")
def segment_normalize(spark: SparkSession, d: str) -> DataFrame:
    return clean.normalize_segments(signal(spark, d), K, "t", ["x", "y"], 20).select("u", "t", "segment", rounded("x").alias("x"), rounded("y").alias("y"))


@query(f"""WITH {SIG}, r AS (SELECT u, t, y, sum(CASE WHEN p IS NULL OR p <> y THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY t) AS run
  FROM (SELECT u, t, y, lag(y) {OVER} AS p FROM sig)),
g AS (SELECT u, run, y, min(t) AS a, max(t) AS b FROM r GROUP BY u, run, y),
h AS (SELECT *, lag(y) OVER (PARTITION BY u ORDER BY a) AS l, lead(y) OVER (PARTITION BY u ORDER BY a) AS rr FROM g)
SELECT u, (a + b) // 2 AS t, {rd("y")} AS y FROM h WHERE l < y AND rr < y""")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return clean.peaks(signal(spark, d), K, "t", "y").where("peak").select("u", "t", rounded("y").alias("y"))


@query(f"""WITH {EMB} SELECT vec, {rd("list_avg(ch)")} AS mean_before, {rd("ch[1] - list_avg(ch)")} AS c0, {rd("ch[64] - list_avg(ch)")} AS c63 FROM emb""")
def average_rereference(spark: SparkSession, d: str) -> DataFrame:
    r = array_signal(spark, d).withColumn("r", clean.average_reference(F.col("ch")))
    return r.select("vec", rounded(F.get("ch", 0) - F.get("r", 0)).alias("mean_before"), rounded(F.get("r", 0)).alias("c0"), rounded(F.get("r", 63)).alias("c63"))


@query(f"""WITH {SIG} SELECT u, t // 4 AS bucket, {rd("avg(x)")} AS x, {rd("avg(y)")} AS y FROM sig GROUP BY u, t // 4""")
def resample_bucket_mean(spark: SparkSession, d: str) -> DataFrame:
    return clean.bucket_mean(signal(spark, d), K, "t", ["x", "y"], 4).select("u", "bucket", rounded("x").alias("x"), rounded("y").alias("y"))


@query(f"""WITH {SIG} SELECT u, t // 12 AS trial, count(*) AS n, {rd("sum(x)")} AS s FROM sig WHERE t // 12 < n // 12 GROUP BY u, t // 12""")
def trials_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return segment.tumbling(signal(spark, d), K, "t", 12).groupBy("u", "trial").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


STARTS = [(0, 0), (1, 3), (2, 7), (3, 20), (4, 33)]


@query(f"""WITH {SIG}, st AS (SELECT * FROM (VALUES (0, 0), (1, 3), (2, 7), (3, 20), (4, 33)) v(trial, start))
SELECT u, CAST(trial AS BIGINT) AS trial, count(*) AS n, {rd("sum(x)")} AS s FROM sig JOIN st ON t >= start AND t < start + 10 GROUP BY u, trial""")
def trials_overlapping(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    starts = s.select("u").distinct().select("u", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("trial"), F.lit(b).cast("long").alias("start")) for a, b in STARTS])).alias("p")).select("u", "p.*")
    return segment.overlapping(s, K, "t", starts, 10).groupBy("u", "trial").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"""WITH {SIG}, st AS (SELECT u, n, i AS trial, (n * (i * 2 + 1)) // 11 AS start FROM (SELECT DISTINCT u, n FROM sig), (SELECT unnest(range(5)) AS i))
SELECT s.u, st.trial, min(t) AS first_t, {rd("sum(x)")} AS s, {rd("corr(x, y)")} AS r FROM sig s JOIN st ON s.u = st.u AND t >= start AND t < start + 8 GROUP BY s.u, st.trial""")
def trials_random_starts(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    n = s.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("trial"))
    starts = n.select("u", "trial", F.floor(F.col("n") * (F.col("trial") * 2 + 1) / 11).alias("start"))
    return segment.overlapping(s, K, "t", starts, 8).groupBy("u", "trial").agg(F.min("t").alias("first_t"), rounded(F.sum("x")).alias("s"), rounded(safe_corr("x", "y")).alias("r"))


@query(f"""WITH {SIG} SELECT u, t // (n // 4) AS block, count(*) AS n, {rd("sum(x)")} AS s FROM sig WHERE t // (n // 4) < 4 GROUP BY u, t // (n // 4)""")
def blocks_equal(spark: SparkSession, d: str) -> DataFrame:
    return segment.equal_blocks(signal(spark, d), K, "t", 4).groupBy("u", "block").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"WITH {SIG} SELECT u, (t + 7) % n AS pos, {rd('x')} AS x FROM sig")
def circular_shift(spark: SparkSession, d: str) -> DataFrame:
    return segment.rotate(signal(spark, d), K, "t", F.lit(7)).select("u", "pos", rounded("x").alias("x"))


@query(f"""WITH {SIG} SELECT k AS fold, u, CASE WHEN t // (n // 5) + 1 = k AND t // (n // 5) < 5 THEN 'test' ELSE 'train' END AS role, count(*) AS n, {rd("sum(x)")} AS s
FROM sig, (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL""")
def fold_kfold(spark: SparkSession, d: str) -> DataFrame:
    f = folds.roles(folds.contiguous(signal(spark, d), K, "t", 5), "fold", 5)
    return f.groupBy(F.col("k").alias("fold"), "u", "role").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"""WITH {SIG}, v AS (SELECT DISTINCT u, vid FROM sig), f AS (SELECT DISTINCT u, vid // 2 AS fold FROM v),
r AS (SELECT f.u, f.fold, v.vid, CASE WHEN v.vid // 2 = f.fold THEN 'test' ELSE 'train' END AS role FROM f JOIN v ON f.u = v.u)
SELECT r.u, r.fold, r.role, count(*) AS n, {rd("sum(x)")} AS s FROM r JOIN sig ON r.u = sig.u AND r.vid = sig.vid GROUP BY ALL""")
def fold_leave_out(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    return folds.leave_out(s, K, 2).join(s, ["u", "vid"]).groupBy("u", "fold", "role").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"""WITH {SIG} SELECT u, count(*) FILTER (WHERE t // (n // 4) = 1) AS n_test, count(*) FILTER (WHERE t // (n // 4) <> 1) AS n_train, {rd("sum(CASE WHEN t // (n // 4) = 1 THEN x ELSE 0 END)")} AS s_test FROM sig GROUP BY u""")
def fold_single_split(spark: SparkSession, d: str) -> DataFrame:
    test = F.col("fold").eqNullSafe(F.lit(2))
    f = folds.contiguous(signal(spark, d), K, "t", 4)
    return f.groupBy("u").agg(F.count_if(test).alias("n_test"), F.count_if(~test).alias("n_train"), rounded(F.sum(F.when(test, F.col("x")).otherwise(0.0))).alias("s_test"))


@query(f"""WITH {SIG}, v AS (SELECT u, vid, x, row_number() OVER (PARTITION BY u, vid ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY u, vid) AS c FROM sig)
SELECT k AS fold, u, count(*) FILTER (WHERE p // greatest(c // 3, 1) + 1 = k AND c // 3 > 0) AS n_test, count(*) AS n FROM v, (SELECT unnest(range(1, 4)) AS k) GROUP BY ALL""")
def fold_all_k(spark: SparkSession, d: str) -> DataFrame:
    v = lag.sequence_number(signal(spark, d), ["u", "vid"], T, "p")
    f = folds.roles(folds.contiguous(v, ["u", "vid"], "p", 3), "fold", 3)
    return f.groupBy(F.col("k").alias("fold"), "u").agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIG}, tr AS (SELECT u, t, x, row_number() {OVER} - 1 AS p, count(*) OVER (PARTITION BY u) AS c FROM sig WHERE t // (n // 5) <> 0)
SELECT u, CASE WHEN p < c // 4 THEN 'val' ELSE 'train' END AS part, count(*) AS n, {rd("sum(x)")} AS s FROM tr GROUP BY ALL""")
def fold_nested_validation(spark: SparkSession, d: str) -> DataFrame:
    train = folds.contiguous(signal(spark, d), K, "t", 5).where(~F.col("fold").eqNullSafe(F.lit(1)))
    nested = folds.nested_validation(lag.sequence_number(train, K, T, "p"), K, "p", 4)
    return nested.groupBy("u", "part").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"""WITH {SIG}, st AS (SELECT * FROM (VALUES (0, 0), (1, 15), (2, 30)) v(trial, start)),
p AS (SELECT u, trial, t, x, row_number() OVER (PARTITION BY u, trial ORDER BY t) - 1 AS pos FROM sig, st WHERE t < start - 3 OR t >= start + 13)
SELECT u, CAST(trial AS BIGINT) AS trial, count(*) AS n, max(pos) AS last_pos, {rd("sum(x * pos)", 4)} AS s FROM p GROUP BY u, trial""")
def distractor_exclusion(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    starts = s.select("u").distinct().select("u", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("trial"), F.lit(15 * i).cast("long").alias("start")) for i in range(3)])).alias("p")).select("u", "p.*")
    pool = segment.distractor_pool(s, K, "t", starts, length=10, margin=3)
    return pool.groupBy("u", "trial").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"), rounded(F.sum(F.col("x") * F.col("pos")), 4).alias("s"))


@query(f"""WITH {SIG} SELECT u, t, {rd("x / nullif(max(x) OVER (PARTITION BY u), 0)")} AS x, {rd("y / nullif(max(y) OVER (PARTITION BY u), 0)")} AS y FROM (SELECT * FROM sig WHERE t >= n - 20)""")
def peak_scale(spark: SparkSession, d: str) -> DataFrame:
    return clean.peak_scale(signal(spark, d), K, "t", ["x", "y"], 20).select("u", "t", rounded("x").alias("x"), rounded("y").alias("y"))


@query(f"""WITH {SIG}, e AS (SELECT *, least(45 + 20, n) AS hi FROM sig) SELECT u, min(t) AS first_t, count(*) AS n, {rd("sum(y)")} AS s FROM e WHERE t >= hi - 20 AND t < hi GROUP BY u""")
def feature_window_align(spark: SparkSession, d: str) -> DataFrame:
    return clean.align_window(signal(spark, d), K, "t", 45, 20).groupBy("u").agg(F.min("t").alias("first_t"), F.count(F.lit(1)).alias("n"), rounded(F.sum("y")).alias("s"))


@query(f"""WITH {EMB} SELECT grp, {rd("sqrt(sum(list_sum(list_transform(ch, lambda v: v * v))))")} AS norm FROM emb GROUP BY grp""")
def frobenius_band(spark: SparkSession, d: str) -> DataFrame:
    return array_signal(spark, d).groupBy("grp").agg(rounded(clean.frobenius(F.col("ch"))).alias("norm"))
