"""Queries on joins, aggregates, trials, decisions and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.expr import binomial_critical, binomial_tail, correlation_p, rounded, safe_corr, top_sum
from cadenza.operators import clean, decide, lag, models, moments, report, segment, signif
from cadenza.plans.registry import EMB, NUM, RES, SIG, query, rd
from cadenza.sources.adapters import array_signal, numbers, results, signal, table

K, T = ["u"], ["t"]
OVER = "OVER (PARTITION BY u ORDER BY t)"
# Correlations of tumbling trials of ten samples: x with y (attended) and z (unattended), and with their lagged selves.
TRIALS = f"""{SIG}, lagged AS (SELECT *, lag(y, 1, CAST(0 AS DOUBLE)) {OVER} AS y1, lag(z, 1, CAST(0 AS DOUBLE)) {OVER} AS z1 FROM sig),
trials AS (SELECT u, t // 10 AS trial, corr(x, y) AS a, corr(x, z) AS b, corr(x, y1) AS a1, corr(x, z1) AS b1 FROM lagged WHERE t // 10 < n // 10 GROUP BY u, t // 10)"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), K, T, ["y", "z"], lags=2)
    pairs = {"a": ("x", "y_0"), "b": ("x", "z_0"), "a1": ("x", "y_1"), "b1": ("x", "z_1")}
    return models.correlate(segment.tumbling(h, K, "t", 10), ["u", "trial"], pairs)


def tail_sql(k: str, n: str) -> str:
    return f"least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))))"


def critical_sql(n: str, p: str) -> str:
    cdf = f"list_sum(list_transform(range(0, c + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))"
    return f"list_filter(range(0, {n} + 1), lambda c: {cdf} >= 1 - {p} - 1e-12)[1]"


@query(f"WITH {TRIALS} SELECT u, trial, {rd('a')} AS r_att, {rd('b')} AS r_unatt FROM trials")
def trial_corr_compete(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).select("u", "trial", rounded("a").alias("r_att"), rounded("b").alias("r_unatt"))


@query(f"""WITH {SIG}, h AS (SELECT u, t, n, y, x + coalesce(lag(x) {OVER}, 0) / 2 AS p FROM sig)
SELECT u, t // 10 AS trial, {rd("corr(p, y)")} AS r FROM h WHERE t // 10 < n // 10 GROUP BY u, t // 10""")
def trial_corr_transform_first(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), K, T, ["x"], lags=2).withColumn("p", F.col("x_0") + F.col("x_1") / 2)
    return segment.tumbling(h, K, "t", 10).groupBy("u", "trial").agg(rounded(safe_corr("p", "y")).alias("r"))


@query(f"""WITH {EMB} SELECT vec, {rd("list_sum(list_sort(ch, 'DESC')[1:2])")} AS top2, {rd("list_sort(ch, 'DESC')[1]")} AS top1 FROM emb""")
def top2_component_sum(spark: SparkSession, d: str) -> DataFrame:
    return array_signal(spark, d).select("vec", rounded(top_sum("ch", 2)).alias("top2"), rounded(top_sum("ch", 1)).alias("top1"))


def decided(spark: SparkSession, d: str) -> DataFrame:
    both = trials(spark, d).select("u", "trial", F.array("a", "a1").alias("att"), F.array("b", "b1").alias("unatt"))
    return decide.label(both, "att", "unatt", 2)


DECIDED = f"{TRIALS}, decided AS (SELECT u, trial, a, a + a1 > b + b1 AS correct FROM trials WHERE NOT isnan(a) AND NOT isnan(a1))"


@query(f"""WITH {DECIDED}, s AS (SELECT u, count(*) AS n, count(*) FILTER (WHERE correct) AS k FROM decided GROUP BY u)
SELECT u, n, k AS n_correct, {rd("k / n")} AS acc, {rd(tail_sql("k", "n"))} AS p_value, {rd(f"({critical_sql('n', '0.05')} + 1) / n")} AS acc_sig FROM s""")
def eval_compete_accuracy(spark: SparkSession, d: str) -> DataFrame:
    acc = decide.accuracy(decided(spark, d), K)
    return acc.select("u", "n", "n_correct", *[rounded(c).alias(c) for c in ("acc", "p_value", "acc_sig")])


@query(f"""WITH {DECIDED}, s AS (SELECT u % 10 AS grp, count(*) AS n, count(*) - count(*) FILTER (WHERE correct) AS k FROM decided GROUP BY u % 10)
SELECT grp, n, k AS n_correct, {rd("k / n")} AS acc, {rd(tail_sql("k", "n"))} AS p_value, {rd(f"({critical_sql('n', '0.05')} + 1) / n")} AS acc_sig FROM s""")
def eval_match_mismatch(spark: SparkSession, d: str) -> DataFrame:
    labelled = decided(spark, d).withColumn("grp", F.col("u") % 10)
    acc = decide.accuracy(labelled, ["grp"], trained_on_attended=False)
    return acc.select("grp", "n", "n_correct", *[rounded(c).alias(c) for c in ("acc", "p_value", "acc_sig")])


COUNTS = f"{RES}, c AS (SELECT subject % 50 AS g, count(*) AS n, count(*) FILTER (WHERE value > 140) AS k FROM res GROUP BY subject % 50)"


@query(f"WITH {COUNTS} SELECT g, n, k, {rd(tail_sql('k', 'n'))} AS p_value FROM c")
def binomial_pvalue(spark: SparkSession, d: str) -> DataFrame:
    c = results(spark, d).groupBy((F.col("subject") % 50).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 140).alias("k"))
    return c.select("g", "n", "k", rounded(binomial_tail(F.col("k"), F.col("n"))).alias("p_value"))


@query(f"WITH {COUNTS} SELECT g, n, {rd('(' + critical_sql('n', '0.05') + ' + 1) / n')} AS acc_sig FROM c")
def binomial_sig_accuracy(spark: SparkSession, d: str) -> DataFrame:
    c = results(spark, d).groupBy((F.col("subject") % 50).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("g", "n", rounded((binomial_critical(F.col("n"), 0.05) + 1) / F.col("n")).alias("acc_sig"))


@query(f"""WITH {RES}, r AS (SELECT modality, abs(value - 140) AS v, row_number() OVER (PARTITION BY modality ORDER BY abs(value - 140) DESC) AS k, count(*) OVER (PARTITION BY modality) AS n FROM res)
SELECT modality, {rd("v")} AS level FROM r WHERE k = CAST(floor(n * 0.05) AS BIGINT)""")
def sig_level_pooled(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("r", F.col("value") - 140)
    return signif.pooled_level(r, ["modality"], "r", 0.05).select("modality", rounded("level").alias("level"))


@query(f"""WITH {RES}, r AS (SELECT component, abs(value - 140) AS v, row_number() OVER (PARTITION BY component ORDER BY abs(value - 140) DESC) AS k, count(*) OVER (PARTITION BY component) AS n FROM res)
SELECT component, {rd("v")} AS level FROM r WHERE k = CAST(floor(n * 0.01) AS BIGINT)""")
def sig_level_component(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("r", F.col("value") - 140)
    return signif.pooled_level(r, ["component"], "r", 0.01).select("component", rounded("level").alias("level"))


@query(f"""WITH {RES}, r AS (SELECT modality, value AS v, row_number() OVER (PARTITION BY modality ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY modality) AS n FROM res)
SELECT modality, {rd("v")} AS level FROM r WHERE k = CAST(floor(n * 0.975) AS BIGINT)""")
def acc_permutation_threshold(spark: SparkSession, d: str) -> DataFrame:
    return signif.ascending_level(results(spark, d), ["modality"], "value", 0.975).select("modality", rounded("level").alias("level"))


@query(f"""WITH {RES}, r AS (SELECT component, value AS v, row_number() OVER (PARTITION BY component ORDER BY value DESC) AS k FROM res)
SELECT component, {rd("v")} AS level FROM r WHERE k = 7""")
def order_statistic(spark: SparkSession, d: str) -> DataFrame:
    return signif.order_statistic(results(spark, d), ["component"], F.col("value"), F.lit(7)).select("component", rounded("level").alias("level"))


SHIFTS = [(0, 0.25), (1, 0.4), (2, 0.5), (3, 0.6), (4, 0.75)]


@query(f"""WITH {TRIALS}, s AS (SELECT * FROM (VALUES (0, 0.25), (1, 0.4), (2, 0.5), (3, 0.6), (4, 0.75)) v(perm, shift)),
c AS (SELECT *, count(*) OVER (PARTITION BY u) AS m FROM trials),
j AS (SELECT x.u, s.perm, x.a, y.b FROM c x, s, c y WHERE x.u = y.u AND y.trial = (x.trial + CAST(floor(CAST(s.shift AS DOUBLE) * x.m) AS BIGINT)) % x.m)
SELECT u, CAST(perm AS BIGINT) AS perm, count(*) AS n, {rd("avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END)")} AS acc FROM j GROUP BY u, perm""")
def permute_trial_rotation(spark: SparkSession, d: str) -> DataFrame:
    shifts = spark.createDataFrame(SHIFTS, "perm long, shift double")
    return decide.rotated_accuracy(trials(spark, d), K, "trial", "a", "b", shifts).select("u", "perm", "n", rounded("acc").alias("acc"))


TESTS = f"{RES}, tests AS (SELECT modality, subject, avg(value % 1) AS p FROM res GROUP BY modality, subject)"


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("modality", "subject").agg(F.avg(F.col("value") % 1).alias("p"))


@query(f"""WITH {TESTS}, r AS (SELECT *, p * count(*) OVER (PARTITION BY modality) / row_number() OVER (PARTITION BY modality ORDER BY p, subject) AS raw FROM tests)
SELECT modality, subject, {rd("least(1.0, min(raw) OVER (PARTITION BY modality ORDER BY p, subject ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS adjusted FROM r""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    adj = signif.benjamini_hochberg(pvalues(spark, d), ["modality"], "p", ["subject"])
    return adj.select("modality", "subject", rounded("adjusted").alias("adjusted"))


@query(f"""WITH {TRIALS}, dd AS (SELECT u, round(a - b, 2) AS dv FROM trials WHERE round(a - b, 2) <> 0),
r AS (SELECT u, dv, rank() OVER (PARTITION BY u ORDER BY abs(dv)) + (count(*) OVER (PARTITION BY u, abs(dv)) - 1) / 2 AS rk FROM dd)
SELECT u, count(*) AS n, {rd("sum(CASE WHEN dv > 0 THEN rk ELSE 0 END)")} AS w FROM r GROUP BY u""")
def wilcoxon_statistic(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).select("u", F.round(F.col("a") - F.col("b"), 2).alias("dv"), F.lit(0.0).alias("zero"))
    return signif.wilcoxon(t, K, "dv", "zero").select("u", "n", rounded("w").alias("w"))


@query(f"""WITH {RES}, r AS (SELECT component, modality IN ('BUILDING', 'MACHINERY') AS f, rank() OVER (PARTITION BY component ORDER BY round(value)) + (count(*) OVER (PARTITION BY component, round(value)) - 1) / 2 AS rk FROM res)
SELECT component, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, {rd("sum(CASE WHEN f THEN rk ELSE 0 END) - count(*) FILTER (WHERE f) * (count(*) FILTER (WHERE f) + 1) / 2", 3)} AS u FROM r GROUP BY component""")
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("v", F.round("value"))
    return signif.mann_whitney(r, ["component"], F.col("modality").isin("BUILDING", "MACHINERY"), "v").select("component", "n1", "n2", rounded("u", 3).alias("u"))


@query(f"""WITH {EMB}, w AS (SELECT grp, vec, i, ch[i + 1] AS v FROM emb, (SELECT unnest(range(64)) AS i))
SELECT a.grp, a.i, b.i AS j, {rd("covar_samp(a.v, b.v)")} AS cov FROM w a JOIN w b ON a.grp = b.grp AND a.vec = b.vec AND a.i <= b.i GROUP BY ALL""")
def cov_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return moments.covariance_long(array_signal(spark, d), ["grp"], "ch", 64).select("grp", "i", "j", rounded("cov").alias("cov"))


@query(f"""WITH {NUM} SELECT flag, {rd("covar_samp(q, p)")} AS qp, {rd("covar_samp(d, tax)")} AS dt, {rd("0.0")} AS off, {rd("var_samp(q)")} AS qq, {rd("var_samp(tax)")} AS tt FROM num GROUP BY flag""")
def cov_block_diagonal(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.kernels import block_diagonal

    rows = numbers(spark, d).select("flag", models.as_array(["q", "p", "d", "tax"]).alias("z"))

    def kernel(m: moments.Moments) -> list[tuple]:
        c = block_diagonal(m.cov, [2, 2])
        return [(c[0, 1], c[2, 3], c[0, 2], c[0, 0], c[3, 3])]

    out = moments.fit_by(rows, ["flag"], "z", [2, 2], kernel, "qp double, dt double, off double, qq double, tt double")
    return out.select("flag", *[rounded(c).alias(c) for c in ("qp", "dt", "off", "qq", "tt")])


LW = ["q", "p", "d", "tax"]


@query(f"""WITH {NUM}, m AS (SELECT flag, avg(q) AS mq, avg(p) AS mp, avg(d) AS md, avg(tax) AS mt, count(*) AS n,
  var_pop(q) + var_pop(p) + var_pop(d) + var_pop(tax) AS tr,
  var_pop(q)^2 + var_pop(p)^2 + var_pop(d)^2 + var_pop(tax)^2 + 2 * (covar_pop(q, p)^2 + covar_pop(q, d)^2 + covar_pop(q, tax)^2 + covar_pop(p, d)^2 + covar_pop(p, tax)^2 + covar_pop(d, tax)^2) AS ss,
  covar_pop(q, p) AS qp FROM num GROUP BY flag),
f AS (SELECT num.flag, sum(((q - mq)^2 + (p - mp)^2 + (d - md)^2 + (tax - mt)^2)^2) AS fourth FROM num JOIN m ON num.flag = m.flag GROUP BY num.flag),
s AS (SELECT m.*, least(1, greatest(0, (fourth / n - ss) / n / (ss - tr^2 / 4))) AS share FROM m JOIN f ON m.flag = f.flag)
SELECT flag, {rd("share", 9)} AS share, {rd("(1 - share) * qp", 4)} AS qp, {rd("tr", 4)} AS trace FROM s""")
def ledoit_wolf_cov(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.kernels import shrink_blocks

    rows = numbers(spark, d).select("flag", models.as_array(LW).alias("z"))

    def kernel(m: moments.Moments) -> list[tuple]:
        c = shrink_blocks(m.cov, m.n, [4], m.fourths)
        pop = m.cov * (m.n - 1) / m.n
        return [(1 - c[0, 1] / pop[0, 1], c[0, 1], c.trace())]

    out = moments.fit_by(rows, ["flag"], "z", [4], kernel, "share double, qp double, trace double")
    return out.select("flag", rounded("share", 9).alias("share"), rounded("qp", 4).alias("qp"), rounded("trace", 4).alias("trace"))


WHOLE = f"""{SIG}, whole AS (SELECT * FROM sig WHERE vid < n // 10),
pairs AS (SELECT a.vid, a.u AS i, b.u AS j, corr(a.x, b.x) AS r, covar_samp(a.x, b.x) AS c FROM whole a JOIN whole b ON a.vid = b.vid AND a.t = b.t AND a.u < b.u GROUP BY ALL)"""


def whole_videos(spark: SparkSession, d: str) -> DataFrame:
    return segment.with_length(signal(spark, d), K, "n").where(F.col("vid") < F.floor(F.col("n") / 10))


@query(f"WITH {WHOLE} SELECT vid, {rd('avg(r)')} AS isc, count(*) AS n_pairs FROM pairs GROUP BY vid")
def isc_pairwise(spark: SparkSession, d: str) -> DataFrame:
    isc = models.intersubject(whole_videos(spark, d), ["vid"], "t", "u", "x").where("n_views > 1")
    return isc.select("vid", rounded("isc").alias("isc"), F.floor(F.col("n_views") * (F.col("n_views") - 1) / 2).alias("n_pairs"))


@query(f"""WITH {SIG}, whole AS (SELECT *, t % 10 AS at FROM sig WHERE vid < n // 10),
pairs AS (SELECT a.vid, a.at // 5 AS trial, a.u AS i, b.u AS j, corr(a.x, b.x) AS r FROM whole a JOIN whole b ON a.vid = b.vid AND a.t = b.t AND a.u < b.u GROUP BY ALL)
SELECT vid, trial, {rd('avg(r)')} AS isc, count(*) AS n_pairs FROM pairs GROUP BY vid, trial""")
def isc_trials(spark: SparkSession, d: str) -> DataFrame:
    """Inter-subject correlation of each trial of five samples of a recording."""
    whole = whole_videos(spark, d).withColumn("at", F.col("t") % 10)
    isc = models.intersubject_trials(whole, ["vid"], "at", "u", "x", 5).where("n_views > 1")
    return isc.select("vid", "trial", rounded("isc").alias("isc"), F.floor(F.col("n_views") * (F.col("n_views") - 1) / 2).alias("n_pairs"))


@query()
def correlation_pvalue(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's correlation of the signal with a feature and its two-sided p-value."""
    r = signal(spark, d).groupBy("u").agg(safe_corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("u", "n", rounded("r").alias("r"), rounded(correlation_p(F.col("r"), F.col("n"))).alias("p"))


@query(f"WITH {WHOLE} SELECT vid, {rd('avg(c)', 4)} AS iscov FROM pairs GROUP BY vid")
def iscov_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return models.intersubject(whole_videos(spark, d), ["vid"], "t", "u", "x").where("n_views > 1").select("vid", rounded("iscov", 4).alias("iscov"))


@query(f"""WITH {SIG}, r AS (SELECT u, corr(x, y) AS a, corr(x, z) AS b FROM sig GROUP BY u)
SELECT u, {rd("a * a + b * b")} AS tsc, {rd("sqrt(greatest(2 - a * a - b * b, 0))")} AS ch_dist FROM r""")
def tsc_chordal(spark: SparkSession, d: str) -> DataFrame:
    r = models.correlate(signal(spark, d), K, {"a": ("x", "y"), "b": ("x", "z")})
    tsc = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    return r.select("u", rounded(tsc).alias("tsc"), rounded(F.sqrt(F.greatest(F.lit(2.0) - tsc, F.lit(0.0)))).alias("ch_dist"))


@query(f"WITH {SIG}, b AS (SELECT u, sum(x * y) / sum(y * y) AS b FROM sig GROUP BY u) SELECT sig.u, t, {rd('x - b * y')} AS res FROM sig JOIN b ON sig.u = b.u")
def regress_out_1d(spark: SparkSession, d: str) -> DataFrame:
    return moments.regress_out(signal(spark, d), K, "x", "y", "res").select("u", "t", rounded("res").alias("res"))


@query(f"""WITH {EMB}, e AS (SELECT grp, ch[1] AS x, ch[2] - ch[3] AS c FROM emb), b AS (SELECT grp, sum(x * c) / sum(c * c) AS b, sum(x * x) AS xx FROM e GROUP BY grp)
SELECT e.grp, {rd("sum((x - b * c) ^ 2)")} AS left_over, {rd("max(b)")} AS b FROM e JOIN b ON e.grp = b.grp GROUP BY e.grp""")
def eog_regress_1d(spark: SparkSession, d: str) -> DataFrame:
    e = array_signal(spark, d).select("grp", F.get("ch", 0).alias("x"), (F.get("ch", 1) - F.get("ch", 2)).alias("c"))
    r = moments.regress_out(e, ["grp"], "x", "c", "res").withColumn("b", (F.col("x") - F.col("res")) / F.col("c"))
    return r.groupBy("grp").agg(rounded(F.sum(F.pow("res", F.lit(2.0)))).alias("left_over"), rounded(F.max("b")).alias("b"))


@query(f"""WITH {SIG}, b AS (SELECT u, sum(x * z) / nullif(sum(z * z), 0) AS bx, sum(y * z) / nullif(sum(z * z), 0) AS bz FROM sig GROUP BY u)
SELECT sig.u, {rd("corr(x - coalesce(bx, 0) * z, y - coalesce(bz, 0) * z)")} AS r FROM sig JOIN b ON sig.u = b.u GROUP BY sig.u""")
def partial_corr(spark: SparkSession, d: str) -> DataFrame:
    s = moments.regress_out(moments.regress_out(signal(spark, d), K, "x", "z", "rx"), K, "y", "z", "ry")
    return models.correlate(s, K, {"r": ("rx", "ry")}).select("u", rounded("r").alias("r"))


@query(f"""WITH {SIG}, h AS (SELECT u, vid, x, lag(x, 1, CAST(0 AS DOUBLE)) OVER (PARTITION BY u, vid ORDER BY t) AS x1, z + 1 AS c FROM sig),
b AS (SELECT u, vid, sum(x * c) / sum(c * c) AS b0, sum(x1 * c) / sum(c * c) AS b1 FROM h GROUP BY u, vid)
SELECT h.u, h.vid, {rd("sum((x - b0 * c) ^ 2)", 4)} AS s0, {rd("sum((x1 - b1 * c) ^ 2)", 4)} AS s1 FROM h JOIN b ON h.u = b.u AND h.vid = b.vid GROUP BY h.u, h.vid""")
def regress_lagged_confound_1d(spark: SparkSession, d: str) -> DataFrame:
    h = lag.hankel(signal(spark, d), ["u", "vid"], T, ["x"], lags=2)
    h = h.select("u", "vid", F.array("x_0", "x_1").alias("h"), F.array(F.col("z") + 1).alias("c"))
    r = moments.regress_out_block(h, ["u", "vid"], "h", 2, "c", 1, "res")
    return r.groupBy("u", "vid").agg(*[rounded(F.sum(F.pow(F.get("res", i), F.lit(2.0))), 4).alias(f"s{i}") for i in (0, 1)])


@query(f"WITH {SIG} SELECT u, {rd('avg(x)')} AS mx, {rd('avg(y)')} AS my, count(*) AS n FROM sig GROUP BY u")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    return signal(spark, d).groupBy("u").agg(rounded(F.avg("x")).alias("mx"), rounded(F.avg("y")).alias("my"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RES} SELECT modality, {rd("min(value)")} AS low, {rd("quantile_cont(value, 0.25)")} AS q1, {rd("median(value)")} AS med, {rd("quantile_cont(value, 0.75)")} AS q3,
  {rd("max(value)")} AS high, {rd("avg(value)")} AS mean, count(*) AS n FROM res GROUP BY modality""")
def median_quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = report.quartiles(results(spark, d), ["modality"], "value")
    return q.select("modality", *[rounded(c).alias(c) for c in ("low", "q1", "med", "q3", "high", "mean")], "n")


@query(f"WITH {SIG} SELECT kind, count(*) AS n, count(DISTINCT u) AS n_subjects FROM sig GROUP BY kind")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_subjects"))


@query(f"WITH {SIG} SELECT u, t, {rd('sum(x) OVER (PARTITION BY u ORDER BY t)', 4)} AS total FROM sig")
def running_sum(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("u").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return signal(spark, d).select("u", "t", rounded(F.sum("x").over(w), 4).alias("total"))


@query(f"WITH {SIG} SELECT u, t, row_number() OVER (PARTITION BY u ORDER BY x DESC, t) - 1 AS pos FROM sig")
def rank_argsort(spark: SparkSession, d: str) -> DataFrame:
    return report.ranked(signal(spark, d), K, [F.desc("x"), F.col("t")]).select("u", "t", "pos")


@query(f"""WITH {SIG}, a AS (SELECT u, t, kind, x FROM sig WHERE kind IN ('click', 'view')) SELECT kind, count(*) AS n, {rd("sum(x)", 4)} AS s FROM a WHERE u % 3 = 1 GROUP BY kind""")
def filter_eq_isin(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).where(F.col("kind").isin("click", "view") & (F.col("u") % 3 == 1))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x"), 4).alias("s"))


@query(f"WITH {SIG} SELECT t, {rd('x')} AS signal, {rd('y')} AS feature, 'subject 7' AS label FROM sig WHERE u = 7")
def subject_column_select(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).where("u = 7")
    return s.select("t", rounded("x").alias("signal"), rounded("y").alias("feature"), F.lit("subject 7").alias("label"))


@query(f"""WITH {SIG}, m AS (SELECT u, t, CASE WHEN y > 80 THEN CAST('NaN' AS DOUBLE) ELSE y END AS y, z FROM sig) SELECT u, count(*) AS n, {rd("sum(y)")} AS s FROM m WHERE NOT isnan(y) GROUP BY u""")
def nan_row_drop(spark: SparkSession, d: str) -> DataFrame:
    m = signal(spark, d).withColumn("att", F.array(F.when(F.col("y") > 80, F.lit(float("nan"))).otherwise(F.col("y")), F.col("t").cast("double")))
    return decide.drop_undefined(m, "att").groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.get("att", 0))).alias("s"))


@query(f"""WITH {SIG}, stim AS (SELECT t, avg(y) AS f FROM sig GROUP BY t) SELECT u, {rd("corr(x, f)")} AS r, count(*) AS n FROM sig JOIN stim ON sig.t = stim.t GROUP BY u""")
def broadcast_stim_join(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    stim = s.groupBy("t").agg(F.avg("y").alias("f"))
    return s.join(stim, "t").groupBy("u").agg(rounded(safe_corr("x", "f")).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIG}, a AS (SELECT u, t, x FROM sig WHERE t % 2 = 0 OR t % 3 = 0), b AS (SELECT u, t, y FROM sig WHERE t % 5 <> 0)
SELECT a.u, count(*) AS n, {rd("sum(x * y)", 3)} AS s, CAST(2 AS BIGINT) AS width FROM a JOIN b ON a.u = b.u AND a.t = b.t GROUP BY a.u""")
def stack_modalities(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    a = s.where("t % 2 = 0 OR t % 3 = 0").select("u", "t", F.array("x").alias("p"))
    b = s.where("t % 5 <> 0").select("u", "t", F.array("y").alias("q"))
    both = a.join(b, ["u", "t"]).withColumn("ch", F.concat("p", "q"))
    return both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.get("ch", 0) * F.get("ch", 1)), 3).alias("s"), F.max(F.size("ch")).cast("long").alias("width"))


@query(f"""WITH {SIG}, v AS (SELECT u, list(DISTINCT t ORDER BY t) FILTER (WHERE sacc) AS a, list(DISTINCT t ORDER BY t) FILTER (WHERE blink) AS b FROM sig GROUP BY u)
SELECT u, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS n_union, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS n_except,
       len(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x))) AS n_both FROM v""")
def setops_index(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    a, b = s.where("sacc").select("u", "t"), s.where("blink").select("u", "t")
    counted = lambda x, n: x.groupBy("u").agg(F.count(F.lit(1)).alias(n))
    out = s.select("u").distinct()
    for n, x in (("n_union", a.union(b).distinct()), ("n_except", a.exceptAll(b)), ("n_both", a.intersect(b))):
        out = out.join(counted(x, n), "u", "left")
    return out.fillna(0)


@query(f"""WITH {DECIDED}, s AS (SELECT u, trial, correct, row_number() OVER (PARTITION BY u ORDER BY a, trial) AS k, count(*) OVER (PARTITION BY u) AS n FROM decided)
SELECT p.u, p.trial, count(*) AS n_above, {rd("avg(CASE WHEN q.correct THEN 1.0 ELSE 0.0 END)")} AS acc_above FROM s p JOIN s q ON p.u = q.u AND q.k > p.k GROUP BY p.u, p.trial""")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    labelled = decided(spark, d).withColumn("sim", F.get("att", 0))
    return decide.threshold_curve(labelled, K, "sim", ["trial"]).select("u", "trial", "n_above", rounded("acc_above").alias("acc_above"))
