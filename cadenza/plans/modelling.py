"""Queries on fitted models: closed forms with SQL where one exists; tests hold most of the others against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.functions.expr import rounded, safe_corr
from cadenza.operators import clean, decide, folds, lag, masks, models, report, segment, signif
from cadenza.plans import experiments
from cadenza.plans.registry import EMB, SIG, query, rd
from cadenza.sources.adapters import array_signal, signal

K, T, G = ["u"], ["t"], ["grp"]


def arrays(df: DataFrame) -> DataFrame:
    return df.withColumns({"ax": F.array("x"), "ay": F.array("y"), "az": F.array("z")})


def fit_1d(df: DataFrame, keys: list[str], without: str | None = None) -> DataFrame:
    return models.cca_fit(df, keys, "ax", "ay", [1], [1], 1, shrink=False, without=without)


@query(f"WITH {SIG} SELECT u, {rd('abs(corr(x, y))')} AS r FROM sig GROUP BY u")
def cca_1x1(spark: SparkSession, d: str) -> DataFrame:
    return fit_1d(arrays(signal(spark, d)), K).select("u", rounded("r").alias("r"))


@query(f"WITH {SIG}, b AS (SELECT u, sum(x * y) / sum(x * x) AS w, sum(y * y) - sum(x * y)^2 / sum(x * x) AS e, count(*) AS n FROM sig GROUP BY u) SELECT u, {rd('w')} AS w, {rd('e / n', 4)} AS mse FROM b")
def encoder_mse_1d(spark: SparkSession, d: str) -> DataFrame:
    fit = models.least_squares_fit(arrays(signal(spark, d)), K, "ax", "ay", 1, 1)
    return fit.select("u", rounded(F.get("w", 0)).alias("w"), rounded("mse", 4).alias("mse"))


@query(f"WITH {SIG} SELECT u, {rd('stddev_samp(x)')} AS f FROM sig GROUP BY u")
def forward_model_1d(spark: SparkSession, d: str) -> DataFrame:
    return fit_1d(arrays(signal(spark, d)), K).select("u", rounded(F.abs(F.get("fa", 0))).alias("f"))


@query(f"""WITH {EMB} SELECT grp, vec, {rd("list_sum(list_transform(range(64), lambda i: ch[i + 1] * ((i % 5) - 2)))")} AS s0, {rd("list_sum(list_transform(range(64), lambda i: ch[i + 1] * ((i % 3) - 1)))")} AS s1 FROM emb""")
def projection_fixed_weights(spark: SparkSession, d: str) -> DataFrame:
    e = array_signal(spark, d)
    rows = [(g, [float(i % 5 - 2) for i in range(64)], [float(i % 3 - 1) for i in range(64)]) for g in range(10)]
    w = spark.createDataFrame(rows, "grp long, w0 array<double>, w1 array<double>")
    return models.project(e, w, ["grp"], {"s0": ("ch", "w0"), "s1": ("ch", "w1")}).select("grp", "vec", rounded("s0").alias("s0"), rounded("s1").alias("s1"))


# Leave-two-out: the sign that training gives the feature's filter decides the sign of test correlations.
DECODE = f"""{SIG}, whole AS (SELECT * FROM sig WHERE vid < n // 10), f AS (SELECT DISTINCT u, vid // 2 AS fold FROM whole),
fit AS (SELECT f.u, f.fold, CASE WHEN corr(x, y) < 0 THEN -1.0 ELSE 1.0 END AS sgn FROM f JOIN whole w ON f.u = w.u AND w.vid // 2 <> f.fold GROUP BY f.u, f.fold),
test AS (SELECT w.u, w.vid, max(sgn) * corr(x, y) AS a, max(sgn) * corr(x, z) AS b FROM whole w JOIN fit ON w.u = fit.u AND w.vid // 2 = fit.fold GROUP BY w.u, w.vid)"""


def leave_two_out(spark: SparkSession, d: str) -> DataFrame:
    """(u, vid, a, b): correlations of test recordings under filters trained on the other folds of the subject."""
    whole = arrays(segment.with_length(signal(spark, d), K, "n").where(F.col("vid") < F.floor(F.col("n") / 10)))
    rows = whole.withColumn("fold", F.floor(F.col("vid") / 2))
    w = fit_1d(rows, K, without="fold").select("u", "fold", "wa", "wb")
    p = models.project(rows, w, ["u", "fold"], {"px": ("ax", "wa"), "py": ("ay", "wb"), "pz": ("az", "wb")})
    return models.correlate(p, ["u", "vid"], {"a": ("px", "py"), "b": ("px", "pz")})


@query(f"WITH {DECODE} SELECT u, count(*) AS n, count(*) FILTER (WHERE a > b) AS n_correct, {rd('count(*) FILTER (WHERE a > b) / count(*)')} AS acc FROM test WHERE NOT isnan(a) GROUP BY u")
def decode_attention_1d(spark: SparkSession, d: str) -> DataFrame:
    both = leave_two_out(spark, d).select("u", F.array("a").alias("att"), F.array("b").alias("unatt"))
    return decide.accuracy(decide.label(both, "att", "unatt", 1), K).select("u", "n", "n_correct", rounded("acc").alias("acc"))


@query(f"""WITH {SIG}, whole AS (SELECT * FROM sig WHERE vid < n // 10), m AS (SELECT a.u, a.vid, corr(a.x, a.y) AS own, corr(a.x, b.y) AS other FROM whole a JOIN whole b ON a.u = b.u AND b.t = (a.t + 10) % ((a.n // 10) * 10) GROUP BY a.u, a.vid)
SELECT u, count(*) AS n, count(*) FILTER (WHERE own > other) AS n_correct FROM m WHERE NOT isnan(own) GROUP BY u""")
def decode_match_mismatch_1d(spark: SparkSession, d: str) -> DataFrame:
    whole = segment.tumbling(signal(spark, d), K, "t", 10).select("u", "vid", "t", "x", "y")
    other = segment.rotate(whole.select("u", "t", F.col("y").alias("y2")), K, "t", F.lit(-10)).select("u", F.col("pos").alias("t"), "y2")
    r = models.correlate(whole.join(other, ["u", "t"]), ["u", "vid"], {"own": ("x", "y"), "other": ("x", "y2")})
    both = r.select("u", F.array("own").alias("att"), F.array("other").alias("unatt"))
    return decide.accuracy(decide.label(both, "att", "unatt", 1), K).select("u", "n", "n_correct")


@query(f"""WITH {SIG}, m AS (SELECT *, NOT bool_or(sacc) OVER (PARTITION BY u ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS keep FROM sig),
fit AS (SELECT CASE WHEN corr(x, y) < 0 THEN -1.0 ELSE 1.0 END AS sgn FROM m WHERE keep) SELECT u, count(*) AS n, {rd("max(sgn) * corr(x, y)")} AS a, {rd("max(sgn) * corr(x, z)")} AS b FROM m, fit WHERE keep GROUP BY u""")
def pooled_train_1d(spark: SparkSession, d: str) -> DataFrame:
    kept = arrays(masks.event_mask(signal(spark, d), K, T, F.col("sacc"), before=0, after=1).where("keep")).withColumn("all", F.lit(0).cast("long"))
    p = models.project(kept, fit_1d(kept, ["all"]).select("all", "wa", "wb"), ["all"], {"px": ("ax", "wa"), "py": ("ay", "wb"), "pz": ("az", "wb")})
    return p.groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(safe_corr("px", "py")).alias("a"), rounded(safe_corr("px", "pz")).alias("b"))


@query(f"""WITH {SIG}, w AS (SELECT u, CASE WHEN corr(x, y) < 0 THEN -1.0 ELSE 1.0 END AS sgn FROM sig WHERE vid % 2 = 0 GROUP BY u) SELECT sig.u, {rd("max(sgn) * corr(x, y)")} AS r FROM sig JOIN w ON sig.u = w.u WHERE vid % 2 = 1 GROUP BY sig.u""")
def pretrained_weights_1d(spark: SparkSession, d: str) -> DataFrame:
    s = arrays(signal(spark, d))
    w = fit_1d(s.where("vid % 2 = 0"), K).select("u", "wa", "wb")
    p = models.project(s.where("vid % 2 = 1"), w, K, {"px": ("ax", "wa"), "py": ("ay", "wb")})
    return models.correlate(p, K, {"r": ("px", "py")}).select("u", rounded("r").alias("r"))


@query(f"WITH {SIG} SELECT u, {rd('1 / (1 + abs(corr(x, y)))')} AS lam FROM sig GROUP BY u")
def gcca_two_view_1d(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).withColumn("zz", F.array("x", "y"))
    return models.gcca_fit(s, K, "zz", [1, 1], 1, shrink=False).where("view = 0").select("u", rounded("lam").alias("lam"))


RHOS = [0.1, 1.0, 10.0]


@query(f"""WITH {SIG}, r AS (SELECT u, corr(x, y)^2 AS r2 FROM sig GROUP BY u), g AS (SELECT u, rho, (1 + rho - sqrt((1 + rho)^2 - 4 * rho * (1 - r2))) / (2 * rho * (1 - r2)) AS lam FROM r, (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS rho))
SELECT u, {rd("min_by(rho, lam)")} AS rho, {rd("min(lam)")} AS lam FROM g GROUP BY u""")
def rho_grid_1d(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).withColumn("zz", F.array("x", "y"))
    fits = models.gcca_sweep(s, K, "zz", [1, 1], 1, RHOS, shrink=False).where("view = 0").select("u", "rho", (-F.col("lam")).alias("metric"))
    best = report.best_of_grid(fits, K, "rho", "metric", last_wins=True)
    return best.select("u", rounded("rho").alias("rho"), rounded(-F.col("metric")).alias("lam"))


def halves(spark: SparkSession, d: str) -> DataFrame:
    """A multichannel recording per label, cut into four views of eight channels and a stimulus of two."""
    e = array_signal(spark, d)
    part = lambda a, n: F.slice("ch", a, n)
    return e.select("grp", "vec", F.col("vec").alias("t"), part(1, 32).alias("eeg"), part(33, 2).alias("stim"), part(35, 2).alias("other"), F.concat(part(1, 32), part(33, 2)).alias("both"))


@query()
def cca_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = models.cca_fit(halves(spark, d), G, "eeg", "stim", [32], [2], 2)
    return fit.select("grp", "component", rounded("r").alias("r"))


@query()
def gcca_isc(spark: SparkSession, d: str) -> DataFrame:
    """Four views of eight channels: GCCA filters per label, the projected views' mean pairwise correlation."""
    h = halves(spark, d)
    w = models.gcca_fit(h, G, "eeg", [8] * 4, 2).select("grp", "view", "component", "w")
    views = h.select("grp", "t", F.posexplode(F.array(*[F.slice("eeg", 8 * v + 1, 8) for v in range(4)])).alias("view", "ch")).withColumn("view", F.col("view").cast("long"))
    p = models.project(views, w, ["grp", "view"], {"s": ("ch", "w")})
    return models.intersubject(p, ["grp", "component"], "t", "view", "s").select("grp", "component", rounded("isc").alias("isc"), "n_views")


@query()
def multimod_gcca(spark: SparkSession, d: str) -> DataFrame:
    """Views of unequal width: two subjects by two modalities."""
    w = models.gcca_fit(halves(spark, d), G, "eeg", [12, 12, 4, 4], 2)
    split = lag.split_features(w.withColumn("feature", F.col("view")), "feature", [("eeg", 2), ("eog", 2)])
    return split.select("grp", "modality", "view", "component", rounded("lam").alias("lam"), rounded(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x), 4).alias("energy"))


@query()
def multimod_gcca_cv(spark: SparkSession, d: str) -> DataFrame:
    """Two subjects by two modalities on held-out folds: correlation between subjects of a modality, and between modalities of a subject.

    ``kind`` is isc (``of`` a modality, between subjects) or imc (``of`` a subject, between its modalities).
    """
    h = folded(spark, d, 3)
    dims = [12, 12, 4, 4]
    w = models.gcca_fit(h, G, "eeg", dims, 2, without="fold").select("grp", "fold", "view", "component", "w")
    starts = [sum(dims[:v]) for v in range(4)]
    views = F.array(*[F.struct(F.lit(v).cast("long").alias("view"), F.slice("eeg", starts[v] + 1, dims[v]).alias("ch")) for v in range(4)])
    p = models.project(h.where("fold is not null").select("grp", "fold", "seq", F.inline(views)), w, ["grp", "fold", "view"], {"s": ("ch", "w")})
    p = p.withColumns({"subject": F.concat(F.lit("s"), F.col("view") % 2), "modality": F.when(F.col("view") < 2, "eeg").otherwise("eog")})
    keys = ["grp", "fold", "component"]
    isc = models.intersubject(p, [*keys, "modality"], "seq", "subject", "s").select(*keys, F.lit("isc").alias("kind"), F.col("modality").alias("of"), "isc")
    imc = models.intersubject(p, [*keys, "subject"], "seq", "modality", "s").select(*keys, F.lit("imc").alias("kind"), F.col("subject").alias("of"), "isc")
    return isc.unionByName(imc).select(*keys, "kind", "of", rounded("isc").alias("r"))


def folded(spark: SparkSession, d: str, n: int = 2) -> DataFrame:
    """The recordings of ``halves``, numbered, in ``n`` contiguous folds; the remainder has none and only trains."""
    return folds.contiguous(lag.sequence_number(halves(spark, d), G, ["vec"]), G, "seq", n)


def cut(df: DataFrame, length: int) -> DataFrame:
    """Test rows in whole trials of ``length`` samples of their fold."""
    inside = lag.sequence_number(df.where("fold is not null"), ["grp", "fold"], ["seq"], "at")
    return segment.tumbling(inside, ["grp", "fold"], "at", length)


def as_views(name: str, *parts: Column) -> Column:
    """Structs (object, view, ch), one for each view."""
    return F.array(*[F.struct(F.lit(name).alias("object"), F.lit(v).cast("long").alias("view"), c.alias("ch")) for v, c in enumerate(parts)])


@query()
def multimod_decode(spark: SparkSession, d: str) -> DataFrame:
    """GCCA of two views and the attended stimulus on the other folds; per held-out trial, either object as the last view.

    The object whose ISC is larger is decided for; views and filters are the same for both.
    """
    h = folded(spark, d)
    w = models.gcca_fit(h, G, "both", [16, 16, 2], 1, without="fold").select("grp", "fold", "view", "w")
    eeg = [F.slice("eeg", 1, 16), F.slice("eeg", 17, 16)]
    views = F.concat(as_views("att", *eeg, F.col("stim")), as_views("unatt", *eeg, F.col("other")))
    rows = cut(h, 10).select("grp", "fold", "trial", "at", F.inline(views))
    p = models.project(rows, w, ["grp", "fold", "view"], {"p": ("ch", "w")})
    isc = models.intersubject(p, ["grp", "fold", "trial", "object"], "at", "view", "p")
    both = isc.groupBy("grp", "fold", "trial").agg(*[F.max(F.when(F.col("object") == o, F.col("isc"))).alias(o) for o in ("att", "unatt")])
    return both.select("grp", "fold", "trial", rounded("att").alias("att"), rounded("unatt").alias("unatt"), (F.col("att") > F.col("unatt")).alias("correct"))


@query()
def si_gcca(spark: SparkSession, d: str) -> DataFrame:
    fit = models.gcca_fit(halves(spark, d), G, "both", [8, 8, 8, 8, 2], 2, rho=2.0)
    return fit.select("grp", "view", "component", rounded("lam").alias("lam"))


SWEEP = [10.0**i for i in range(-4, 5)]


def stimulus_weight(h: DataFrame) -> DataFrame:
    """(grp, rho, isc): the stimulus weight whose filters, fitted on part train, correlate best on part val; the larger on ties."""
    w = models.gcca_sweep(h.where("part = 'train'"), G, "both", [16, 16, 2], 1, SWEEP).select("grp", "rho", "view", "w")
    views = as_views("", F.slice("eeg", 1, 16), F.slice("eeg", 17, 16), F.col("stim"))
    p = models.project(h.where("part = 'val'").select("grp", "seq", F.inline(views)), w, ["grp", "view"], {"p": ("ch", "w")})
    return report.best_of_grid(models.intersubject(p, ["grp", "rho"], "seq", "view", "p"), G, "rho", "isc", last_wins=True)


def validated(spark: SparkSession, d: str) -> DataFrame:
    return folds.nested_validation(lag.sequence_number(halves(spark, d), G, ["vec"]), G, "seq", 10)


@query()
def si_gcca_cv(spark: SparkSession, d: str) -> DataFrame:
    """Per label the stimulus weight that does best on the first tenth, fitted on the rest."""
    return stimulus_weight(validated(spark, d)).select("grp", "rho", rounded("isc").alias("isc"))


@query()
def si_gcca_cross_val(spark: SparkSession, d: str) -> DataFrame:
    """Stimulus-informed GCCA over three folds of what validation leaves, with the weight that validation chose.

    ISC over all views in training, from moments, and in test; the level is that of all views phase-scrambled, pooled over folds and components.
    """
    h = validated(spark, d)
    best = stimulus_weight(h).select("grp", "rho")
    rest = folds.contiguous(lag.sequence_number(h.where("part = 'train'"), G, ["seq"], "n"), G, "n", 3)
    w = models.gcca_sweep_scored(rest, G, "both", [16, 16, 2], 2, SWEEP, without="fold").join(best, ["grp", "rho"])
    part = lambda at, n: F.aggregate(F.zip_with(F.slice("both", at, n), F.slice("ws", at, n), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    keys = ["grp", "fold", "component"]
    p = rest.where("fold is not null").join(w, ["grp", "fold"]).select(*keys, "n", F.array(part(1, 16), part(17, 16), part(33, 2)).alias("ps"))
    long = p.select(*keys, "n", F.posexplode("ps").alias("view", "p"))
    test = models.intersubject(long, keys, "n", "view", "p").select(*keys, F.col("isc").alias("isc_test"))
    null = models.permuted(p, keys, "n", ["ps"], 20, seed=6)
    out = w.select(*keys, "rho", "isc_train").join(test, keys).join(signif.pooled_level(null, G, "r", 0.05), "grp")
    return out.select(*keys, "rho", *[rounded(c).alias(c) for c in ("isc_train", "isc_test", "level")])


@query()
def dcca_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = models.discriminative_fit(halves(spark, d), G, "stim", "other", "eeg", 2, 32, 2)
    return fit.select("grp", "component", rounded("lam").alias("lam"))


@query()
def dcca_fit_apart(spark: SparkSession, d: str) -> DataFrame:
    """The competitor is four channels wide, the signal two: each has filters of its own."""
    h = array_signal(spark, d).select("grp", *[F.slice("ch", at, n).alias(name) for name, at, n in (("eeg", 1, 32), ("stim", 33, 2), ("rival", 35, 4))])
    fit = models.discriminative_fit_apart(h, G, "stim", "rival", "eeg", (2, 4, 32), 2)
    return fit.select("grp", "component", rounded("lam").alias("lam"))


@query()
def dcca_decode(spark: SparkSession, d: str) -> DataFrame:
    """Filters from the other folds; per label, how many held-out trials correlate more with the signal than with its rival."""
    h = folded(spark, d)
    w = models.discriminative_fit(h, G, "stim", "other", "eeg", 2, 32, 1, without="fold").select("grp", "fold", "component", "ws", "wy")
    p = models.project(cut(h, 10), w, ["grp", "fold"], {"s": ("stim", "ws"), "c": ("other", "ws"), "y": ("eeg", "wy")})
    r = models.correlate(p, ["grp", "fold", "trial"], {"a": ("s", "y"), "b": ("c", "y")})
    both = r.select("grp", F.array("a").alias("att"), F.array("b").alias("unatt"))
    return decide.accuracy(decide.label(both, "att", "unatt", 1), G).select("grp", "n", "n_correct", rounded("acc").alias("acc"))


@query()
def gcca_then_cca(spark: SparkSession, d: str) -> DataFrame:
    """GCCA components of each view, then CCA of the first view's components with the stimulus."""
    h = halves(spark, d)
    w = models.gcca_fit(h, G, "eeg", [8] * 4, 3).where("view = 0").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("component", "w"))).alias("ws"))
    comps = h.join(w, "grp").withColumn("g", F.transform("ws", lambda x: F.aggregate(F.zip_with(F.slice("eeg", 1, 8), x["w"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
    return models.cca_fit(comps, G, "g", "stim", [3], [2], 2).select("grp", "component", rounded("r").alias("r"))


@query()
def phase_scramble(spark: SparkSession, d: str) -> DataFrame:
    out = models.per_series(signal(spark, d), K, "t", ["x", "y"], kernels.phase_scramble, seed=3)
    return out.select("u", "t", rounded("x").alias("x"), rounded("y").alias("y"))


@query()
def block_shuffle(spark: SparkSession, d: str) -> DataFrame:
    out = models.per_series(signal(spark, d), K, "t", ["x", "y"], lambda x, s: kernels.shuffle_blocks(x, 5, s), seed=3)
    return out.select("u", "t", rounded("x").alias("x"), rounded("y").alias("y"))


@query()
def bandpass(spark: SparkSession, d: str) -> DataFrame:
    out = models.per_series(signal(spark, d), K, "t", ["x"], lambda x, s: kernels.band_pass(x, 30.0, 1.0, 9.0))
    return out.select("u", "t", rounded("x").alias("x"))


@query()
def envelope(spark: SparkSession, d: str) -> DataFrame:
    out = models.per_series(signal(spark, d), K, "t", ["x"], lambda x, s: kernels.envelope(kernels.band_pass(x, 30.0, 5.0, 10.0)))
    return out.select("u", "t", rounded("x").alias("x"))


@query()
def preprocess_chain(spark: SparkSession, d: str) -> DataFrame:
    """High-pass 0.5 Hz, notch 10 Hz, resample to two thirds of the samples, normalise segments."""

    def chain(x: np.ndarray, s: int) -> np.ndarray:
        return kernels.resample(kernels.notch(kernels.band_pass(x, 30.0, 0.5, None), 30.0, 10.0), max(1, len(x) * 2 // 3))

    out = models.per_series(signal(spark, d), K, "t", ["x", "y"], chain)
    return clean.normalize_segments(out, K, "t", ["x", "y"], 20).select("u", "t", rounded("x").alias("x"), rounded("y").alias("y"))


@query()
def clean_features_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Gaps filled, then a cubic spline through the peaks."""
    s = clean.fill_linear(clean.blank(signal(spark, d), F.col("blink"), "x"), K, "t", "x")
    marked = clean.peaks(s, K, "t", "x").withColumn("pk", F.col("peak").cast("double"))

    def smooth(x: np.ndarray, seed: int) -> np.ndarray:
        at = np.flatnonzero(x[:, 1] > 0.5)
        out = x.copy()
        if len(at) >= 2:
            out[:, 0] = np.where(x[:, 1] > 0.5, x[:, 0], kernels.cubic(at.astype(float), x[at, 0], np.arange(len(x), dtype=float)))
        return out

    return models.per_series(marked, K, "t", ["x", "pk"], smooth).select("u", "t", rounded("x", 4).alias("x"))


@query()
def bootstrap_trials(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    n = s.groupBy("u").agg(F.count(F.lit(1)).alias("len"))
    starts = segment.bootstrap_starts(n, K, 10, per=6, seed=5)
    return segment.overlapping(s, K, "t", starts, 10).groupBy("u", "trial").agg(F.min("t").alias("start"), F.count(F.lit(1)).alias("n"), rounded(safe_corr("x", "y")).alias("r"))


@query()
def distractor_draw(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d)
    starts = s.select("u").distinct().select("u", F.lit(0).cast("long").alias("trial"), F.lit(12).cast("long").alias("start"))
    drawn = segment.draw_distractor(s, K, "t", starts, 10, 3, seed=5)
    return drawn.groupBy("u", "trial").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query()
def random_channel_subset(spark: SparkSession, d: str) -> DataFrame:
    """Four channels drawn per label, and their mean."""
    e = array_signal(spark, d).select("grp", F.posexplode("ch").alias("channel", "v"))
    drawn = segment.random_subset(e, ["grp"], "channel", 4, seed=2)
    return e.join(drawn, ["grp", "channel"]).groupBy("grp", F.col("channel").cast("long").alias("channel")).agg(rounded(F.avg("v")).alias("mean"))


@query()
def random_shift(spark: SparkSession, d: str) -> DataFrame:
    return segment.random_rotation(signal(spark, d), K, "t", least=5, seed=4).select("u", "pos", rounded("x").alias("x"))


@query()
def perm_test_corr(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's correlation, its phase-scrambled null's level at 5 %, and whether it passes."""
    s = signal(spark, d)
    null = models.permuted_correlations(s, K, "t", "x", "y", permutations=100, chunk=50, seed=9)
    level = signif.pooled_level(null.where(~F.isnan("r")), K, "r", 0.05)
    own = models.correlate(s, K, {"r": ("x", "y")})
    return own.join(level, "u").select("u", rounded("r").alias("r"), rounded("level").alias("level"), (F.abs("r") > F.col("level")).alias("significant"))


@query()
def wilcoxon_pvalue(spark: SparkSession, d: str) -> DataFrame:
    s = models.correlate(segment.tumbling(signal(spark, d), K, "t", 10), ["u", "trial"], {"a": ("x", "y"), "b": ("x", "z")})
    return signif.wilcoxon_p(signif.wilcoxon(s, K, "a", "b")).select("u", "n", rounded("w").alias("w"), rounded("p").alias("p"))


@query()
def mann_whitney_pvalue(spark: SparkSession, d: str) -> DataFrame:
    """Samples with events against those without, per recording half: p-values of all three alternatives, values rounded so that they tie."""
    s = signal(spark, d).select(F.col("u"), F.floor(F.col("t") / 25).alias("half"), "sacc", F.round("x", -1).alias("v"))
    out = signif.mann_whitney(s.withColumnRenamed("u", "subject"), ["subject", "half"], F.col("sacc"), "v")
    for name, alternative in (("above", "greater"), ("below", "less"), ("both", "two-sided")):
        out = signif.mann_whitney_p(out, alternative).withColumnRenamed("p", name)
    return out.select("subject", "half", "n1", "n2", "u", rounded("ties").alias("ties"), *[rounded(c).alias(c) for c in ("above", "below", "both")])


SETUP = experiments.Setup(width=2, lags_x=2, offset_x=1, lags_s=3, components=2, before=0, after=1)


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """Two channels and two objects' features over recordings of ten samples."""
    rival = F.pmod(F.col("y") * 37 + 11, F.lit(97.0))
    return signal(spark, d).select("u", "vid", "t", F.array("x", "z").alias("x"), F.array("y").alias("att"), F.array(rival).alias("unatt"), F.col("sacc").alias("event"))


@query()
def experiment_correlations(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.correlations(recordings(spark, d), SETUP, permutations=20)
    return r.select("u", "fold", "component", *[rounded(c).alias(c) for c in ("r_train", "att", "unatt", "level")])


@query()
def experiment_partial(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    r = experiments.correlations(recordings(spark, d), replace(SETUP, partial=True, lags_s=1), masked=True)
    return r.select("u", "fold", "component", *[rounded(c).alias(c) for c in ("r_train", "att", "unatt")])


@query()
def experiment_decoding(spark: SparkSession, d: str) -> DataFrame:
    acc = experiments.decoding(recordings(spark, d), SETUP, [5, 8], permutations=20, margin=1)
    return acc.select("u", "task", "trial_len", "n", "n_correct", *[rounded(c).alias(c) for c in ("acc", "p_value", "acc_sig", "level")])


@query()
def experiment_combined(spark: SparkSession, d: str) -> DataFrame:
    """Training on both objects' features as one side; the attended object's filters are tested."""
    from dataclasses import replace

    r = experiments.correlations(recordings(spark, d), replace(SETUP, combine=True), masked=True)
    return r.select("u", "fold", "component", *[rounded(c).alias(c) for c in ("r_train", "att", "unatt")])


@query()
def experiment_single_object(spark: SparkSession, d: str) -> DataFrame:
    rec = recordings(spark, d)
    w = experiments.single_object(rec.where("vid % 2 = 0"), SETUP)
    r = experiments.correlations(rec.where("vid % 2 = 1"), SETUP, weights=w)
    return r.select("u", "fold", "component", *[rounded(c).alias(c) for c in ("r_train", "att", "unatt")])


@query()
def experiment_saccade(spark: SparkSession, d: str) -> DataFrame:
    rec = recordings(spark, d)
    acc = experiments.saccade_study(rec.where("u % 2 = 0"), rec.where("u % 2 = 1"), SETUP, [5])
    return acc.select("u", "task", "trial_len", "n", "n_correct", rounded("acc").alias("acc"), rounded("loss").alias("loss"))


@query()
def experiment_saccade_control(spark: SparkSession, d: str) -> DataFrame:
    """The same with each recording's event samples in a random order."""
    rec = recordings(spark, d)
    acc = experiments.saccade_study(rec.where("u % 2 = 0"), rec.where("u % 2 = 1"), SETUP, [5], shuffled=True, seed=7)
    return acc.select("u", "task", "trial_len", "n", "n_correct", rounded("acc").alias("acc"), rounded("loss").alias("loss"))


@query()
def experiment_isc(spark: SparkSession, d: str) -> DataFrame:
    """All subjects, in groups of four: a group's width is what a kernel takes, whatever the number of subjects."""
    rec = recordings(spark, d).withColumn("grp", F.floor(F.col("u") / 4))
    r = experiments.intersubject(rec, 2, SETUP, "signal", permutations=20)
    return r.select("modality", "grp", "fold", "component", *[rounded(c).alias(c) for c in ("isc", "iscov", "level")], "n_views")


@query()
def experiment_isc_all(spark: SparkSession, d: str) -> DataFrame:
    """All subjects in one fit, by iteration: no kernel is wider than one subject. Samples that all subjects have count."""
    rec = recordings(spark, d).withColumn("grp", F.lit(0).cast("long"))
    r = experiments.intersubject(rec, 2, SETUP, "signal", iterate=True)
    return r.select("modality", "grp", "fold", "component", *[rounded(c, 4).alias(c) for c in ("isc", "iscov")], "n_views")
