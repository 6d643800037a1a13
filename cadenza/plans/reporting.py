"""Queries on result tables: reshaping, upserts, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.expr import rounded
from cadenza.operators import report, signif
from cadenza.plans.registry import EMB, RES, SIG, query, rd
from cadenza.plans.statistics import TESTS, pvalues
from cadenza.sources.adapters import array_signal, results, signal, table
from cadenza.sources.tables import append_new, parse_recording, upsert

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WIDE = f"{RES}, wide AS (SELECT modality, component, max(value) AS att, min(value) AS unatt FROM res GROUP BY modality, component)"


@query(f"WITH {WIDE} SELECT modality, component, 'att' AS kind, {rd('att')} AS r FROM wide UNION ALL SELECT modality, component, 'unatt', {rd('unatt')} FROM wide")
def report_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = results(spark, d).groupBy("modality", "component").agg(F.max("value").alias("att"), F.min("value").alias("unatt"))
    return report.to_long(wide, ["modality", "component"], ["att", "unatt"], "kind", "r").withColumn("r", rounded("r"))


@query(f"""WITH {RES} SELECT modality, {", ".join(f"{rd(f"max(CASE WHEN component = '{c}' THEN value END)")} AS best_{i}" for i, c in enumerate(PRIORITIES, 1))} FROM res GROUP BY modality""")
def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = report.to_wide(results(spark, d), ["modality"], "component", PRIORITIES, "value")
    return wide.select("modality", *[rounded(F.col(f"`{c}`")).alias(f"best_{i}") for i, c in enumerate(PRIORITIES, 1)])


@query(f"""WITH {RES}, old AS (SELECT subject, max(value) AS v FROM res WHERE component < '4' GROUP BY subject), new AS (SELECT subject, min(value) AS v FROM res WHERE component > '3' GROUP BY subject)
SELECT subject, {rd("v")} AS v FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE subject NOT IN (SELECT subject FROM new))""")
def result_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    old = r.where("component < '4'").groupBy("subject").agg(F.max("value").alias("v"))
    new = r.where("component > '3'").groupBy("subject").agg(F.min("value").alias("v"))
    return upsert(old, new, ["subject"]).select("subject", rounded("v").alias("v"))


@query(f"""WITH {RES}, old AS (SELECT modality, component, avg(value) AS v FROM res WHERE modality <> 'BUILDING' GROUP BY ALL), new AS (SELECT modality, component, max(value) AS v FROM res WHERE component < '3' GROUP BY ALL)
SELECT modality, component, {rd("v")} AS v FROM (SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.modality = n.modality AND o.component = n.component))""")
def upsert_modality(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    old = r.where("modality <> 'BUILDING'").groupBy("modality", "component").agg(F.avg("value").alias("v"))
    new = r.where("component < '3'").groupBy("modality", "component").agg(F.max("value").alias("v"))
    return upsert(old, new, ["modality", "component"], overwrite=False).select("modality", "component", rounded("v").alias("v"))


@query(f"""WITH {SIG}, a AS (SELECT u, t, x FROM sig WHERE u % 4 < 3), b AS (SELECT u, t, x FROM sig WHERE u % 4 > 1)
SELECT u, count(*) AS n, {rd("sum(x)")} AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE u NOT IN (SELECT u FROM a)) GROUP BY u""")
def append_new_subjects(spark: SparkSession, d: str) -> DataFrame:
    s = signal(spark, d).select("u", "t", "x")
    stored, incoming = s.where("u % 4 < 3"), s.where("u % 4 > 1")
    return stored.unionByName(append_new(stored, incoming, ["u"])).groupBy("u").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x")).alias("s"))


@query(f"""WITH {EMB} SELECT grp, vec, i AS component, CASE WHEN i % 2 = 0 THEN 'att' ELSE 'unatt' END AS kind, {rd("ch[i + 1]")} AS r FROM emb, (SELECT unnest(range(6)) AS i)""")
def corr_dict_long(spark: SparkSession, d: str) -> DataFrame:
    long = array_signal(spark, d).select("grp", "vec", F.posexplode(F.slice("ch", 1, 6)).alias("component", "r"))
    return long.select("grp", "vec", F.col("component").cast("long").alias("component"), F.when(F.col("component") % 2 == 0, "att").otherwise("unatt").alias("kind"), rounded("r").alias("r"))


NAMES = "concat('v', r_regionkey, '_v', r_regionkey + 1, '_v', CASE WHEN n_nationkey % 2 = 0 THEN r_regionkey ELSE r_regionkey + 1 END, '.set')"


@query(f"""WITH f AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN concat('v', r_regionkey, '.set') ELSE {NAMES} END AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT id, name, string_split(replace(name, '.set', ''), '_') AS parts FROM f)
SELECT CAST(id AS BIGINT) AS id, CAST(CASE len(parts) WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS n_objects, parts[len(parts)] AS att, CASE WHEN len(parts) = 3 THEN CASE WHEN parts[1] = parts[3] THEN parts[2] ELSE parts[1] END END AS unatt FROM p""")
def parse_recording_name(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    a, b = F.concat(F.lit("v"), F.col("r_regionkey").cast("string")), F.concat(F.lit("v"), (F.col("r_regionkey") + 1).cast("string"))
    last = F.when(F.col("n_nationkey") % 2 == 0, a).otherwise(b)
    name = F.when(F.col("n_nationkey") % 5 == 0, F.concat(a, F.lit(".set"))).otherwise(F.concat(a, F.lit("_"), b, F.lit("_"), last, F.lit(".set")))
    return j.select(F.col("n_nationkey").cast("long").alias("id"), *[c.alias(k) for k, c in parse_recording(name).items()])


@query("""SELECT c_custkey AS id, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER) AS number, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER), c_custkey) - 1 AS BIGINT) AS pos FROM customer""")
def natural_sort_extract(spark: SparkSession, d: str) -> DataFrame:
    """All customers in natural order. Ranges of 10,000 numbers are ranked apart and shifted by the ranges before."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), report.natural_key(F.col("c_name")).alias("number")).withColumn("b", F.floor(F.col("number") / 10_000))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = c.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.col("b").alias("to"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = report.ranked(c, ["b"], ["number", "id"])
    return inside.join(offsets, inside["b"].eqNullSafe(offsets["to"])).select("id", "number", (F.col("pos") + F.col("off")).cast("long").alias("pos"))


@query(f"""WITH {RES}, g AS (SELECT modality, subject % 9 AS grid, round(avg(value), 1) AS metric FROM res GROUP BY modality, subject % 9),
r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY metric DESC, grid) AS k FROM g) SELECT modality, grid, {rd("metric")} AS metric FROM r WHERE k = 1""")
def grid_argmax(spark: SparkSession, d: str) -> DataFrame:
    g = results(spark, d).groupBy("modality", (F.col("subject") % 9).alias("grid")).agg(F.round(F.avg("value"), 1).alias("metric"))
    return report.best_of_grid(g, ["modality"], "grid", "metric").select("modality", "grid", rounded("metric").alias("metric"))


@query(f"""WITH {RES}, s AS (SELECT modality, subject, max(value) > 350 AS hit FROM res GROUP BY modality, subject) SELECT modality, count(*) AS n_subjects, count(*) FILTER (WHERE hit) AS n_above FROM s GROUP BY modality""")
def sig_subject_count(spark: SparkSession, d: str) -> DataFrame:
    return report.subjects_above(results(spark, d), ["modality"], "subject", F.col("value"), F.lit(350.0))


@query(f"""WITH {RES}, a AS (SELECT subject, avg(value) AS a FROM res WHERE component = '1-URGENT' GROUP BY subject), b AS (SELECT subject, avg(value) AS b FROM res WHERE component = '5-LOW' GROUP BY subject)
SELECT a.subject, {rd("a")} AS a, {rd("b")} AS b FROM a JOIN b ON a.subject = b.subject""")
def paired_conditions(spark: SparkSession, d: str) -> DataFrame:
    p = report.paired(results(spark, d), "component", "1-URGENT", "5-LOW", ["subject"], "value")
    return p.select("subject", rounded("a").alias("a"), rounded("b").alias("b"))


@query(f"""WITH {RES} SELECT subject FROM res WHERE component = '1-URGENT' INTERSECT SELECT subject FROM res WHERE component = '2-HIGH'""")
def common_subjects(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return r.where("component = '1-URGENT'").select("subject").intersect(r.where("component = '2-HIGH'").select("subject"))


@query(f"""WITH {RES} SELECT 'overlay' AS mode, modality, {rd("avg(value)")} AS v FROM res WHERE component < '3' GROUP BY modality UNION ALL SELECT 'single', modality, {rd("avg(value)")} FROM res WHERE component >= '3' GROUP BY modality""")
def union_modalities(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    part = lambda cond, mode: r.where(cond).groupBy("modality").agg(rounded(F.avg("value")).alias("v")).withColumn("mode", F.lit(mode))
    return part("component < '3'", "overlay").unionByName(part("component >= '3'", "single"))


@query(f"""WITH {RES}, m AS (SELECT modality, subject, component, avg(value) AS v FROM res WHERE component < '3' GROUP BY ALL) SELECT modality, subject, {rd("sum(v)")} AS r FROM m GROUP BY modality, subject""")
def report_corr_summary(spark: SparkSession, d: str) -> DataFrame:
    m = results(spark, d).where("component < '3'").groupBy("modality", "subject", "component").agg(F.avg("value").alias("v"))
    return m.groupBy("modality", "subject").agg(rounded(F.sum("v")).alias("r"))


@query(f"""WITH {TESTS}, t AS (SELECT modality, min(p) * 100 AS low, avg(p) * 100 AS mean FROM tests GROUP BY modality)
SELECT CASE WHEN modality < 'C' THEN modality ELSE concat(modality, ' (CP)') END AS label, {rd("low")} AS low, {rd("mean")} AS mean FROM t""")
def report_condition_compare(spark: SparkSession, d: str) -> DataFrame:
    t = pvalues(spark, d).groupBy("modality").agg((F.min("p") * 100).alias("low"), (F.avg("p") * 100).alias("mean"))
    label = F.when(F.col("modality") < "C", F.col("modality")).otherwise(F.concat("modality", F.lit(" (CP)")))
    return t.select(label.alias("label"), rounded("low").alias("low"), rounded("mean").alias("mean"))


@query(f"""WITH {TESTS}, r AS (SELECT modality, p, p * count(*) OVER (PARTITION BY modality) / row_number() OVER (PARTITION BY modality ORDER BY p, subject) AS raw FROM tests)
SELECT modality, {rd("avg(p)")} AS mean_level, {rd("min(least(raw, 1.0))")} AS best_adjusted FROM r GROUP BY modality""")
def report_mean_sig(spark: SparkSession, d: str) -> DataFrame:
    adj = signif.benjamini_hochberg(pvalues(spark, d), ["modality"], "p", ["subject"])
    return adj.groupBy("modality").agg(rounded(F.avg("p")).alias("mean_level"), rounded(F.min("adjusted")).alias("best_adjusted"))
