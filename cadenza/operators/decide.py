"""Decisions from correlations: which of two objects is attended, how often that is right, and whether by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.expr import binomial_critical, binomial_tail, top_sum


def drop_undefined(df: DataFrame, values: str) -> DataFrame:
    """Rows whose array has no null and no NaN."""
    return df.where(~F.exists(F.col(values), lambda v: v.isNull() | F.isnan(v)))


def label(df: DataFrame, att: str, unatt: str, components: int = 2, out: str = "correct") -> DataFrame:
    """True where the best ``components`` correlations with the attended object sum to strictly more."""
    return drop_undefined(df, att).withColumn(out, top_sum(att, components) > top_sum(unatt, components))


def accuracy(labelled: DataFrame, keys: list[str], correct: str = "correct", trained_on_attended: bool = True, p: float = 0.05) -> DataFrame:
    """(keys, n, n_correct, acc, p_value, acc_sig): accuracy, its binomial p-value, and the accuracy that is significant.

    With filters trained on the unattended object the count of correct trials is n less the count of labels.
    """
    hits = F.sum(F.col(correct).cast("long"))
    n = F.count(F.lit(1))
    return rated(labelled.groupBy(*keys).agg(n.alias("n"), (hits if trained_on_attended else n - hits).alias("n_correct")), p)


def rated(counts: DataFrame, p: float = 0.05) -> DataFrame:
    """``accuracy`` from counts (n, n_correct)."""
    k, m = F.col("n_correct"), F.col("n")
    return counts.where("n > 0").withColumns({"acc": k / m, "p_value": binomial_tail(k, m), "acc_sig": (binomial_critical(m, p) + 1) / m})


def threshold_curve(labelled: DataFrame, keys: list[str], similarity: str, tie: list[str], correct: str = "correct") -> DataFrame:
    """Accuracy over the trials with a similarity above each trial's, in order of similarity."""
    w = Window.partitionBy(*keys).orderBy(similarity, *tie).rowsBetween(1, Window.unboundedFollowing)
    return labelled.withColumns({"n_above": F.count(F.lit(1)).over(w), "acc_above": F.avg(F.col(correct).cast("double")).over(w)}).where("n_above > 0")


def rotated_accuracy(trials: DataFrame, keys: list[str], trial: str, a: str, b: str, shifts: DataFrame) -> DataFrame:
    """(keys, perm, acc, n): accuracy after the trial list of correlations is rotated against itself by each shift.

    ``shifts`` holds (perm, shift) with shifts as a share of the number of trials; few rows, sent to every task.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    base = trials.select(*keys, trial, a, b).withColumn("_n", n)
    moved = base.crossJoin(F.broadcast(shifts)).withColumn("_to", F.pmod(F.col(trial) + F.floor(F.col("shift") * F.col("_n")), F.col("_n")))
    left = moved.select(*keys, "perm", F.col("_to").alias("_at"), F.col(a).alias("_a"))
    right = moved.select(*keys, "perm", F.col(trial).alias("_at"), F.col(b).alias("_b"))
    return left.join(right, [*keys, "perm", "_at"]).groupBy(*keys, "perm").agg(F.avg((F.col("_a") > F.col("_b")).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))
