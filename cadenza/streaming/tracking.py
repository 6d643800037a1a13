"""Correlations of a live signal with a feature: per trial of a fixed number of samples, and per event-time window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.functions.expr import safe_corr


def trial_correlations(stream: DataFrame, key: str, time: str, tie: str, x: str, y: str, length: int, lags: int = 1) -> DataFrame:
    """(key, trial, lag, r): correlation of ``y`` with ``x`` delayed by 0 to lags - 1 samples, as each trial completes.

    State per key is the sums of the open trial and the last lags - 1 samples of ``x``, however long the stream. Samples
    before the first count as 0, as in the batch lags. A key's rows have to arrive in order from batch to batch.
    """
    types = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trial, n, tail, sums = state.get if state.exists else (0, 0, [0.0] * (lags - 1), [0.0] * (1 + 3 * lags + 1))
        tail, s, out = list(tail), np.array(sums), []
        rows = pd.concat(list(frames)).sort_values([time, tie])
        for a, b in zip(rows[x].to_numpy(float), rows[y].to_numpy(float), strict=True):
            past = np.array([a, *tail])
            tail = list(past[: lags - 1])
            s += np.concatenate([[b, b * b], past, past * past, past * b])
            n += 1
            if n == length:
                sx, sxx, sxy = (s[2 + i * lags : 2 + (i + 1) * lags] for i in range(3))
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = (n * sxy - sx * s[0]) / np.sqrt(np.maximum((n * sxx - sx * sx) * (n * s[1] - s[0] * s[0]), 0.0))
                out += [(k[0], trial, i, float(v)) for i, v in enumerate(r)]
                trial, n, s = trial + 1, 0, np.zeros_like(s)
        state.update((trial, n, [float(v) for v in tail], [float(v) for v in s]))
        yield pd.DataFrame(out, columns=[key, "trial", "lag", "r"])

    return stream.select(key, time, tie, x, y).groupBy(key).applyInPandasWithState(
        step, f"{key} {types[key]}, trial long, lag long, r double", "trial long, n long, tail array<double>, sums array<double>", "append", GroupStateTimeout.NoTimeout
    )


def window_correlations(stream: DataFrame, keys: list[str], time: str, x: str, y: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """(keys, start, n, r) of event-time windows; data later than ``late`` behind the newest is dropped."""
    at = F.window(time, window, slide or window)
    out = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(*keys, at.alias("_w")).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("r"))
    return out.select(*keys, F.col("_w.start").alias("start"), "n", "r")


def session_counts(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """(keys, start, end, n): sessions that end after ``gap`` without an event."""
    out = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")
