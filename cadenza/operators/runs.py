"""Many short series in Python tasks: whole series side by side in a batch of rows, not one call for each.

``applyInPandas`` pays some milliseconds for every group. Here rows are sorted by key once and go to Python in Spark's own batches, which are only
cut anew between series; a task then works on all series of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Array = np.ndarray


def in_order(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``df`` with the rows of each of ``keys`` one after the other in ``order``, numbered from 1 in ``_at``.

    The number of partitions is stated, as rows are few bytes: merging partitions by size would run all kernels in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.repartition(n, *keys).withColumn("_at", F.row_number().over(w))


def whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Array]]:
    """The rows of ``in_order``, cut only between series: frames, and where in each its series start. One series has to fit a task."""
    held: list[pd.DataFrame] = []
    for b in batches:
        starts = np.flatnonzero(b["_at"].to_numpy() == 1)
        cut = starts[-1] if len(starts) else len(b)
        held.append(b.iloc[:cut])
        if len(starts):
            if sum(map(len, held)):
                yield joined(held)
            held = [b.iloc[cut:]]
    if sum(map(len, held)):
        yield joined(held)


def joined(frames: list[pd.DataFrame]) -> tuple[pd.DataFrame, Array]:
    frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)
    return frame, np.flatnonzero(frame["_at"].to_numpy() == 1)


def alike(*traits: Array) -> list[Array]:
    """Places of the series that agree in all ``traits``, such as their length."""
    _, kind = np.unique(np.stack(traits, axis=1), axis=0, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []
