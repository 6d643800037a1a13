"""Linear filters over long recordings in pieces (overlap-save): no task holds a whole series.

A filter is a short series of weights, the part of its impulse response that is above rounding. Each piece is filtered with as many samples of
its neighbours as the weights reach. Beyond both ends of a recording the series is continued by its odd mirror image, then by zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cadenza.functions import kernels
from cadenza.operators.halo import ROWS, positions, windowed
from cadenza.operators.moments import head_of
from cadenza.operators.runs import alike, in_order, whole_runs

Array = np.ndarray
LEAST = 1e-12  # of the largest weight: what is left out
MOST = 1 << 18  # samples that are filtered at once, where pieces are short


def weights(fs: float, low: float | None, high: float | None, order: int = 5, analytic: bool = False) -> Array:
    """Weights, centred, of a zero-phase Butterworth band; ``analytic`` ones give the signal whose magnitude is the envelope.

    The response is sampled ever more finely until the impulse response has died away within half of it.
    """
    n = 1 << 10
    while True:
        gain = kernels.response(n, fs, low, high, order)
        if analytic:
            full = np.zeros(n, complex)
            full[: len(gain)] = 2 * gain
            full[0], full[n // 2] = gain[0], gain[-1]
            h = np.fft.ifft(full)
        else:
            h = np.fft.irfft(gain, n=n)
        size = np.abs(np.roll(h, n // 2))
        some = np.flatnonzero(size > LEAST * size.max())
        reach = max(n // 2 - some[0], some[-1] - n // 2)
        if reach < n // 4 or n >= 1 << 20:
            return np.roll(h, n // 2)[n // 2 - reach : n // 2 + reach + 1]
        n *= 2


def extended(x: Array, before: int, after: int) -> Array:
    """Series of one length (series x samples x channels) with their odd mirror images at the ends, as far as these go, then zeros."""
    out, zeros = [x], lambda n: np.zeros((len(x), n, x.shape[2]))
    if before:
        m = min(before, x.shape[1] - 1)
        out = [zeros(before - m), 2 * x[:, :1] - x[:, m:0:-1], *out]
    if after:
        m = min(after, x.shape[1] - 1)
        out += [2 * x[:, -1:] - x[:, ::-1][:, 1 : m + 1], zeros(after - m)]
    return np.concatenate(out, axis=1)


def convolve(x: Array, h: Array) -> Array:
    """The samples of ``x`` (series x samples x channels) that the centred weights reach on both sides."""
    n = 1 << (x.shape[1] - 1).bit_length()
    back = np.fft.ifft if np.iscomplexobj(h) else np.fft.irfft
    ahead = np.fft.fft if np.iscomplexobj(h) else np.fft.rfft
    y = back(ahead(x, n=n, axis=1) * ahead(h, n=n)[:, None], n=n, axis=1)
    return y[:, len(h) - 1 : x.shape[1]]


def numbered(df: DataFrame, keys: list[str], t: str, cols: list[str], rows: int) -> DataFrame:
    """(keys, t, cols, _seq, _total): what ``filtered_line`` takes."""
    return positions(df.select(*keys, t, *cols), keys, [t], "_seq", rows, "_total")


def filtered_line(line: DataFrame, keys: list[str], t: str, cols: list[str], h: Array, rows: int) -> DataFrame:
    """(keys, t, cols, _seq, _total): ``filtered`` on rows that are numbered already, whose numbers stay. Pieces of one form are filtered together."""
    reach = len(h) // 2
    heads = [*keys, t, "_seq", "_total", "_piece"]
    schema = f"{head_of(line, heads[:-1])}, _piece long, " + ", ".join(f"`{c}` double" for c in cols)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_runs(batches):
            own = (frame["_seq"] // rows == frame["_piece"]).to_numpy()
            size, kept = np.diff([*starts, len(frame)]), np.add.reduceat(own.astype(np.int64), starts)
            before = np.add.reduceat((frame["_seq"] // rows < frame["_piece"]).to_numpy().astype(np.int64), starts)
            x, out = frame[cols].to_numpy(float), np.zeros((len(frame), len(cols)))
            for same in alike(size, kept, before):
                n, k, lead = size[same[0]], kept[same[0]], before[same[0]]
                step = max(1, MOST // (int(k) + 2 * reach))
                for some in (same[i : i + step] for i in range(0, len(same), step)):
                    pad = max(0, reach - lead)
                    wide = extended(x[starts[some][:, None] + np.arange(n)], pad, max(0, reach - (n - lead - k)))
                    y = convolve(wide[:, pad + lead - reach : pad + lead + k + reach], h)
                    out[starts[some][:, None] + lead + np.arange(k)] = np.abs(y) if np.iscomplexobj(y) else y
            done = frame.loc[own, heads]
            yield done.assign(**{c: out[own, i] for i, c in enumerate(cols)})

    def add(d: DataFrame, _: WindowSpec) -> DataFrame:
        return in_order(d, [*keys, "_piece"], ["_seq"]).select(*heads, "_at", *cols).mapInPandas(task, schema)

    return windowed(line, keys, "_seq", reach, reach, add, rows, "_total")


def filtered(df: DataFrame, keys: list[str], t: str, cols: list[str], h: Array, rows: int = ROWS) -> DataFrame:
    """(keys, t, cols): each series of ``keys`` filtered by the centred weights ``h``; the magnitude where they are complex.

    ``t`` is a whole number that grows with time. A task holds ``rows`` samples of one key and, on both sides, as many as the weights reach. A piece
    at an end of its recording mirrors what it has, so ``rows`` should be more than the weights reach.
    """
    return filtered_line(numbered(df, keys, t, cols, rows), keys, t, cols, h, rows).drop("_seq", "_total")


def band_pass(df: DataFrame, keys: list[str], t: str, cols: list[str], fs: float, low: float | None, high: float | None, order: int = 5, rows: int = ROWS) -> DataFrame:
    return filtered(df, keys, t, cols, weights(fs, low, high, order), rows)


def envelope(df: DataFrame, keys: list[str], t: str, cols: list[str], fs: float, low: float, high: float, every: int = 1, rows: int = ROWS) -> DataFrame:
    """(keys, t, cols): the envelope of a band; with ``every`` it is low-passed and one sample in so many is kept, numbered from 0."""
    out = filtered_line(numbered(df, keys, t, cols, rows), keys, t, cols, weights(fs, low, high, analytic=True), rows)
    if every == 1:
        return out.drop("_seq", "_total")
    smooth = filtered_line(out, keys, t, cols, weights(fs, None, 0.4 * fs / every), rows)
    return smooth.where(F.col("_seq") % every == 0).withColumn(t, F.floor(F.col("_seq") / every)).drop("_seq", "_total")
