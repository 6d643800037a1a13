"""Recordings in .npy files as a Spark data source: each task reads a range of samples, not a file, or many small files.

A file holds an array of numbers, samples first; further axes are channels. Only its header is read to plan, and a task seeks to its own
rows. Pickled object arrays are refused, as reading them can run code; so are arrays in column order, whose samples lie apart.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadenza.operators import clean
from cadenza.operators.halo import positions
from cadenza.operators.runs import in_order, whole_runs

SCHEMA = "path string, t long, ch array<double>"
ROWS = 100_000
BATCH = 10_000
FEW = 100  # files, or ranges, up to which each range has a task of its own
PACKED = 16 << 20  # bytes of small files, or of small ranges, that one task reads
OPENED = 64 << 10  # bytes that opening a file counts for


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def header(store: arrow_fs.FileSystem, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the data begin."""
    with store.open_input_stream(path, compression=None) as source:
        raw = io.BytesIO(source.read(1 << 16))
    version = np.lib.format.read_magic(raw)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if kind.hasobject or kind.kind not in "fiub":
        raise ValueError(f"{path}: only arrays of numbers are read, not {kind}")
    if by_column and len(shape) > 1:
        raise ValueError(f"{path}: stored by columns")
    return shape, kind, raw.tell()


@dataclass
class Samples(InputPartition):
    """Ranges (path, first, last) of samples that a task reads; ``last`` is none for a whole file."""

    ranges: list[tuple[str, int, int | None]]


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files that the path names: a file, all .npy files of a folder, or those that a pattern in its last part matches."""
        store, inner = open_store(self.path)
        base, last = posixpath.split(inner)
        if "*" in last:
            found = [f for f in store.get_file_info(arrow_fs.FileSelector(base)) if fnmatch.fnmatch(posixpath.basename(f.path), last)]
        elif (own := store.get_file_info(inner)).type == arrow_fs.FileType.Directory:
            found = [f for f in store.get_file_info(arrow_fs.FileSelector(inner)) if f.path.endswith(".npy")]
        else:
            found = [own]
        return sorted((f.path, f.size or 0) for f in found)

    def partitions(self) -> list[Samples]:
        """``rows`` samples a task; of many files the small ones are read whole, and many small ranges by one task.

        Only headers of other files are read here, as opening each file and a task for each would take longer than reading them.
        """
        store, _ = open_store(self.path)
        files = self.files()
        many = len(files) > FEW
        whole, cut = [], []  # ranges with their bytes: of small files, and of others
        for f, size in files:
            if many and size <= PACKED:
                whole.append(((f, 0, None), size))
                continue
            shape, kind, _ = header(store, f)
            width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
            for lo in range(0, shape[0], self.rows):
                hi = min(lo + self.rows, shape[0])
                cut.append(((f, lo, hi), (hi - lo) * width))
        out = [Samples([r]) for r, _ in cut] if len(cut) <= FEW else packed(cut)
        out += packed(whole)
        return out or [Samples([])]

    def read(self, part: Samples) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        held: list[tuple[str, int, np.ndarray]] = []
        for path, first, last in part.ranges:
            for lo, x in chunks(store, path, first, last):
                if sum(len(h[2]) for h in held) + len(x) > BATCH:
                    yield batch(held)
                    held = []
                held.append((path, lo, x))
        if held:
            yield batch(held)


def packed(ranges: list[tuple[tuple[str, int, int | None], int]]) -> list[Samples]:
    """Neighbouring ranges in tasks of ``PACKED`` bytes; a larger one has a task of its own."""
    out, room = [], 0
    for r, size in ranges:
        size = max(size, OPENED)
        if size > room:
            out.append(Samples([]))
            room = PACKED
        out[-1].ranges.append(r)
        room -= size
    return out


def chunks(store: arrow_fs.FileSystem, path: str, first: int, last: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(sample number, samples x channels) of a range, up to ``BATCH`` samples at a time."""
    shape, kind, begin = header(store, path)
    width = int(np.prod(shape[1:], dtype=np.int64))
    last = shape[0] if last is None else last
    with store.open_input_file(path) as source:
        for lo in range(first, last, BATCH):
            n = min(BATCH, last - lo)
            source.seek(begin + lo * width * kind.itemsize)
            yield lo, np.frombuffer(source.read(n * width * kind.itemsize), kind).astype(float).reshape(n, width)


def batch(held: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    x = np.concatenate([h[2].ravel() for h in held])
    edges = np.cumsum([0, *np.repeat([h[2].shape[1] for h in held], [len(h[2]) for h in held])])
    ch = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, mask=np.isnan(x)))
    paths = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(held)), [len(h[2]) for h in held]), pa.int32()), pa.array([h[0] for h in held], pa.string()))
    return pa.RecordBatch.from_arrays([paths.cast(pa.string()), pa.array(np.concatenate([h[1] + np.arange(len(h[2])) for h in held])), ch], names=["path", "t", "ch"])


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(path, t, ch) of the .npy files of a folder or pattern, ``rows`` samples a task; NaN is null inside ``ch``."""
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("rows", rows).load(path)


def filled(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """(path, t, ch) with the gaps of every channel filled linearly, in pieces."""
    long = series.select("path", "t", F.posexplode("ch").alias("c", "x"))
    whole = clean.fill_linear(long, ["path", "c"], "t", "x", rows=rows)
    return whole.groupBy("path", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda v: v["x"]).alias("ch"))


def concatenated(series: DataFrame, rows: int = ROWS) -> DataFrame:
    """(path, t, ch, at): recordings one after the other in order of their paths; ``at`` numbers the samples of all."""
    return positions(series, [], ["path", "t"], "at", rows)


def read_features(spark: SparkSession, folder: str, recordings: list[str], length: int, offset: int | None = None, suffix: str = "_reweight.npy", rows: int = ROWS) -> DataFrame:
    """(recording, t, ch) of the features of some recordings: gaps filled, and ``length`` samples each, from ``offset`` on where it is given.

    Where a recording is too short for that its last ``length`` samples are taken, as in ``clean.align_window``.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = read_npy(spark, f"{folder}/*{suffix}", rows).where(name.isin([f"{r}{suffix}" for r in recordings]))
    whole = filled(found, rows).withColumn("recording", F.left(name, F.length(name) - len(suffix)))
    cut = whole.where(F.col("t") < length) if offset is None else clean.align_window(whole, ["recording"], "t", offset, length)
    return cut.select("recording", "t", "ch")


def write_npy(df: DataFrame, key: str, t: str, cols: list[str], folder: str, suffix: str = ".npy") -> DataFrame:
    """Write each series of ``key`` as one file of ``folder``, samples by ``t``; returns (path, n). One series has to fit a task."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = open_store(folder)
        store.create_dir(inner, recursive=True)
        for frame, starts in whole_runs(batches):
            names = [f"{inner}/{k}{suffix}" for k in frame[key].iloc[starts]]
            series = np.split(frame[cols].to_numpy(float), starts[1:])
            for path, x in zip(names, series, strict=True):
                out = io.BytesIO()
                np.save(out, x)
                with store.open_output_stream(path, compression=None) as sink:
                    sink.write(out.getvalue())
            yield pd.DataFrame({"path": names, "n": [len(x) for x in series]})

    return in_order(df.select(F.col(key).cast("string").alias(key), t, *cols), [key], [t]).mapInPandas(task, "path string, n long")
