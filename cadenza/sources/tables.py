"""Keyed result tables: upsert, incremental append, readers of the file formats recordings come in."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = True) -> DataFrame:
    """``existing`` with the rows of ``new``: keys in both are replaced, or with ``overwrite`` false kept as they are."""
    if overwrite:
        return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once for all that follows: as a table in the folder that ``spark.checkpoint.dir`` names, so that a lost
    executor costs nothing of it; without such a folder it is persisted, and what is lost is computed again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name below ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def commit(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Make ``folder`` the table's ``version``, unless another writer was first: a marker is created whole or not at all.

    The marker, which names the folder, is written aside and moved to its place; stores refuse that where the place is taken. On a
    local disk, where a move would replace it, a hard link does the same.
    """
    aside, place = (f"{path}/_commits/{x}" for x in (f".{uuid.uuid4().hex}", version))
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(to_path(aside), False)
    out.write(bytearray(folder.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        local = lambda p: to_path(p).toUri().getPath()
        try:
            os.link(local(aside), local(place))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(to_path(aside), False)
    try:
        done = bool(fs.rename(to_path(aside), to_path(place)))
    except Exception as e:  # some stores raise where others return false
        if "exists" not in str(e).lower():
            raise
        done = False
    if not done:
        fs.delete(to_path(aside), False)
    return done


def committed(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(version, folder) of the newest version, if there is any."""
    if not exists(spark, f"{path}/_commits"):
        return None
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(to_path(f"{path}/_commits"))]
    last = max((int(n) for n in names if n.isdigit()), default=None)
    if last is None:
        return None
    source = fs.open(to_path(f"{path}/_commits/{last}"))
    try:
        return last, spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def save_upsert(new: DataFrame, path: str, keys: list[str], overwrite: bool = True, tries: int = 50) -> DataFrame:
    """Upsert into the Parquet table at ``path``: each version is a folder of its own, which counts once it is committed.

    Writers do not wait for each other: one whose version number is taken by then merges again, into what the other wrote. Readers see
    complete versions only, and older ones stay for those that read them.
    """
    spark = new.sparkSession
    for _ in range(tries):
        last = committed(spark, path)
        merged = upsert(spark.read.parquet(f"{path}/{last[1]}"), new, keys, overwrite) if last else new
        version = last[0] + 1 if last else 0
        folder = f"v={version}-{uuid.uuid4().hex}"
        merged.write.parquet(f"{path}/{folder}")
        if commit(spark, path, version, folder):
            return spark.read.parquet(f"{path}/{folder}")
    raise RuntimeError(f"{path}: other writers were first {tries} times")


def save_if_absent(new: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written from ``new`` only if it has no version yet; of several writers one is first, and all get its table."""
    spark = new.sparkSession
    if committed(spark, path) is None:
        folder = f"v=0-{uuid.uuid4().hex}"
        new.write.parquet(f"{path}/{folder}")
        commit(spark, path, 0, folder)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that ``save_upsert`` or ``save_if_absent`` keeps."""
    found = committed(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(f"{path}/{found[1]}")


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``incoming`` whose keys ``existing`` lacks: what an incremental load has to add."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def load_dataset(spark: SparkSession, path: str, build, mode: str, keys: list[str]) -> DataFrame:
    """A cached dataset. mode ``load``: as stored; ``new``: rebuilt; ``add``: stored plus what ``build`` has beyond it."""
    if mode == "load":
        return spark.read.parquet(path)
    if mode == "new" or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    else:
        append_new(spark.read.parquet(path), build(), keys).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def parse_recording(name: Column) -> dict[str, Column]:
    """Attended and other object ids from names like ``a_b_b.set`` (two objects: the last one is attended) or ``a.set``."""
    stem = F.regexp_replace(name, r"\.set$", "")
    parts = F.split(stem, "_")
    att = F.element_at(parts, -1)
    return {"n_objects": F.when(F.size(parts) == 3, 2).when(F.size(parts) == 1, 1).cast("long"), "att": att, "unatt": F.get(F.array_except(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(att)), 0)}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def list_recordings(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, n_objects, att, unatt, size) of the recordings that a pattern matches, in order of name."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return files.where(F.col("name").endswith(".set")).select("path", "name", "size", *[c.alias(n) for n, c in parse_recording(F.col("name")).items()]).orderBy("name")
