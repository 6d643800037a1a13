"""WARC archives: one gzip member per record, written and read back by Spark tasks.

``write`` deals pages over tasks; each task streams records into archives of bounded size in the shared folder and
returns their names; only the names that Spark's own commit keeps count, so a retried task does no harm. ``read`` gives
each archive to a task that reads it in sequence: incremental zlib decompression, content-length framing, digest
verification; a record never needs more memory than its own size.

Edge cases: a null html or url counts as empty. Records with equal payloads of at least ``least`` bytes: the one with
the smallest page_id is the response, the others revisit it; a null page_id is never the response of others unless all
are null. Rows that repeat a page_id and payload: all are the response. Empty tables give one empty result. Only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import scratch, small_batches, stored
from cadenza.llm.filters import KeyFilter

MOST_BYTES = 1 << 30
CHUNK = 1 << 16
MOST_ROWS = 2000  # that a reading task hands on at a time
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str | None, url: str, payload: bytes, kind: str, refers_to: str | None, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head only, and names the record and payload it repeats."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page-{i}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {''.join(url.splitlines())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, payload_digest, record_type, refers_to): which pages are responses and which revisit one.

    Only (digest, page_id) pairs are grouped, combined before the shuffle. Digests of several pages are stored; pages whose digest a
    filter does not find among them are responses and are not moved. The others meet the stored table, whose keys are
    unique, so the join can split a hot digest.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    firsts = stored(firsts, "firsts")
    doubt = KeyFilter(firsts.select("sha")).might_hold(F.col("sha"))
    alone = rows.where(~doubt).withColumn("first", F.lit(None).cast(dict(rows.dtypes)["page_id"]))
    out = alone.unionByName(rows.where(doubt).join(firsts, "sha", "left"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "sha", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Write archives into ``folder``; returns the stored manifest (path, records, bytes)."""
    small_batches(pages.sparkSession)
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = open_store(folder)
        out = name = None
        done: list[tuple[str, int, int]] = []
        n = size = 0
        for b in batches:
            for page_id, url, html, sha, kind, ref in zip(b["page_id"], b["url"], b["html"], b["sha"], b["record_type"], b["refers_to"], strict=True):
                if out is None:
                    name, n, size = f"archive-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                one = record(None if pd.isna(page_id) else page_id, url, html.encode("utf-8", "replace"), kind, None if pd.isna(ref) else ref, base64.b32encode(bytes.fromhex(sha)).decode())
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(one) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}  # exact in pandas, also beside nulls
    return stored(plan_records(pages, least).withColumns(ids).mapInPandas(task, "path string, records long, bytes long"), "manifest")


def members(source) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other, read in chunks; raises on a truncated member."""
    rest, parts, z = b"", [], zlib.decompressobj(31)
    while True:
        data = rest or source.read(CHUNK)
        rest = b""
        if not data:
            break
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            rest, parts, z = z.unused_data, [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("truncated gzip member")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record; the block's length is that of Content-Length."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("content length does not frame the record")
    return fields, rest[:size]


def read_archive(path: str) -> Iterator[pd.DataFrame]:
    """The records of one archive in order, some thousands or about 4 MB of payload at a time."""
    cols = ["page_id", "url", "record_type", "payload_digest", "refers_to", "html", "valid"]
    store, inner = open_store(path)
    rows, size = [], 0
    with store.open_input_stream(inner, compression=None) as source:
        for raw in members(source):
            f, block = parse(raw)
            payload = block.partition(b"\r\n\r\n")[2]
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            ok = f["warc-block-digest"] == f"sha1:{base32_sha1(block)}" and (f["warc-type"] != "response" or base32_sha1(payload) == digest)
            ids = [x or None for x in (f["x-page-id"], f.get("x-refers-to-page-id", ""))]
            rows.append((ids[0], f["warc-target-uri"], f["warc-type"], digest, ids[1], payload.decode("utf-8"), ok))
            size += len(payload)
            if size > 4_000_000 or len(rows) == MOST_ROWS:
                yield pd.DataFrame(rows, columns=cols)
                rows, size = [], 0
    yield pd.DataFrame(rows, columns=cols)


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, html, valid) of every record of the archives."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield from read_archive(path)

    small_batches(manifest.sparkSession)
    paths = manifest.select("path").coalesce(1).repartition(max(1, manifest.count()))  # in turn, from one task: one archive each
    found = paths.mapInPandas(task, "page_id string, url string, record_type string, payload_digest string, refers_to string, html string, valid boolean")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, valid; one row per page.

    A revisit's bytes are those of the response that it names, found by the payload digest.
    """
    spark: SparkSession = pages.sparkSession
    back = read(write(pages, scratch(spark, "warc"), least))
    back = stored(back.select("page_id", F.octet_length("html").cast("long").alias("own"), "payload_digest", "record_type", "refers_to", "valid"), "records")
    full = back.where("record_type = 'response' and valid").groupBy("payload_digest").agg(F.max("own").alias("full"))
    again = back.where("record_type = 'revisit'").join(stored(full, "full"), "payload_digest", "left")  # stored, so that the join can split a hot digest
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    return back.where("record_type = 'response'").withColumnRenamed("own", "payload_bytes").select(*cols).unionByName(again.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", (F.col("valid") & F.col("full").isNotNull()).alias("valid")))
