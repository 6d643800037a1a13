import base64
import gzip
import hashlib
import io
import zlib

import pytest
from corpus import CLASH, WIDE, rows
from pyspark.sql import functions as F

from cadenza.llm import warc
from cadenza.llm.queries import op8_warc


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(pages):
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h or "", i)
    return sorted([(i, len((h or "").encode()), sha(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""], True) for i, h in pages], key=str)


COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def test_round_trip_equals_brute_force(spark, small):
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()]
    assert rows(op8_warc(spark, small), *COLS) == brute(pages)


PAGES = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "http://x/\r\ny", ""), (5, "u", "\u00e9\r\n\r\n WARC/1.1"), (0, "u", "same"), (6, "u", "z" * 3_000_000)]


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(v) for c, v in CLASH.items()})


def test_crafted(spark):
    assert rows(warc.round_trip(frame(spark)), *COLS) == brute([(i, h) for i, _, h in PAGES])
    assert warc.round_trip(frame(spark).limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(frame(spark), least=5).where("page_id < 3").collect()} == {"response"}


def test_texts_come_back(spark, tmp_path):
    back = warc.read(warc.write(frame(spark), f"file://{tmp_path}/w", least=10, most_bytes=1000)).where("record_type = 'response'")
    assert rows(back, "page_id", "html") == sorted([(i, h or "") for i, _, h in PAGES], key=str)


def test_members_are_plain_gzip(spark, tmp_path):
    m = warc.write(frame(spark), f"file://{tmp_path}/w").collect()
    raw = b"".join(open(r.path.removeprefix("file://"), "rb").read() for r in m)
    text = gzip.decompress(raw)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and sum(r.records for r in m) == len(PAGES)


def test_damage_is_noticed():
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = one.compress(warc.record(1, "u", b"payload", "response", None, "x")) + one.flush()
    assert len(list(warc.members(io.BytesIO(data * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data + data[:-9])))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload", "response", None, "x") + b"more")
    fields, block = warc.parse(warc.record(1, "u", b"a\r\n\r\nb", "response", None, "x"))
    assert block.endswith(b"\r\n\r\na\r\n\r\nb") and fields["warc-type"] == "response"


def test_wide_and_null_ids_and_repeated_rows(spark):
    pages = [(WIDE[1], "u", "same"), (None, "u", "same"), (WIDE[2], "u", "same"), (WIDE[0], "u", "own"), (WIDE[0], "u", "own"), (None, "u", "none has an id")]
    got = rows(warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)), "page_id", "record_type", "refers_to", "valid")
    want = [(WIDE[1], "response", None), (None, "revisit", WIDE[1]), (WIDE[2], "revisit", WIDE[1]), (WIDE[0], "response", None), (WIDE[0], "response", None), (None, "response", None)]
    assert got == sorted([(*w, True) for w in want], key=str)


def test_an_archive_of_revisits_is_read_in_batches(tmp_path):
    path = str(tmp_path / "a.warc.gz")
    with open(path, "wb") as out:
        for i in range(100_000):
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            out.write(z.compress(warc.record(str(i), "u", b"payload", "revisit", "0", "x")) + z.flush())
    sizes = [len(b) for b in warc.read_archive(path)]
    assert sum(sizes) == 100_000 and max(sizes) == warc.MOST_ROWS


def test_a_hot_payload_is_planned_once(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    plan = warc.plan_records(pages)
    assert plan.groupBy("record_type").count().collect().__len__() == 2 and plan.where("record_type = 'revisit' and refers_to = 0").count() == 1666
    assert plan.count() == 5000 and "Aggregate" not in plan._jdf.queryExecution().executedPlan().toString()  # the table of first pages is stored: a hot digest can be split
