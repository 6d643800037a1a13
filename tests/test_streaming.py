import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import lag, models, segment
from cadenza.sources.adapters import signal
from cadenza.streaming import tracking


@pytest.fixture
def events(spark, small, tmp_path):
    """The events in four files of rising time, as a stream of one file a batch."""
    e = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    cuts = [r[0] for r in e.select(F.ntile(4).over(Window.orderBy("ts")).alias("q"), "ts").groupBy("q").agg(F.max("ts")).orderBy("q").select("max(ts)").collect()]
    low = None
    for c in cuts:
        part = e.where((F.col("ts") <= c) & (F.lit(True) if low is None else F.col("ts") > low))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = c
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def collected(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_trials_equal_the_batch_operator(spark, small, events, tmp_path):
    got = collected(spark, tracking.trial_correlations(events, "user_id", "ts", "event_id", "value", "k", 5, lags=2), "live", tmp_path)
    h = lag.hankel(signal(spark, small), ["u"], ["t"], ["x"], lags=2)
    want = models.correlate(segment.tumbling(h, ["u"], "t", 5), ["u", "trial"], {"r0": ("x_0", "y"), "r1": ("x_1", "y")}).collect()
    live = {(r.user_id, r.trial, r.lag): r.r for r in got.collect()}
    assert len(live) == 2 * len(want) > 0
    for w in want:
        assert np.allclose([live[w.u, w.trial, 0], live[w.u, w.trial, 1]], [w.r0, w.r1], equal_nan=True, atol=1e-6)


def test_windows_and_sessions(spark, events, tmp_path):
    w = collected(spark, tracking.window_correlations(events, ["user_id"], "ts", "value", "k", "30 days", "1 day"), "win", tmp_path)
    assert w.columns == ["user_id", "start", "n", "r"]
    s = collected(spark, tracking.session_counts(events, ["user_id"], "ts", "1 day", "1 day"), "sess", tmp_path)
    assert s.where("n < 1").count() == 0
