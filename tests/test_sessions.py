import time

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import admission as A
from graphloom.streaming import sessions as L
from tests.test_streams import LIMITS, requests

STORE = "spark.sql.streaming.stateStore.providerClass"
EVENTS = "request_id string, t double, event_id bigint, part int, event string"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset(STORE)


def started(df, tmp_path, every="1 second"):
    return df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime=every).start()


def until(spark, path, enough, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        try:
            rows = spark.read.parquet(str(path)).collect()
        except Exception:  # nothing written yet
            rows = []
        if enough(rows):
            return rows
        time.sleep(1)
    raise AssertionError(rows)


def test_silence_fails_and_a_restart_keeps_state(rocks, tmp_path):
    """One event; heartbeats come by themselves, also after a restart, and then the failure; what comes later stays out."""
    spark, src = rocks, tmp_path / "in"
    row = lambda i, name, of="r": spark.createDataFrame([(of, float(i), i, 0, name)], EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    row(1, "progress")
    stream = lambda: L.live_events(spark.readStream.schema(EVENTS).parquet(str(src)), heartbeat=2.0, idle=10.0)
    q = started(stream(), tmp_path)
    until(spark, tmp_path / "out", lambda rows: any(r.event == "heartbeat" for r in rows))
    q.stop()
    row(7, "progress", "another")  # timers go on with the first batch after a restart
    q = started(stream(), tmp_path)
    rows = until(spark, tmp_path / "out", lambda rows: any(r.event == "failed" and r.request_id == "r" for r in rows))
    row(2, "progress")
    time.sleep(4)
    q.stop()
    rows = sorted(spark.read.parquet(str(tmp_path / "out")).where("request_id = 'r'").collect(), key=lambda r: r.sequence)
    names = [r.event for r in rows]
    assert [r.sequence for r in rows] == list(range(1, len(rows) + 1))
    assert names[0] == "progress" and names[-1] == "failed" and set(names[1:-1]) == {"heartbeat"}


def test_events_without_timers(rocks, tmp_path):
    """Sequence numbers go on over micro-batches, and nothing follows a terminal event."""
    spark, src = rocks, tmp_path / "in"
    for k, part in enumerate([[(1, "progress"), (2, "rule")], [(3, "completed"), (4, "rule")], [(5, "rule")]]):
        spark.createDataFrame([("r", float(i), i, 0, n) for i, n in part], EVENTS).coalesce(1).write.parquet(str(src / f"b{k}"))
        time.sleep(1.1)
    q = started(L.live_events(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src / "*")), heartbeat=600.0), tmp_path)
    until(spark, tmp_path / "out", lambda rows: len(rows) >= 3)
    time.sleep(4)
    q.stop()
    assert sorted((r.event_id, r.sequence) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_admission_like_the_batch(rocks, tmp_path):
    spark, src = rocks, tmp_path / "in"
    df = spark.createDataFrame(requests(120, 3), "event_id bigint, client string, operation string, t double")
    for k, (lo, hi) in enumerate([(0, 50), (50, 90), (90, 120)]):
        df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(src / f"b{k}"))
        time.sleep(1.1)
    stream = L.live_admission(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*")), ["b"], ["job"], LIMITS)
    q = started(stream, tmp_path)
    until(spark, tmp_path / "out", lambda rows: len(rows) >= 120)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select("event_id", "admitted", "retry_after", "bucket").collect())) == sorted(map(str, A.admit(df, ["b"], ["job"], LIMITS).select("event_id", "admitted", "retry_after", "bucket").collect()))
