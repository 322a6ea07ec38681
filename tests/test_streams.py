import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import admission as A
from graphloom.streaming import events as E

LIMITS = {"general-minute": (60.0, 4), "burst-second": (1.0, 2), "expensive-minute": (60.0, 2), "jobs-minute": (60.0, 1)}


def requests(n=400, seed=1):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.25, 0.5, 1.0, 15.0, 60.0])
        out.append((i, f"c{rng.randrange(3)}", rng.choice(["a", "b", "job"]), t))
    return out


def plain(rows):
    """By the definition: of the admitted ones, those in (t - w, t] count."""
    admitted, out = [], {}
    for i, c, op, t in sorted(rows, key=lambda r: (r[3], r[0])):
        ok = True
        for name, w, m in A.buckets(op, frozenset(["b"]), frozenset(["job"]), LIMITS):
            same = [x for x, own, ops in admitted if own == c and x > t - w and name in ops]
            if len(same) >= m:
                ok = False
                break
        if ok:
            admitted.append((t, c, {n for n, *_ in A.buckets(op, frozenset(["b"]), frozenset(["job"]), LIMITS)}))
        out[i] = ok
    return out


def test_admission(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "event_id bigint, client string, operation string, t double")
    got = {r.event_id: r for r in A.admit(df, ["b"], ["job"], LIMITS).collect()}
    want = plain(rows)
    assert {i: r.admitted for i, r in got.items()} == want
    assert not all(want.values()) and any(want.values())
    assert all((r.retry_after or 0) >= 1 for r in got.values() if not r.admitted)
    assert A.admit(df.limit(0), [], []).count() == 0


def test_a_request_at_the_edge_of_the_window():
    c = A.Client()
    b = [("x", 10.0, 1)]
    assert c.check(0.0, b) == (True, None, None)
    assert c.check(9.5, b) == (False, 1, "x")
    assert c.check(10.0, b)[0]


@pytest.mark.parametrize("kind", ["admission", "sequence"])
def test_streams_equal_batches(spark, tmp_path, kind):
    rows = requests(120, 3)
    if kind == "admission":
        df = spark.createDataFrame(rows, "event_id bigint, client string, operation string, t double")
        batch = lambda d: A.admit(d, ["b"], ["job"], LIMITS).select("event_id", "admitted")
        stream = lambda d: A.admit_stream(d, ["b"], ["job"], LIMITS).select("event_id", "admitted")
    else:
        df = spark.createDataFrame([(c, t, i, 0, "completed" if i % 37 == 36 else "progress") for i, c, _, t in rows], "request_id string, t double, event_id bigint, part int, event string")
        batch = lambda d: E.sequenced(d).select("event_id", "sequence")
        stream = lambda d: E.sequence_stream(d).select("event_id", "sequence")
    for k, (lo, hi) in enumerate([(0, 50), (50, 120)]):
        df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        time.sleep(1.1)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream(src).writeStream.format("memory").queryName(f"out_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(f"out_{kind}").collect())) == sorted(map(tuple, batch(df).collect()))


def test_job_fold(spark):
    rows = [("j", 1, 0.0, "k", "queued", None, "q"), ("j", 2, 1.0, "k", "running", None, None), ("j", 3, 2.0, "k", None, 1.7, "p"), ("j", 4, 3.0, "k", "cancelled", None, "c"), ("j", 5, 4.0, "k", None, 0.2, "late"), ("e", 1, 0.0, "k", "running", None, None), ("e", 2, 99.0, "k", "completed", None, "too late")]
    df = spark.createDataFrame(rows, "job_id string, seq bigint, t double, kind string, status string, progress double, message string")
    got = {r.job_id: r for r in A.job_states(df, 50.0).collect()}
    assert (got["j"].status, got["j"].progress, got["j"].message, got["j"].ignored) == ("cancelled", 1.0, "c", 1)
    assert (got["e"].status, got["e"].updated_at) == ("failed", 50.0)


def test_job_admission(spark):
    rows = [(0, "p", 0.0, 10.0), (1, "p", 1.0, 2.0), (2, "p", 1.5, 9.0), (3, "p", 2.0, 3.0), (4, "q", 1.5, 9.0)]
    df = spark.createDataFrame(rows, "event_id bigint, pool string, t double, until double")
    assert {r.event_id: r.admitted for r in A.admit_jobs(df, 2).collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_frames(spark):
    df = spark.createDataFrame([("r", 'event: x\ndata: {"event": "rule", "n": 1}\n\n: ping\n\ndata: {broken\n\ndata: {"type": "warning"}\n\n')], "request_id string, body string")
    assert [r.event for r in E.parse_frames(df).orderBy("nr").collect()] == ["rule", "warning"]
