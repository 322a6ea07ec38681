"""Queries of the stateful operators in their batch form, over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.registry import query, table
from graphloom.streaming import admission as A
from graphloom.streaming import events as E

_T = "epoch_us(ts) / 1000000.0"


def _t(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1000000.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", _t())


#: Three requests in an hour of which two may be of one kind: small limits, so that the fixture's clients meet them.
LIMITS = {"general-minute": (21600.0, 3), "burst-second": (60.0, 2), "expensive-minute": (21600.0, 2), "jobs-minute": (21600.0, 1)}


@query("rate_admission")
def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each client's requests; SQL has no form of it, a test holds it against a plain one"""
    r = events(spark, sf_dir).select("event_id", F.col("user_id").alias("client"), F.col("event_type").alias("operation"), "t")
    return A.admit(r, ["purchase"], ["signup"], LIMITS)


@query("rate_upper_bound", f"WITH e AS (SELECT event_id, user_id, {_T} AS t FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS in_window FROM e")
def rate_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W35's upper bound: requests in the window, admitted or not"""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-21600, 0)
    return events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("in_window"))


@query("rate_offered_load", f"WITH i AS (SELECT user_id AS pool, {_T} AS t, {_T} + value * 60 AS until FROM events), s AS (SELECT pool, place, sum(d) AS d FROM (SELECT pool, t AS place, 1 AS d FROM i UNION ALL SELECT pool, until, -1 FROM i) GROUP BY ALL) SELECT pool, round(place, 3) AS t, CAST(sum(d) OVER (PARTITION BY pool ORDER BY place) AS BIGINT) AS running FROM s")
def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W36"""
    i = events(spark, sf_dir).select(F.col("user_id").alias("pool"), "t", (F.col("t") + F.col("value") * 60).alias("until"))
    return A.offered_load(i).select("pool", F.round("t", 3).alias("t"), "running")


@query("jobs_admission")
def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W36, W37"""
    i = events(spark, sf_dir).select("event_id", F.col("user_id").alias("pool"), "t", (F.col("t") + F.col("value") * 600).alias("until"))
    return A.admit_jobs(i, 3)


_JOBS = f"""j AS (SELECT 'j' || (event_id // 6) AS job_id, event_id AS seq, {_T} AS t, 'index' AS kind, CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 3 THEN CASE WHEN event_id % 5 = 0 THEN 'cancelled' END WHEN 5 THEN CASE WHEN event_id % 4 = 1 THEN 'failed' ELSE 'completed' END END AS status,
 CASE WHEN event_id % 6 IN (2, 4) THEN value / 300.0 END AS progress, event_type AS message FROM events),
fin AS (SELECT job_id, min(seq) AS e FROM j WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id),
s AS (SELECT j.job_id, arg_min(kind, seq) AS kind, arg_max(status, seq) FILTER (status IS NOT NULL AND seq <= coalesce(e, 1e18)) AS status, coalesce(arg_max(greatest(0.0, least(1.0, progress)), seq) FILTER (progress IS NOT NULL AND seq <= coalesce(e, 1e18)), 0.0) AS p,
  arg_max(message, seq) FILTER (seq <= coalesce(e, 1e18)) AS message, min(t) AS created_at, max(t) FILTER (seq <= coalesce(e, 1e18)) AS updated_at, count(*) FILTER (seq > coalesce(e, 1e18)) AS ignored FROM j LEFT JOIN fin USING (job_id) GROUP BY j.job_id),
states AS (SELECT job_id, kind, status, CASE WHEN status = 'completed' THEN 1.0 ELSE p END AS progress, message, created_at, updated_at, ignored FROM s)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events in a row are a job's: queued, running, progress, perhaps cancelled, progress, and an end."""
    k = F.col("event_id") % 6
    status = F.when(k == 0, "queued").when(k == 1, "running").when((k == 3) & (F.col("event_id") % 5 == 0), "cancelled").when((k == 5) & (F.col("event_id") % 4 == 1), "failed").when(k == 5, "completed")
    return events(spark, sf_dir).select(F.concat(F.lit("j"), F.floor(F.col("event_id") / 6).cast("string")).alias("job_id"), F.col("event_id").alias("seq"), "t", F.lit("index").alias("kind"), status.alias("status"), F.when(k.isin(2, 4), F.col("value") / 300.0).alias("progress"), F.col("event_type").alias("message"))


@query("jobs_states", f"WITH {_JOBS} SELECT job_id, kind, status, round(progress, 6) AS progress, message, ignored FROM states")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W38, W39, W41, D14"""
    return A.job_states(job_events(spark, sf_dir)).select("job_id", "kind", "status", F.round("progress", 6).alias("progress"), "message", "ignored")


@query("jobs_expired", f"WITH {_JOBS}, st AS (SELECT job_id, min(t) AS t0 FROM j WHERE status = 'running' GROUP BY job_id) SELECT job_id, round(t0 + 900, 3) AS failed_at FROM states JOIN st USING (job_id) LEFT JOIN fin USING (job_id) WHERE EXISTS (SELECT 1 FROM j WHERE j.job_id = states.job_id AND j.t > t0 + 900 AND j.seq <= coalesce(e, 1e18)) AND NOT EXISTS (SELECT 1 FROM j WHERE j.job_id = states.job_id AND j.seq = e AND j.t <= t0 + 900)")
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ran over a quarter of an hour"""
    s = A.job_states(job_events(spark, sf_dir), 900.0)
    return s.where("message = 'The job took too long.'").select("job_id", F.round("updated_at", 3).alias("failed_at"))


@query("jobs_pruned", f"WITH {_JOBS} SELECT job_id, status FROM (SELECT * FROM states WHERE status NOT IN ('completed', 'failed', 'cancelled') UNION ALL SELECT * FROM (SELECT * FROM states WHERE status IN ('completed', 'failed', 'cancelled') ORDER BY updated_at DESC, job_id LIMIT 100))")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W42"""
    return A.prune(A.job_states(job_events(spark, sf_dir))).select("job_id", "status")


_SSE = f"""raw AS (SELECT 'q' || (user_id % 20) || '-' || (event_id // 200) AS request_id, {_T} AS t, event_id, CASE event_id % 9 WHEN 0 THEN 'status' WHEN 1 THEN 'rule' WHEN 2 THEN 'shape' WHEN 3 THEN 'warning' WHEN 4 THEN 'odd' WHEN 5 THEN 'resolution' WHEN 6 THEN 'stage' WHEN 7 THEN CASE WHEN event_id % 8 = 0 THEN 'complete' ELSE 'status' END ELSE 'shape' END AS ev FROM events),
pub AS (SELECT request_id, t, event_id, 0 AS part, CASE ev WHEN 'status' THEN 'progress' WHEN 'stage' THEN 'progress' WHEN 'resolution' THEN 'target' WHEN 'complete' THEN 'completed' ELSE ev END AS event FROM raw WHERE ev <> 'odd' UNION ALL SELECT request_id, t, event_id, 1, 'progress' FROM raw WHERE ev = 'shape'),
sq AS (SELECT *, row_number() OVER w AS sequence, coalesce(max((event = 'completed')::INT) OVER (PARTITION BY request_id ORDER BY t, event_id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM pub WINDOW w AS (PARTITION BY request_id ORDER BY t, event_id, part))"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 9
    names = ["status", "rule", "shape", "warning", "odd", "resolution", "stage", "", "shape"]
    ev = F.when(k == 7, F.when(F.col("event_id") % 8 == 0, "complete").otherwise("status")).otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int")))
    rid = F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string"), F.lit("-"), F.floor(F.col("event_id") / 200).cast("string"))
    return events(spark, sf_dir).select(rid.alias("request_id"), "t", "event_id", ev.alias("event"))


@query("sse_public_events", f"WITH {_SSE} SELECT request_id, event_id, part, event FROM pub")
def public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W32"""
    return E.public_events(raw_events(spark, sf_dir)).select("request_id", "event_id", "part", "event")


@query("sse_sequence", f"WITH {_SSE} SELECT request_id, event_id, part, event, CAST(sequence AS INT) AS sequence FROM sq WHERE done = 0")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W30"""
    return E.sequenced(E.public_events(raw_events(spark, sf_dir))).select("request_id", "event_id", "part", "event", "sequence")


@query("sse_idle", f"WITH {_SSE}, g AS (SELECT *, lead(t) OVER (PARTITION BY request_id ORDER BY t, event_id) AS nx FROM (SELECT DISTINCT request_id, t, event_id, event FROM pub WHERE part = 0)) SELECT request_id, round(min(t) + 7200, 3) AS failed_at FROM g WHERE event <> 'completed' AND nx - t > 7200 GROUP BY request_id")
def idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours of silence"""
    e = E.public_events(raw_events(spark, sf_dir)).where("part = 0")
    return E.idle_failures(e, 7200.0).select("request_id", F.round("failed_at", 3).alias("failed_at"))


@query("sse_progress", "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN greatest(0, least(event_id % 7 - 1, user_id % 5)) ELSE 0 END AS completed, user_id % 5 AS total, CASE WHEN user_id % 5 > 0 THEN greatest(0, least(event_id % 7 - 1, user_id % 5)) / (user_id % 5) ELSE 0.0 END AS progress FROM events")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W33"""
    p = E.progress(F.col("event_id") % 7 - 1, F.col("user_id") % 5)
    return events(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", "p.*")


@query("sse_rule_lookup", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'title ' || (event_id % 10) WHEN event_id % 10 < 8 THEN 'title ' || (event_id % 10) END AS title FROM events WHERE event_id % 3 <> 0 OR event_id % 10 < 10")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W34"""
    k = F.col("event_id") % 10
    e = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("R"), k.cast("string"))).alias("number"), F.when(k < 8, k).cast("int").alias("index"))
    r = spark.createDataFrame([(f"R{i}", i, f"title {i}") for i in range(10)], "number string, ord int, title string")
    return E.with_rules(e, r).select("event_id", "title")


@query("log_tail", "SELECT user_id AS run_id, event_id AS seq, CAST(greatest(0, least(3, event_id % 6 - 1)) AS INT) AS indent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nr FROM events) WHERE nr <= 5")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W17"""
    e = events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("props").alias("message"), (F.col("event_id") % 6 - 1).cast("int").alias("indent"))
    return E.log_tail(e, 5).select("run_id", "seq", "indent")


@query("log_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'purchase') AND contains(lower(props), '\"k\"') AND contains(props, '7')")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16"""
    none = F.lit(None).cast("string")
    e = events(spark, sf_dir)
    return e.where(E.log_matches(F.col("event_type"), F.col("props"), none, none, '"K"', ["view", "purchase"]) & F.col("props").contains("7")).select("event_id")


@query("log_reconcile", "SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_size END AS accepted_id, p_partkey % 3 = 0 AS accepted FROM part")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15"""
    p = table(spark, sf_dir, "part")
    ref = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("s"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, "gone")
    q = p.select(F.col("p_partkey").alias("rule_id"), ref.alias("accepted_id"))
    return E.reconcile(q, p.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("shape_id")))
