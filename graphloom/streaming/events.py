"""Progress events of a request: sequence, mapping, progress, idleness and the log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import redact, text

# fixed values: internal event types and their public ones; a shape is told of twice
PUBLIC = {"status": ["progress"], "stage": ["progress"], "rule": ["rule"], "resolution": ["target"], "shape": ["shape", "progress"], "warning": ["warning"], "complete": ["completed"], "error": ["failed"]}
TERMINAL = ["completed", "failed"]


def progress(current: Column, total: Column) -> Column:
    """W33. A struct of completed and total items and their share, clamped; a total of zero is no progress."""
    done = F.when(total > 0, F.greatest(F.lit(0), F.least(current, total))).otherwise(0)
    return F.struct(done.alias("completed"), total.alias("total"), F.when(total > 0, done / total).otherwise(0.0).alias("progress"))


def public_events(events: DataFrame) -> DataFrame:
    """W32. Events (request_id, t, event_id, event, ...) under their public names; unknown ones are left out."""
    kinds = F.create_map(*[x for k, v in PUBLIC.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    names = F.try_element_at(kinds, F.col("event"))
    return events.where(names.isNotNull()).select("*", F.posexplode(names).alias("part", "name")).drop("event").withColumnRenamed("name", "event")


def sequenced(events: DataFrame) -> DataFrame:
    """W30. Events with sequence 1, 2, ... in each request; nothing follows the first terminal one."""
    w = W.partitionBy("request_id").orderBy("t", "event_id", "part")
    e = events.withColumn("sequence", F.row_number().over(w))
    ended = F.max(F.col("event").isin(TERMINAL).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return e.withColumn("over", F.coalesce(ended, F.lit(0))).where("over = 0").drop("over")


def sequence_stream(events: DataFrame) -> DataFrame:
    """W30 over a stream: (request_id, t, event_id, part, event, sequence), the counter in state until the request ends."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        b = pd.concat(list(batches)).sort_values(["t", "event_id", "part"])
        keep = []
        for name in b["event"]:
            keep.append(not ended)
            ended = ended or name in TERMINAL
        b = b[keep].assign(request_id=key[0])
        b["sequence"] = range(n + 1, n + 1 + len(b))
        state.update((n + len(b), bool(ended)))
        yield b[["request_id", "t", "event_id", "part", "event", "sequence"]]

    rows = events.select("request_id", "t", "event_id", "part", "event")
    return rows.groupBy("request_id").applyInPandasWithState(run, "request_id string, t double, event_id bigint, part int, event string, sequence long", "n long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def idle_failures(events: DataFrame, idle: float) -> DataFrame:
    """W31. (request_id, failed_at): where a request that hasn't ended says nothing for idle seconds; heartbeats don't count.

    The last event of a request that hasn't ended is followed by silence as well, if now is later.
    """
    real = events.where("event <> 'heartbeat'")
    w = W.partitionBy("request_id").orderBy("t", "event_id")
    gaps = real.withColumn("next", F.lead("t").over(w)).withColumn("over", F.col("event").isin(TERMINAL))
    return gaps.where("not over and next - t > " + repr(float(idle))).groupBy("request_id").agg((F.min("t") + idle).alias("failed_at"))


def with_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """W34. Events (number, index) with the title of their rule, by number, else by index; a stream may be on the left."""
    by_number = rules.where(text("number") != "").groupBy("number").agg(F.min_by("title", "ord").alias("by_number"))
    by_index = rules.select(F.col("ord").alias("index"), F.col("title").alias("by_index"))
    return events.join(by_number, "number", "left").join(by_index, "index", "left").withColumn("title", F.coalesce("by_number", "by_index")).drop("by_number", "by_index")


def parse_frames(frames: DataFrame, body_col: str = "body") -> DataFrame:
    """G24, G25. The JSON of each frame's first data line, as event and payload; frames that hold none are left out."""
    f = frames.select("*", F.posexplode(F.split(F.regexp_replace(text(body_col), "\r\n?", "\n"), "\n\n")).alias("nr", "frame"))
    data = F.regexp_extract("frame", r"(?m)^data: (.*)$", 1)
    payload = F.try_parse_json(data)
    kind = F.coalesce(F.try_variant_get(payload, "$.event", "string"), F.try_variant_get(payload, "$.type", "string"))
    return f.withColumn("data", data).withColumn("event", kind).where("event is not null").drop("frame", body_col)


def render_frames(events: DataFrame) -> DataFrame:
    """W30. Each event as a server-sent frame: (request_id, sequence, frame)."""
    body = F.to_json(F.struct("event", "request_id", "sequence", "t"))
    return events.select("request_id", "sequence", F.concat(F.lit("event: "), "event", F.lit("\nid: "), F.col("sequence").cast("string"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))


def log_tail(entries: DataFrame, keep: int, secrets: list[str] | None = None) -> DataFrame:
    """W17, D17. The last entries of each run (run_id, seq, level, message, indent), redacted, the indent within 0 to 3."""
    w = W.partitionBy("run_id").orderBy(F.desc("seq"))
    last = entries.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= keep).drop("nr")
    return last.withColumns({"message": redact("message", secrets), "indent": F.greatest(F.lit(0), F.least(F.lit(3), F.col("indent")))})


def log_matches(level: Column, message: Column, details: Column, stage: Column, query: str, levels: list[str] | None = None) -> Column:
    """W16. Whether an entry is of a level and holds the query in its message, details or stage."""
    found = F.lower(F.concat_ws(" ", text(message), text(details), text(stage))).contains(query.lower())
    return found & level.isin(levels) if levels else found


def reconcile(queue: DataFrame, accepted: DataFrame) -> DataFrame:
    """W15. Queue rows with whether their accepted shape is still there; a dangling reference is cleared."""
    a = accepted.select(F.col("shape_id").alias("accepted_id"), F.lit(True).alias("accepted")).distinct()
    out = queue.join(a, "accepted_id", "left")
    return out.select("rule_id", F.when(F.col("accepted"), F.col("accepted_id")).alias("accepted_id"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
