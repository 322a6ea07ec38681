"""Live streams with typed state and timers: heartbeats, failures by silence alone, and admission without rewriting state.

The session must keep its state in RocksDB: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider. Times of timers are the cluster's clock.
State survives a restart from the same checkpoint, timers included; they go on with the first events after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.streaming.admission import ADMISSION, Client, buckets
from graphloom.streaming.events import TERMINAL

# fixed values: seconds between heartbeats, and of silence before a request fails
HEARTBEAT, IDLE = 15.0, 1800.0
#: How long a request that has ended is remembered, so that what comes late stays out; seconds.
REMEMBERED = 86_400
#: How long an admitted time may be kept at most; seconds, well above the longest window.
KEPT = 3600
FRAME = "request_id string, t double, event_id bigint, part int, event string, sequence bigint"


class Requests(StatefulProcessor):
    """The events of a request in sequence; a heartbeat after each interval without a failure, and a failure after silence.

    State: (n, ended, active): events so far, whether a terminal one was among them, and when the last
    one that isn't a heartbeat came, in milliseconds of the cluster's clock. One timer is set at a time.
    """

    def __init__(self, heartbeat: float, idle: float):
        self.heartbeat, self.idle = int(heartbeat * 1000), int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "n long, ended boolean, active long", REMEMBERED * 1000)

    def _held(self) -> tuple[int, bool, int]:
        return self.state.get() if self.state.exists() else (0, False, 0)

    def _next(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.heartbeat)

    def _clear(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, ended, active = self._held()
        b = pd.concat(list(rows)).sort_values(["t", "event_id", "part"])
        keep = []
        for name in b["event"]:
            keep.append(not ended)
            ended = ended or name in TERMINAL
        b = b[keep].assign(request_id=key[0])
        b["sequence"] = range(n + 1, n + 1 + len(b))
        if len(b):
            now = int(timerValues.getCurrentProcessingTimeInMs())
            self.state.update((n + len(b), bool(ended), now))
            if ended:
                self._clear()
            elif not active:
                self._next(now)
            yield b[["request_id", "t", "event_id", "part", "event", "sequence"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, ended, active = self._held()
        if ended:
            return
        now = int(timerValues.getCurrentProcessingTimeInMs())
        failed = self.idle > 0 and now - active >= self.idle
        self.state.update((n + 1, failed, active))
        if not failed:
            self._next(now)
        yield pd.DataFrame({"request_id": [key[0]], "t": [now / 1000], "event_id": pd.array([None], "Int64"), "part": [0], "event": ["failed" if failed else "heartbeat"], "sequence": [n + 1]})

    def close(self) -> None:
        pass


def live_events(events: DataFrame, heartbeat: float = HEARTBEAT, idle: float = IDLE) -> DataFrame:
    """W30, W31 over a stream (request_id, t, event_id, part, event): FRAME, with heartbeats and failures that silence alone brings.

    An interval begins when a request does; at its end a request without an event for idle seconds fails,
    another gets a heartbeat. Heartbeats have a sequence of their own and don't count as activity.
    """
    rows = events.select("request_id", "t", "event_id", "part", "event")
    return rows.groupBy("request_id").transformWithStateInPandas(Requests(heartbeat, idle), FRAME, "append", "ProcessingTime")


class Admission(StatefulProcessor):
    """A client's requests in order; each admitted time is one more row of a list, and none is written again.

    Rows go by themselves after KEPT seconds; the list is made anew only when most of it no longer counts.
    """

    def __init__(self, expensive: frozenset[str], jobs: frozenset[str], limits: dict | None):
        self.expensive, self.jobs, self.limits = expensive, jobs, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("admitted", "bucket string, t double", KEPT * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held: dict[str, list[float]] = {}
        size = 0
        for name, t in self.times.get():
            held.setdefault(name, []).append(t)
            size += 1
        client = Client(held)
        b = pd.concat(list(rows)).sort_values(["t", "event_id"])
        out, new = [], []
        for op, t in zip(b["operation"], b["t"], strict=True):
            own = buckets(op, self.expensive, self.jobs, self.limits)
            out.append(client.check(t, own))
            if out[-1][0]:
                new += [(name, float(t)) for name, _, _ in own]
        alive = [(name, t) for name, ts in client.held.items() for t in ts]
        if size + len(new) > 2 * len(alive) + 100:
            self.times.put(alive)
        elif new:
            self.times.appendList(new)
        yield b.assign(client=key[0], admitted=[o[0] for o in out], retry_after=pd.array([o[1] for o in out], "Int32"), bucket=[o[2] for o in out])[["event_id", "client", "operation", "t", "admitted", "retry_after", "bucket"]]

    def close(self) -> None:
        pass


def live_admission(requests: DataFrame, expensive: list[str], jobs: list[str], limits: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """W35 over a stream: ADMISSION, as admission.admit of the same rows in the order in which they come."""
    rows = requests.select("event_id", F.col("client").cast("string").alias("client"), "operation", F.col("t").cast("double").alias("t"))
    return rows.groupBy("client").transformWithStateInPandas(Admission(frozenset(expensive), frozenset(jobs), limits), ADMISSION, "append", "ProcessingTime")
