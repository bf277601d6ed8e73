"""The duplicate-ratio alert rule as a stateful stream, for logs in time order (``alert_stream``) and for
logs that arrive out of order (``alert_stream_late``).

Quality snapshots arrive as a stream; per entity the state holds the time of
the last fired alert, so the cooldown carries across micro-batches and across
restarts (the state lives in the query's checkpoint).  Snapshots of one
entity are expected in time order across batches (the log is append-only);
inside a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C

OUT_SCHEMA = "entity string, event_time timestamp, duplicates_ratio double, fired int"
STATE_SCHEMA = "last_fired timestamp"


def alert_stream(snapshots: DataFrame, threshold: float = C.DUPLICATES_BAD_THRESHOLD,
                 cooldown: int = C.ALERT_COOLDOWN_MINUTES) -> DataFrame:
    cd = pd.Timedelta(minutes=max(1, int(cooldown)))
    thr = float(threshold)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists and state.get[0] is not None else None
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values("event_time", kind="mergesort")
        fired = []
        for t, r in zip(pdf["event_time"], pdf["duplicates_ratio"]):
            t = pd.Timestamp(t)
            f = 0
            if r is not None and r > thr and (last is None or t - last > cd):
                f, last = 1, t
            fired.append(f)
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield pdf.assign(fired=fired)[["entity", "event_time", "duplicates_ratio", "fired"]]

    return snapshots.select("entity", "event_time", "duplicates_ratio").groupBy("entity").applyInPandasWithState(
        step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


#: the entity of rows that only move the watermark; they are not in the output
CLOCK = "(clock)"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedAlerts(StatefulProcessor):
    """Per entity: the snapshots that the watermark has not passed yet, and the time of the last fired one. A timer
    at the earliest waiting snapshot releases all that the watermark has passed, in time order."""

    def __init__(self, threshold: float, wait: int):
        self.threshold, self.wait = threshold, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, ratio double")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):
        early = None
        for frame in rows:
            for at, ratio in zip(frame["at"], frame["duplicates_ratio"]):
                self.waiting.appendValue((int(at), None if pd.isna(ratio) else float(ratio)))
                early = int(at) if early is None else min(early, int(at))
        if early is not None:
            self.handle.registerTimer(_millis(early))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: r[0])
        ready, left = [r for r in rows if _millis(r[0]) <= passed], [r for r in rows if _millis(r[0]) > passed]
        last = self.last.get()[0] if self.last.exists() else None
        fired, before = [], last
        for at, ratio in ready:
            # snapshots of one time share the decision, so one that has just fired does not silence its equals
            hit = ratio is not None and ratio > self.threshold and (before is None or at == before or at - before > self.wait)
            before = at if hit else before
            fired.append(int(hit))
        if before is not None and before != last:
            self.last.update((before,))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(_millis(left[0][0]))
        else:
            self.waiting.clear()
        if ready:
            yield pd.DataFrame({"entity": pd.Series([key[0]] * len(ready), dtype=object), "at": [r[0] for r in ready], "duplicates_ratio": [r[1] for r in ready], "fired": fired})

    def close(self) -> None:
        pass


def _millis(at: int) -> int:
    return -(-at // 1000)


def alert_stream_late(snapshots: DataFrame, delay: str, threshold: float = C.DUPLICATES_BAD_THRESHOLD,
                      cooldown: int = C.ALERT_COOLDOWN_MINUTES) -> DataFrame:
    """The replay's decisions for snapshots that arrive up to ``delay`` out of order, each emitted once the watermark
    has passed it. A snapshot that comes later than that is dropped: what was decided without it stands. Rows
    of the entity `CLOCK` only move the watermark, and rows without entity or time are left out."""
    spark = snapshots.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = snapshots.where("entity IS NOT NULL AND event_time IS NOT NULL").withWatermark("event_time", delay)
    rows = rows.select("entity", "event_time", F.unix_micros("event_time").alias("at"), "duplicates_ratio")
    out = rows.groupBy("entity").transformWithStateInPandas(
        OrderedAlerts(float(threshold), max(1, int(cooldown)) * 60_000_000),
        "entity string, at long, duplicates_ratio double, fired int", "Append", "EventTime")
    return out.where(F.col("entity") != CLOCK).select("entity", F.timestamp_micros("at").alias("event_time"), "duplicates_ratio", "fired")
