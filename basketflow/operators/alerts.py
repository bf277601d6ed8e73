"""Duplicate-ratio alert rule.

``dispatch`` is the online rule: one check at ``now`` against the event log;
``replay`` runs the rule over the whole quality log.  Sending messages is a
side effect outside this library: both produce the event rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import scratch_path

EVENT_SCHEMA = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("entity", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("observed_value", T.DoubleType()),
    T.StructField("threshold_value", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

#: microseconds in a piece of an entity's log: 30 days, 43,200 snapshots if there is one a minute
PIECE = 30 * 86_400_000_000


def _message(entity, ratio, threshold: float):
    return F.format_string("%s: %.3f of the rows are duplicates (allowed: %.3f)", entity, ratio, F.lit(float(threshold)))


def cooldown_minutes(minutes: int = C.ALERT_COOLDOWN_MINUTES) -> int:
    return max(1, int(minutes))


def dispatch(latest: DataFrame, events: DataFrame, now, threshold: float = C.DUPLICATES_BAD_THRESHOLD,
             cooldown: int = C.ALERT_COOLDOWN_MINUTES, status: str = "failed") -> DataFrame:
    """New event rows for entities whose newest ratio exceeds ``threshold``
    and that have no event of the same rule (sent or failed) in the last
    ``max(1, cooldown)`` minutes.  ``latest`` = (entity, duplicates_ratio);
    ``events`` = the event log (rule_name, entity, created_at); ``now`` is a
    time literal or a column of ``latest``.  ``status`` is ``failed`` when no
    channel is configured, as in the original."""
    now_c = now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")
    firing = latest.where(F.col("duplicates_ratio") > threshold).withColumn("_now", now_c)
    since = F.timestamp_seconds(F.unix_seconds(F.col("_now")) - F.lit(cooldown_minutes(cooldown) * 60))
    ev = events.where(F.col("rule_name") == C.ALERT_RULE_NAME).select(
        F.col("entity").alias("_e"), F.col("created_at").alias("_t"))
    fresh = firing.join(ev, (F.col("entity") == F.col("_e")) & (F.col("_t") >= since), "left_anti")
    return fresh.select(
        F.lit(C.ALERT_RULE_NAME).alias("rule_name"),
        "entity",
        F.lit("critical").alias("severity"),
        F.col("duplicates_ratio").cast("double").alias("observed_value"),
        F.lit(float(threshold)).alias("threshold_value"),
        _message(F.col("entity"), F.col("duplicates_ratio"), threshold).alias("message"),
        F.lit(status).alias("status"),
        F.col("_now").alias("created_at"),
    )


# ---- replay -------------------------------------------------------------------------

def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def successors(times: np.ndarray, wait: int) -> np.ndarray:
    """For each of the rising ``times`` the index of the first one more than ``wait`` later; their count if
    there is none."""
    return np.searchsorted(times, times + wait, "right")


def chain_ends(times: np.ndarray, wait: int) -> np.ndarray:
    """The last index that following the successors from each index reaches, by pointer jumping."""
    n = len(times)
    to = successors(times, wait)
    to = np.where(to < n, to, np.arange(n))
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _ends(wait: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        times = rows["at"].to_numpy()
        return pa.table({"entity": rows["entity"], "piece": rows["piece"], "at": rows["at"], "last": times[chain_ends(times, wait)]})
    return run


def _chains(wait: int):
    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        times = np.sort(rows["at"].to_numpy())
        to, fired = successors(times, wait), np.zeros(len(times), bool)
        for entry in np.searchsorted(times, entries["at"].to_numpy()):
            while entry < len(times) and not fired[entry]:
                fired[entry], entry = True, to[entry]
        got = times[fired]
        entity = rows["entity"].slice(0, 1).to_pylist() * len(got)
        return pa.table({"entity": pa.array(entity, pa.string()), "at": pa.array(got, pa.int64())})
    return run


def _first_after(probes: DataFrame, high: DataFrame, starts: DataFrame) -> DataFrame:
    """``probes`` (entity, time, ...) with ``at``: the entity's first high time after ``time`` (null if there is
    none). It is in the probe's own piece, or it is the first of the next piece that has any."""
    piece = F.floor(F.col("time") / PIECE)
    p = probes.withColumn("piece", piece).alias("p")
    inside = p.join(high.select("entity", "piece", F.col("at").alias("h")), ["entity", "piece"]).where("h > time")
    inside = inside.groupBy(*[f"p.{c}" if c not in ("entity", "piece") else c for c in probes.columns], "piece").agg(F.min("h").alias("at"))
    got = probes.withColumn("piece", piece).join(inside.select("entity", "time", F.col("at").alias("_inside")).distinct(), ["entity", "time"], "left")
    # pieces in order, each with the first high time of the next one: a probe's piece may itself be empty
    marks = got.select("entity", "piece", F.lit(None).cast("long").alias("first")).distinct().join(starts.select("entity", "piece"), ["entity", "piece"], "left_anti")
    later = F.first("first", ignorenulls=True).over(Window.partitionBy("entity").orderBy("piece").rowsBetween(1, Window.unboundedFollowing))
    nexts = starts.unionByName(marks.select("entity", "piece", "first")).select("entity", "piece", later.alias("_next"))
    return got.join(nexts, ["entity", "piece"], "left").select(*probes.columns, F.coalesce("_inside", "_next").alias("at"))


def fired_times(high: DataFrame, wait: int) -> DataFrame:
    """(entity, at) of the distinct high times (entity, at in microseconds) that fire: an entity's first one,
    and from each fired one the first that is more than ``wait`` later.

    The chain of an entity is followed inside pieces of 30 days, each in a task of its own, up to the last
    time in the piece that it reaches from any entry; these few chain ends are then linked from piece
    to piece, and those on the way from the first one are marked by pointer jumping, in as many rounds
    as the number of an entity's chain ends has binary digits."""
    high = _stored(high.withColumn("piece", F.floor(F.col("at") / PIECE)), "high")
    keyed = high.groupBy("entity", "piece")
    ends = _stored(keyed.applyInArrow(_ends(wait), "entity string, piece long, at long, last long"), "chain-ends")
    starts = high.groupBy("entity", "piece").agg(F.min("at").alias("first"))
    heads = high.groupBy("entity").agg(F.min("at").alias("at"))
    # a node is a chain end; its next node is the end of the chain that its successor begins
    nodes = ends.select("entity", "last").distinct()
    nodes = _first_after(nodes.withColumn("time", F.col("last") + wait), high, starts).select("entity", "last", F.col("at").alias("entry"))
    reach = ends.select("entity", F.col("at").alias("entry"), F.col("last").alias("next"))
    nodes = _stored(nodes.join(reach, ["entity", "entry"], "left").select("entity", "last", "entry", "next"), "chain-nodes")
    marked = heads.join(ends, ["entity", "at"]).select("entity", "last")
    jump = nodes.where("next IS NOT NULL").select("entity", F.col("last").alias("here"), F.col("next").alias("there"))
    longest = nodes.groupBy("entity").count().agg(F.max("count")).first()[0] or 1
    rounds = (longest - 1).bit_length()
    for done in range(rounds):
        # after each round twice as many nodes from the first one on are marked, and pointers reach twice as far
        step = marked.join(jump, (marked["entity"] == jump["entity"]) & (marked["last"] == jump["here"])).select(marked["entity"], F.col("there").alias("last"))
        marked = _stored(marked.unionByName(step).distinct(), "marked")
        if done + 1 < rounds:
            on = jump.select(F.col("entity").alias("e2"), F.col("here").alias("h2"), F.col("there").alias("t2"))
            jump = _stored(jump.join(on, (F.col("entity") == F.col("e2")) & (F.col("there") == F.col("h2"))).select("entity", "here", F.col("t2").alias("there")), "jump")
    entries = nodes.join(marked, ["entity", "last"], "left_semi").where("entry IS NOT NULL").select("entity", F.col("entry").alias("at"))
    entries = _stored(heads.unionByName(entries).withColumn("piece", F.floor(F.col("at") / PIECE)), "chain-entries")
    return keyed.cogroup(entries.groupBy("entity", "piece")).applyInArrow(_chains(wait), "entity string, at long")


def replay(log: DataFrame, threshold: float = C.DUPLICATES_BAD_THRESHOLD,
           cooldown: int = C.ALERT_COOLDOWN_MINUTES) -> DataFrame:
    """Which snapshots would have fired: a snapshot fires when its ratio exceeds ``threshold`` and no
    earlier *fired* snapshot of the same entity lies within the cooldown (`fired_times`).

    Snapshots of one entity at the same time share the decision. Without an entity or a time a snapshot does
    not fire. A log without a high ratio fires nothing."""
    wait = cooldown_minutes(cooldown) * 60_000_000
    high = log.where((F.col("duplicates_ratio") > float(threshold)) & F.col("entity").isNotNull() & F.col("event_time").isNotNull())
    hits = fired_times(high.select("entity", F.unix_micros("event_time").alias("at")).distinct(), wait)
    hits = hits.select(F.col("entity").alias("_entity"), F.col("at").alias("_at"))
    rows = log.select("entity", "event_time", "duplicates_ratio")
    joined = rows.join(hits, (F.col("entity") == F.col("_entity")) & (F.unix_micros("event_time") == F.col("_at")), "left")
    is_high = F.coalesce(F.col("duplicates_ratio") > float(threshold), F.lit(False))
    return joined.select("entity", "event_time", "duplicates_ratio", (F.col("_at").isNotNull() & is_high).cast("int").alias("fired"))
