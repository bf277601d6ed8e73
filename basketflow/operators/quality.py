"""Data-quality counters per entity and the queries over their log.

For one entity and one snapshot time:

* ``total_rows_raw``     all RAW rows,
* ``inserted_rows_mart`` rows passing the MART rule (same predicate object),
* ``invalid_rows``       total − valid,
* ``duplicates_rows``    total − count_distinct(normalised id), ``''`` counted
  as one value,
* ``duplicates_ratio``   duplicates / total, 0.0 for an empty table.

One aggregation per entity: ``count``, ``count_if`` and one distinct count.
With a single distinct column Spark plans a partial aggregate on the id
first, so a hot id (even ``''`` on a third of all rows) is collapsed map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from .mart import NORMALIZE, as_of_col

ID_COLUMN = {
    "stores": "store_id",
    "products": "product_id",
    "customers": "customer_id",
    "purchases": "purchase_id",
}

SCHEMA = [
    "event_time", "entity", "total_rows_raw", "inserted_rows_mart", "invalid_rows",
    "duplicates_rows", "duplicates_ratio",
]


def dup_key(entity: str):
    if entity == "purchase_items":
        # lines are keyed by (purchase, product)
        return F.concat_ws("|", F.col("purchase_id"), F.col("product_id"))
    return F.col(ID_COLUMN[entity])


def quality(entity: str, fields: DataFrame, as_of, event_time=None, ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    """``fields`` = the entity's raw fields (``operators.mart.*_fields`` or the
    lens); normalisation happens here, as in the original counters."""
    n = NORMALIZE[entity](fields)
    agg = n.agg(
        F.count(F.lit(1)).alias("total_rows_raw"),
        F.count_if(P.is_valid(entity, as_of_col(as_of), ids)).alias("inserted_rows_mart"),
        F.count_distinct(dup_key(entity)).alias("_distinct"),
    )
    t = as_of_col(event_time if event_time is not None else as_of)
    return counters(agg, F.lit(entity), t, "total_rows_raw", "inserted_rows_mart", "_distinct")


def counters(df: DataFrame, entity, event_time, total: str, valid: str, distinct: str) -> DataFrame:
    """Quality rows from counts of all rows, valid rows and distinct ids."""
    n, dup = F.col(total), F.col(total) - F.col(distinct)
    return df.select(
        event_time.alias("event_time"),
        entity.alias("entity"),
        n.cast("long").alias("total_rows_raw"),
        F.col(valid).cast("long").alias("inserted_rows_mart"),
        (n - F.col(valid)).cast("long").alias("invalid_rows"),
        dup.cast("long").alias("duplicates_rows"),
        F.when(n == 0, F.lit(0.0)).otherwise(dup / n).alias("duplicates_ratio"),
    )


def snapshot(fields_by_entity: dict[str, DataFrame], as_of, event_time=None, ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    """All entities at one time, as rows to append to the quality log."""
    out = None
    for entity, f in fields_by_entity.items():
        q = quality(entity, f, as_of, event_time, ids)
        out = q if out is None else out.unionByName(q)
    return out


def latest_for(log: DataFrame, entity: str = "purchases") -> DataFrame:
    """Newest log row of one entity (top-1)."""
    return log.where(F.col("entity") == entity).orderBy(F.desc("event_time")).limit(1)


def status(log: DataFrame, entity: str = "purchases", threshold: float = C.DUPLICATES_BAD_THRESHOLD) -> DataFrame:
    """``bad`` when the newest ratio exceeds the threshold, else ``good``;
    an empty log reads as ratio 0.0."""
    latest = latest_for(log, entity).select("duplicates_ratio", "event_time")
    one = latest.agg(
        F.coalesce(F.max("duplicates_ratio"), F.lit(0.0)).alias("ratio"),
        F.max("event_time").alias("event_time"),
    )
    return one.select(
        F.round("ratio", 6).alias("duplicates_ratio"),
        F.lit(float(threshold)).alias("target_ratio"),
        F.when(F.col("ratio") > threshold, "bad").otherwise("good").alias("status"),
        "event_time",
    )


def trend(log: DataFrame, entity: str = "purchases", runs: int = 10) -> DataFrame:
    """Last ``runs`` (1..50) ratios of one entity, oldest first, numbered."""
    if not 1 <= int(runs) <= 50:
        raise ValueError("runs must be 1 to 50")
    last = log.where(F.col("entity") == entity).orderBy(F.desc("event_time")).limit(int(runs))
    w = Window.orderBy("event_time")  # ≤ 50 rows after the top-k
    return last.select(
        F.row_number().over(w).alias("run"),
        F.round("duplicates_ratio", 6).alias("ratio"),
    )


def latest_by_entity(log: DataFrame) -> DataFrame:
    """Newest row of every entity over the whole log, in the fixed entity
    order, entity name capitalised."""
    per = log.groupBy("entity").agg(
        F.max_by(
            F.struct("total_rows_raw", "inserted_rows_mart", "duplicates_rows", "invalid_rows", "duplicates_ratio"),
            "event_time",
        ).alias("r")
    )
    rank = F.array_position(F.array(*[F.lit(e) for e in C.QUALITY_ENTITY_ORDER]), F.col("entity"))
    return (
        per.where(rank > 0)
        .select(
            rank.alias("_rank"),
            F.initcap("entity").alias("entity"),
            F.col("r.total_rows_raw").alias("total_raw"),
            F.col("r.inserted_rows_mart").alias("valid_mart"),
            F.col("r.duplicates_rows").alias("duplicates"),
            F.col("r.invalid_rows").alias("invalid"),
            F.round("r.duplicates_ratio", 6).alias("ratio"),
        )
        .orderBy("_rank")
        .drop("_rank")
    )


def last_any(log: DataFrame) -> DataFrame:
    """Newest row regardless of entity (dashboard tiles); entity breaks ties
    between rows written by one snapshot."""
    return log.orderBy(F.desc("event_time"), "entity").limit(1).select(
        "entity", "duplicates_rows", "inserted_rows_mart", "invalid_rows", F.round("duplicates_ratio", 6).alias("duplicates_ratio")
    )


def history(entity: str, fields: DataFrame, ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    """The quality log a daily snapshot job would have written: for every
    ingest day of the entity, the counters over all RAW rows ingested up to
    the end of that day (``event_time`` = next midnight).

    Validity is judged at each row's arrival (as the insert-time MART view
    does), which makes every counter additive over days: totals and valid
    counts are running sums of per-day counts, and the distinct count is a
    running sum of "ids first seen that day".  One aggregate over two grouping
    sets gives both: by id its first day, by day its counts, so the rows are
    read and shuffled once, after a map-side step of numbers of fixed width (no
    lists).  A second, small one adds them up by day; the window runs over one
    row per (entity, day) — bounded by the calendar, not the data.
    """
    n = NORMALIZE[entity](fields)
    rows = n.select(
        F.to_date("ingested_at").alias("day"),
        F.to_date("ingested_at").alias("_seen"),
        F.coalesce(P.is_valid(entity, F.col("ingested_at"), ids), F.lit(False)).alias("_valid"),
        dup_key(entity).alias("_key"),
    )
    both = rows.groupingSets([["_key"], ["day"]], "_key", "day").agg(
        F.grouping("day").alias("_of_key"), F.min("_seen").alias("_first"),
        F.count(F.lit(1)).alias("_n"), F.count_if("_valid").alias("_v"))
    of_key = F.col("_of_key") == 1
    # an id whose rows all lack a day is first seen on none
    per_day = both.where(~of_key | F.col("_first").isNotNull()).select(
        F.when(of_key, F.col("_first")).otherwise(F.col("day")).alias("day"), of_key.alias("_new"),
        *[F.when(of_key, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("_n", "_v")])
    j = per_day.groupBy("day").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"), F.count_if("_new").alias("_new"))
    w = Window.partitionBy(F.lit(entity)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    tot = F.sum("_n").over(w)
    val = F.sum("_v").over(w)
    dist = F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(w)
    c = j.select(
        F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 86400).alias("event_time"),
        F.lit(entity).alias("entity"),
        tot.cast("long").alias("total_rows_raw"),
        val.cast("long").alias("inserted_rows_mart"),
        dist.cast("long").alias("_distinct"),
    )
    dup = F.col("total_rows_raw") - F.col("_distinct")
    return c.select(
        "event_time", "entity", "total_rows_raw", "inserted_rows_mart",
        (F.col("total_rows_raw") - F.col("inserted_rows_mart")).alias("invalid_rows"),
        dup.alias("duplicates_rows"),
        F.when(F.col("total_rows_raw") == 0, F.lit(0.0)).otherwise(dup / F.col("total_rows_raw")).alias("duplicates_ratio"),
    )


def history_all(fields_by_entity: dict[str, DataFrame], ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    out = None
    for entity, f in fields_by_entity.items():
        h = history(entity, f, ids)
        out = h if out is None else out.unionByName(h)
    return out


def append_snapshot(snap: DataFrame, path: str) -> None:
    """Append one snapshot to the quality log (a Parquet dataset partitioned
    by entity; appends are atomic per write job)."""
    snap.write.mode("append").partitionBy("entity").parquet(path)
