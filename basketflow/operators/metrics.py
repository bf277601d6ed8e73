"""Operational metric queries over RAW and MART tables.

Each function takes the already-resolved tables (MART tables after
``latest_by_key``) plus an explicit ``as_of``; none reads the wall clock.
Result sets are tiny (a handful of groups), so the final ordering and the
``sum() over ()`` share run on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import norm
from .mart import as_of_col


def _clamp(v: int, lo: int, hi: int) -> int:
    if not lo <= int(v) <= hi:
        raise ValueError(f"{v} is outside {lo} to {hi}")
    return int(v)


def _since(as_of, days: int):
    return F.timestamp_seconds(F.unix_seconds(as_of_col(as_of)) - F.lit(days * 86400))


def payments_breakdown(purchases: DataFrame, as_of, days: int = 7) -> DataFrame:
    """card / cash / everything else (``sbp``): count and share over the last
    ``days`` (1..90) days; when that window is empty, over all time.  Both
    counts come from one aggregation pass; the fallback is decided on the
    (at most three) aggregated rows."""
    n = _clamp(days, 1, 90)
    m = norm("payment_method")
    method = F.when(m == "card", "card").when(m == "cash", "cash").otherwise("sbp")
    agg = purchases.groupBy(method.alias("method")).agg(
        F.count(F.lit(1)).alias("all_cnt"),
        F.count_if(F.col("purchase_dt") >= _since(as_of, n)).alias("win_cnt"),
    )
    whole = Window.partitionBy()  # ≤ 3 rows: a global window is bounded here
    cnt = F.when(F.sum("win_cnt").over(whole) > 0, F.col("win_cnt")).otherwise(F.col("all_cnt"))
    out = agg.select("method", cnt.alias("count")).where(F.col("count") > 0)
    total = F.sum("count").over(whole)
    return out.select(
        "method", "count", F.round(F.col("count") / total, 6).alias("share")
    ).orderBy(F.desc("count"), "method")


def kpi_overview(stores: DataFrame, purchases: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """One row: distinct stores, distinct purchases, customers, distinct
    products.  Four independent global aggregates, combined by a union and a
    one-group pivot (no join)."""
    parts = [
        stores.select(F.lit("stores_uniq").alias("k"), F.count_distinct("store_id").alias("v")),
        purchases.select(F.lit("purchases_uniq").alias("k"), F.count_distinct("purchase_id").alias("v")),
        customers.select(F.lit("customers_mart").alias("k"), F.count(F.lit(1)).alias("v")),
        products.select(F.lit("items_mart").alias("k"), F.count_distinct("product_id").alias("v")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[
        F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("long").alias(k)
        for k in ("stores_uniq", "purchases_uniq", "customers_mart", "items_mart")
    ])


def ingestion_series(purchases_raw: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Rows per ingest day over the last ``days`` (1..30) days; days without
    rows are absent, as in the original."""
    n = _clamp(days, 1, 30)
    return (
        purchases_raw.where(F.col("ingested_at") >= _since(as_of, n))
        .groupBy(F.to_date("ingested_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("day")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``UNION ALL`` of per-table counts: (t, c)."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("t"), F.count(F.lit(1)).alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


def unique_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Exact distinct ids per table: (t, c)."""
    out = None
    for name, (df, key) in tables.items():
        one = df.select(F.lit(name).alias("t"), F.count_distinct(key).alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


def stores_by_network(stores_raw: DataFrame) -> DataFrame:
    return stores_raw.groupBy("store_network").agg(F.count(F.lit(1)).alias("stores_count"))


def job_run_duration(runs: DataFrame) -> DataFrame:
    """finished − started in milliseconds; NULL when either is missing."""
    return runs.withColumn(
        "duration_ms",
        F.when(
            F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(),
            F.unix_millis("finished_at") - F.unix_millis("started_at"),
        ),
    )


def job_run_recent(runs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest ``limit`` (1..100) runs, newest first (top-k, no full sort)."""
    n = _clamp(limit, 1, 100)
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
