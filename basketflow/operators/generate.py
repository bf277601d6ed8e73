"""Seeded synthetic retail documents, generated on the executors.

Every pick is a pure function of (seed, entity key, field) through
``xxhash64``, so any partition can generate its rows independently and the
output is identical for any partitioning or scale — no driver-side random
state, no per-row Python.  Purchases are keyed by an input key column (for
example the driver's order keys), so the work grows with that input.

Distribution, not byte parity with the original single-machine fake-data generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The five product categories of the original generator
# (second generator's English names), in their original order.
CATEGORIES = [
    "Grains and Bakery",
    "Protein Foods",
    "Dairy",
    "Fruits and Berries",
    "Vegetables and Greens",
]
NETWORKS = ["almost", "maybe"]
UNITS = ["pcs", "kg", "l", "pack"]
PAYMENTS = ["card", "cash", "sbp"]
BASE_DATE = "2025-07-10 12:00:00"


def _h(seed: int, key: Column, field: str) -> Column:
    return F.xxhash64(F.lit(seed), key, F.lit(field))


def _pick(seed: int, key: Column, field: str, n: int) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(_h(seed, key, field), F.lit(n))


def _price(seed: int, idx: Column) -> Column:
    return F.round(F.lit(20.0) + _pick(seed, idx, "price", 48001) / 100.0, 2)


def stores(spark: SparkSession, n: int = 45, seed: int = 42) -> DataFrame:
    i = F.col("id")
    big = (n * 2) // 3
    return spark.range(1, n + 1).select(
        F.format_string("store-%03d", i).alias("store_id"),
        F.when(i <= big, NETWORKS[0]).otherwise(NETWORKS[1]).alias("store_network"),
        F.format_string("Store %d", i).alias("store_name"),
        F.struct(F.format_string("City %d", _pick(seed, i, "city", 12) + 1).alias("city")).alias("location"),
    )


def products(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    i = F.col("id")
    per = max(n // len(CATEGORIES), 1)
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                       F.least(((i - 1) / per).cast("int") + 1, F.lit(len(CATEGORIES))))
    return spark.range(1, n + 1).select(
        F.format_string("prd-%04d", i).alias("id"),
        F.format_string("Product %d", i).alias("name"),
        cat.alias("group"),
        _price(seed, i).alias("price"),
        F.element_at(F.array(*[F.lit(u) for u in UNITS]), (_pick(seed, i, "unit", len(UNITS)) + 1).cast("int"))
        .alias("unit"),
        (_pick(seed, i, "organic", 2) == 1).alias("is_organic"),
    )


def _customers_of_store(seed: int, s: Column) -> Column:
    return _pick(seed, s, "ncust", 4) + 2  # 2..5 customers per store


def customers(spark: SparkSession, n_stores: int = 45, seed: int = 42) -> DataFrame:
    s = F.col("id")
    per = spark.range(1, n_stores + 1).select(s.alias("s"), F.explode(F.sequence(F.lit(1), _customers_of_store(seed, s)
                                                                                .cast("int"))).alias("j"))
    cid = (F.col("s") - 1) * 5 + F.col("j")
    reg = F.timestamp_seconds(F.unix_seconds(F.lit(BASE_DATE).cast("timestamp"))
                              - _pick(seed, cid, "reg", 900 * 1440) * 60)
    return per.select(
        F.format_string("cus-%06d", cid).alias("customer_id"),
        F.format_string("user%d@example.com", cid).alias("email"),
        F.format_string("+7900%07d", cid).alias("phone"),
        F.date_format(F.date_sub(F.lit("2005-01-01").cast("date"), _pick(seed, cid, "birth", 20000).cast("int")),
                      "yyyy-MM-dd").alias("birth_date"),
        F.date_format(reg, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("registration_date"),
        F.struct(F.format_string("store-%03d", "s").alias("store_id")).alias("purchase_location"),
    )


def purchases(keys: DataFrame, key_col: str, n_stores: int = 45, n_products: int = 100, seed: int = 42) -> DataFrame:
    """One purchase document per input key, 1..3 distinct products each."""
    k = F.col(key_col)
    s = _pick(seed, k, "store", n_stores) + 1
    cust = (s - 1) * 5 + (F.pmod(_h(seed, k, "cust"), _customers_of_store(seed, s)) + 1)
    lines = _pick(seed, k, "lines", 3) + 1
    start = _pick(seed, k, "prod", n_products)
    idx = F.sequence(F.lit(0), (lines - 1).cast("int"))

    def item(j):
        p = F.pmod(start + j, F.lit(n_products)) + 1
        q = _pick(seed, F.concat_ws(":", k.cast("string"), j.cast("string")), "qty", 5) + 1
        price = _price(seed, p)
        return F.struct(
            F.format_string("prd-%04d", p).alias("product_id"),
            F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                         F.least(((p - 1) / max(n_products // len(CATEGORIES), 1)).cast("int") + 1,
                                 F.lit(len(CATEGORIES)))).alias("category"),
            q.cast("int").alias("quantity"),
            price.alias("price_per_unit"),
            F.round(price * q, 2).alias("total_price"),
        )

    items = F.transform(idx, item)
    minutes = _pick(seed, k, "days", 121) * 1440 + _pick(seed, k, "minute", 1440)
    ts = F.timestamp_seconds(F.unix_seconds(F.lit(BASE_DATE).cast("timestamp")) - minutes * 60)
    return keys.select(
        F.format_string("ord-%06d", k).alias("purchase_id"),
        F.struct(F.format_string("cus-%06d", cust).alias("customer_id")).alias("customer"),
        F.struct(F.format_string("store-%03d", s).alias("store_id")).alias("store"),
        items.alias("items"),
        F.round(F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["total_price"]), 2).alias("total_amount"),
        F.element_at(F.array(*[F.lit(p) for p in PAYMENTS]), (_pick(seed, k, "pay", 3) + 1).cast("int"))
        .alias("payment_method"),
        (_pick(seed, k, "delivery", 2) == 1).alias("is_delivery"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("purchase_datetime"),
    )


def self_check(stores_df: DataFrame, products_df: DataFrame, customers_df: DataFrame, purchases_df: DataFrame,
               n_stores: int = 45, n_products: int = 100) -> DataFrame:
    """Assertion table (check, expected, actual, ok) in one pass per table."""
    per_cat = products_df.groupBy("group").count().agg(F.min("count").alias("mn"), F.max("count").alias("mx"),
                                                       F.count(F.lit(1)).alias("cats"))
    parts = [
        stores_df.agg(F.lit("stores").alias("check"), F.lit(f"= {n_stores}").alias("expected"),
                      F.count(F.lit(1)).alias("actual")).withColumn("ok", F.col("actual") == n_stores),
        products_df.agg(F.lit("products").alias("check"), F.lit(f"= {n_products}").alias("expected"),
                        F.count(F.lit(1)).alias("actual")).withColumn("ok", F.col("actual") == n_products),
        per_cat.select(F.lit("products_per_category").alias("check"),
                       F.lit(f"= {n_products // len(CATEGORIES)} x {len(CATEGORIES)}").alias("expected"),
                       F.col("mn").alias("actual"),
                       ((F.col("mn") == n_products // len(CATEGORIES)) & (F.col("mx") == F.col("mn"))
                        & (F.col("cats") == len(CATEGORIES))).alias("ok")),
        customers_df.agg(F.lit("customers").alias("check"), F.lit(f">= {n_stores}").alias("expected"),
                         F.count(F.lit(1)).alias("actual")).withColumn("ok", F.col("actual") >= n_stores),
        purchases_df.agg(F.lit("purchases").alias("check"), F.lit(">= 200").alias("expected"),
                         F.count(F.lit(1)).alias("actual")).withColumn("ok", F.col("actual") >= 200),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
