"""RAW → MART: normalise, validate, keep valid rows.

Every entity has two entry points that end in the same normalised columns:

* ``*_fields(raw)`` reads the fields from the RAW ``payload`` JSON;
* the lens (``sources/lens.py``) hands over the same fields as typed columns.

``normalize_*`` then lower/trim/parse them, and ``mart_*`` filters with the
shared predicates of ``functions/predicates.py``.  All steps are narrow
(no shuffle), so they run unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..functions.jsonx import js_bool, js_double, js_str, materialize_row, with_doc
from ..functions.norm import iso_date, norm
from ..functions.times import best_effort_ts


def _keep(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def as_of_col(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


# ----- fields from payload ---------------------------------------------------

def store_fields(raw: DataFrame) -> DataFrame:
    d = F.col("_doc")
    return with_doc(raw).select(
        js_str(d, "store_id").alias("store_id"),
        js_str(d, "store_network").alias("store_network"),
        js_str(d, "store_name").alias("store_name"),
        js_str(d, "location", "city").alias("city"),
        "payload",
        "ingested_at",
    )


def product_fields(raw: DataFrame) -> DataFrame:
    d = F.col("_doc")
    return with_doc(raw).select(
        js_str(d, "id").alias("product_id"),
        js_str(d, "group").alias("group"),
        js_str(d, "name").alias("name"),
        js_double(d, "price").alias("price"),
        js_str(d, "unit").alias("unit"),
        "payload",
        "ingested_at",
    )


def customer_fields(raw: DataFrame) -> DataFrame:
    d = F.col("_doc")
    return with_doc(raw).select(
        js_str(d, "customer_id").alias("customer_id"),
        js_str(d, "purchase_location", "store_id").alias("store_id"),
        js_str(d, "email").alias("email"),
        js_str(d, "phone").alias("phone"),
        js_str(d, "birth_date").alias("birth_date"),
        js_str(d, "registration_date").alias("registration_date"),
        "payload",
        "ingested_at",
    )


def purchase_fields(raw: DataFrame) -> DataFrame:
    if "_items" in raw.columns:  # rows of `raw.read_purchases`
        return raw.drop("_items")
    d = F.col("_doc")
    return with_doc(raw).select(
        js_str(d, "purchase_id").alias("purchase_id"),
        js_str(d, "customer", "customer_id").alias("customer_id"),
        js_str(d, "store", "store_id").alias("store_id"),
        js_double(d, "total_amount").alias("total_amount"),
        js_str(d, "payment_method").alias("payment_method"),
        js_bool(d, "is_delivery").alias("is_delivery"),
        js_str(d, "purchase_datetime").alias("purchase_datetime"),
        "payload",
        "ingested_at",
    )


FIELDS = {
    "stores": store_fields,
    "products": product_fields,
    "customers": customer_fields,
    "purchases": purchase_fields,
}


# ----- normalisation ---------------------------------------------------------

def normalize_stores(f: DataFrame) -> DataFrame:
    return f.select(
        norm("store_id").alias("store_id"),
        norm("store_network").alias("store_network"),
        norm("store_name").alias("store_name"),
        norm("city").alias("city"),
        *_keep(f, "payload", "ingested_at"),
    )


def normalize_products(f: DataFrame) -> DataFrame:
    return f.select(
        norm("product_id").alias("product_id"),
        norm(F.col("group")).alias("group"),
        norm("name").alias("name"),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        norm("unit").alias("unit"),
        *_keep(f, "is_organic", "payload", "ingested_at"),
    )


def normalize_customers(f: DataFrame) -> DataFrame:
    reg = F.trim(F.col("registration_date"))
    return f.select(
        norm("customer_id").alias("customer_id"),
        norm("store_id").alias("store_id"),
        F.trim(F.col("email")).alias("email_enc"),
        F.trim(F.col("phone")).alias("phone_enc"),
        iso_date(F.trim(F.col("birth_date"))).alias("birth_date"),
        reg.alias("registration_raw"),
        best_effort_ts(reg).alias("registration_dt"),
        *_keep(f, "payload", "ingested_at"),
    )


def normalize_purchases(f: DataFrame) -> DataFrame:
    return f.select(
        norm("purchase_id").alias("purchase_id"),
        norm("customer_id").alias("customer_id"),
        norm("store_id").alias("store_id"),
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("total_amount"),
        norm("payment_method").alias("payment_method"),
        F.coalesce(F.col("is_delivery").cast("int"), F.lit(0)).alias("is_delivery"),
        best_effort_ts(F.trim(F.col("purchase_datetime"))).alias("purchase_dt"),
        *_keep(f, "payload", "ingested_at"),
    )


def normalize_items(f: DataFrame) -> DataFrame:
    return f.select(
        norm("purchase_id").alias("purchase_id"),
        norm("customer_id").alias("customer_id"),
        norm("store_id").alias("store_id"),
        norm("product_id").alias("product_id"),
        norm("category").alias("category"),
        F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"),
        F.coalesce(F.col("price_per_unit").cast("double"), F.lit(0.0)).alias("price_per_unit"),
        F.coalesce(F.col("total_price").cast("double"), F.lit(0.0)).alias("total_price"),
        F.col("purchase_dt").cast("timestamp").alias("purchase_dt"),
        *_keep(f, "payload", "ingested_at"),
    )


NORMALIZE = {
    "stores": normalize_stores,
    "products": normalize_products,
    "customers": normalize_customers,
    "purchases": normalize_purchases,
    "purchase_items": normalize_items,
}

MART_COLUMNS = {
    "stores": ["store_id", "store_network", "store_name", "city"],
    "products": ["product_id", "group", "name", "price", "unit"],
    "customers": ["customer_id", "store_id", "email_enc", "phone_enc", "birth_date", "registration_dt"],
    "purchases": ["purchase_id", "customer_id", "store_id", "total_amount", "payment_method", "is_delivery", "purchase_dt"],
    "purchase_items": ["purchase_id", "customer_id", "store_id", "product_id", "category", "quantity",
                       "price_per_unit", "total_price", "purchase_dt"],
}


def mart(entity: str, fields: DataFrame, as_of, ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    """Normalise + validate one entity.  ``as_of`` replaces the wall clock in
    the "not in the future" rules."""
    n = materialize_row(NORMALIZE[entity](fields))
    keep = MART_COLUMNS[entity] + _keep(n, "is_organic", "payload", "ingested_at")
    return n.where(P.is_valid(entity, as_of_col(as_of), ids)).select(*keep)


def mart_stores(raw: DataFrame, as_of=None) -> DataFrame:
    return mart("stores", store_fields(raw), as_of)


def mart_products(raw: DataFrame, as_of=None) -> DataFrame:
    return mart("products", product_fields(raw), as_of)


def mart_customers(raw: DataFrame, as_of) -> DataFrame:
    return mart("customers", customer_fields(raw), as_of)


def mart_purchases(raw: DataFrame, as_of) -> DataFrame:
    return mart("purchases", purchase_fields(raw), as_of)


def mart_purchase_items(items_raw: DataFrame, as_of) -> DataFrame:
    return mart("purchase_items", items_raw, as_of)


def dq_errors(entity: str, fields: DataFrame, as_of, key: str, ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    """Rejected rows with one named reason per failed rule (one row per reason)."""
    n = NORMALIZE[entity](fields)
    reasons = P.reasons_for(entity, as_of_col(as_of), ids)
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in reasons
    ]))
    return (
        n.select(F.col(key).alias("business_key"), failed.alias("_failed"), *_keep(n, "ingested_at"))
        .where(F.size("_failed") > 0)
        .select("business_key", F.explode("_failed").alias("reason"), *_keep(n, "ingested_at"))
    )
