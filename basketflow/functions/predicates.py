"""MART validity rules, one home for each entity.

The MART filter, the quality counters (``count_if`` of the same rule) and the
``dq_errors`` reasons all call these functions, so they cannot drift apart.
Each takes already-normalised columns (see ``operators/mart.py``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .norm import matches


def _id(c: str, pattern: str) -> Column:
    return (F.col(c) != "") & matches(c, pattern)


def _hash_or_blank(c: str) -> Column:
    return (F.col(c) == "") | matches(c, C.HASH_PATTERN)


def store_reasons(ids: C.IdPatterns = C.RETAIL_IDS) -> list[tuple[str, Column]]:
    return [
        ("store_id", _id("store_id", ids.store)),
        ("store_network", F.col("store_network") != ""),
        ("city", F.col("city") != ""),
    ]


def product_reasons(ids: C.IdPatterns = C.RETAIL_IDS) -> list[tuple[str, Column]]:
    return [
        ("product_id", _id("product_id", ids.product)),
        ("price", F.col("price") >= 0),
        ("unit", F.col("unit") != ""),
    ]


def customer_reasons(as_of: Column, ids: C.IdPatterns = C.RETAIL_IDS) -> list[tuple[str, Column]]:
    return [
        ("customer_id", _id("customer_id", ids.customer)),
        ("store_id", _id("store_id", ids.store)),
        ("email_enc", _hash_or_blank("email_enc")),
        ("phone_enc", _hash_or_blank("phone_enc")),
        ("birth_date", F.col("birth_date").isNotNull() & (F.col("birth_date") <= F.to_date(as_of))),
        ("registration_dt", (F.col("registration_raw") == "") | F.col("registration_dt").isNotNull()),
    ]


def purchase_reasons(as_of: Column, ids: C.IdPatterns = C.RETAIL_IDS) -> list[tuple[str, Column]]:
    return [
        ("purchase_id", _id("purchase_id", ids.purchase)),
        ("customer_id", _id("customer_id", ids.customer)),
        ("store_id", _id("store_id", ids.store)),
        ("total_amount", F.col("total_amount") >= 0),
        ("payment_method", F.col("payment_method").isin(*C.PAYMENT_METHODS)),
        ("purchase_dt", F.col("purchase_dt").isNotNull() & (F.col("purchase_dt") <= as_of)),
    ]


def item_reasons(as_of: Column, ids: C.IdPatterns = C.RETAIL_IDS) -> list[tuple[str, Column]]:
    return [
        ("purchase_id", _id("purchase_id", ids.purchase)),
        ("customer_id", _id("customer_id", ids.customer)),
        ("store_id", _id("store_id", ids.store)),
        ("product_id", _id("product_id", ids.product)),
        ("category", F.col("category") != ""),
        ("purchase_dt", F.col("purchase_dt").isNotNull() & (F.col("purchase_dt") <= as_of)),
        ("quantity", F.col("quantity") > 0),
        ("price_per_unit", F.col("price_per_unit") >= 0),
        ("total_price", F.col("total_price") >= 0),
    ]


def all_of(reasons: list[tuple[str, Column]]) -> Column:
    out = F.lit(True)
    for _, cond in reasons:
        out = out & F.coalesce(cond, F.lit(False))
    return out


def reasons_for(entity: str, as_of: Column, ids: C.IdPatterns = C.RETAIL_IDS) -> list[tuple[str, Column]]:
    if entity == "stores":
        return store_reasons(ids)
    if entity == "products":
        return product_reasons(ids)
    if entity == "customers":
        return customer_reasons(as_of, ids)
    if entity == "purchases":
        return purchase_reasons(as_of, ids)
    if entity == "purchase_items":
        return item_reasons(as_of, ids)
    raise ValueError(f"unknown entity {entity!r}")


def is_valid(entity: str, as_of: Column, ids: C.IdPatterns = C.RETAIL_IDS) -> Column:
    return all_of(reasons_for(entity, as_of, ids))
