"""Resolve the standard RAW / MART tables from a data folder.

``fields`` come from the typed lens (no JSON round trip: MART tables are
stored typed); ``messages``/``raw`` go through JSON payloads exactly as a
stream would deliver them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import latest, mart, raw
from ..session import scratch_path
from ..sources import lens

AS_OF = C.DRIVER_AS_OF

LENS_FIELDS = {
    "stores": lens.stores,
    "products": lens.products,
    "customers": lens.customers,
    "purchases": lens.purchases,
    "purchase_items": lens.items,
}


#: entities whose tables may be one small file of many rows
SPREAD = ("customers", "products")


def fields(spark: SparkSession, d: str, entity: str, spread: bool = False) -> DataFrame:
    return LENS_FIELDS[entity](spark, d, **({"spread": True} if spread and entity in SPREAD else {}))


def mart_table(spark: SparkSession, d: str, entity: str, as_of=AS_OF, final: bool = True, spread: bool = False) -> DataFrame:
    """Valid rows of one entity; ``final`` keeps the newest version per key, and ``spread`` deals the rows of small
    files to all tasks first."""
    m = mart.mart(entity, fields(spark, d, entity, spread), as_of, C.DRIVER_IDS)
    return latest.latest_mart(entity, m) if final else m


def messages(spark: SparkSession, d: str, entity: str) -> DataFrame:
    return lens.messages(spark, d, entity)


def written_purchases(spark: SparkSession, d: str) -> DataFrame:
    """The purchase messages, written once: purchases and their lines are then two readers of one table
    instead of two builds of the documents."""
    sent = messages(spark, d, "purchases")
    path = scratch_path(spark, "messages-purchases")
    sent.write.parquet(path)
    return spark.read.schema(sent.schema).parquet(path)


def written_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the purchase messages and their lines, parsed and written once."""
    read = raw.read_purchases(messages(spark, d, "purchases"))
    path = scratch_path(spark, "fields-purchases")
    read.write.parquet(path)
    return spark.read.schema(read.schema).parquet(path)


def raw_table(spark: SparkSession, d: str, entity: str, purchases: DataFrame | None = None) -> DataFrame:
    """``purchases`` are written purchase messages or their written fields, if there are such."""
    if entity == "purchase_items":
        return raw.raw_purchase_items(raw.raw_purchases(purchases or messages(spark, d, "purchases"), keep_doc=True))
    return raw.RAW[entity](purchases if purchases and entity == "purchases" else messages(spark, d, entity))


def payload_fields(spark: SparkSession, d: str, entity: str, purchases: DataFrame | None = None) -> DataFrame:
    """Entity fields read back from the JSON messages (RAW → MART path)."""
    if entity == "purchase_items":
        return raw_table(spark, d, "purchase_items", purchases)
    return mart.FIELDS[entity](purchases if purchases and entity == "purchases" else messages(spark, d, entity))
