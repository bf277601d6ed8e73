"""Stream messages → RAW tables: key columns extracted beside the payload.

Each message is one JSON document in a ``payload`` string column plus an
``ingested_at`` arrival time.  Extraction follows the original engine's
defaults (missing string → ``''``, missing number → ``0.0``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import flag_of, js_array, js_double, js_str, js_text, materialize_row, text_of, with_doc
from ..functions.norm import norm
from ..functions.times import best_effort_ts


def raw_stores(msgs: DataFrame) -> DataFrame:
    d = F.col("_doc")
    return with_doc(msgs).select(
        js_str(d, "store_id").alias("store_id"),
        js_str(d, "store_network").alias("store_network"),
        "payload",
        "ingested_at",
    )


def raw_products(msgs: DataFrame) -> DataFrame:
    d = F.col("_doc")
    return with_doc(msgs).select(
        js_str(d, "id").alias("product_id"),
        js_str(d, "group").alias("group"),
        "payload",
        "ingested_at",
    )


def raw_customers(msgs: DataFrame) -> DataFrame:
    d = F.col("_doc")
    return with_doc(msgs).select(
        js_str(d, "customer_id").alias("customer_id"),
        js_str(d, "purchase_location", "store_id").alias("store_id"),
        js_str(d, "email").alias("email_enc"),
        js_str(d, "phone").alias("phone_enc"),
        "payload",
        "ingested_at",
    )


_NUMBERS = ("quantity", "price_per_unit", "total_price")
_TEXTS = (("purchase_id",), ("customer", "customer_id"), ("store", "store_id"), ("payment_method",), ("purchase_datetime",))


def _read_type(text: str, flag: str) -> str:
    """What purchases and their lines read of a document."""
    item = f"struct<product_id: {text}, category: {text}, {', '.join(f'{c}: double' for c in _NUMBERS)}>"
    return (f"purchase_id {text}, customer struct<customer_id: {text}>, store struct<store_id: {text}>, total_amount double, "
            f"payment_method {text}, is_delivery {flag}, purchase_datetime {text}, items array<{item}>")


#: the beginning of no JSON but a string: no number, true, false, object or array is written so
_TEXT = r"\A(?:[^-0-9tf{\[]|-?[0-9][-+.0-9eE]*[^-+.0-9eE])"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_corrupt"}


def read_purchases(msgs: DataFrame) -> DataFrame:
    """The fields of purchase messages and, in ``_items``, of their lines, each message read once; neither the text
    nor the parsed document goes on. ``raw_purchases``, ``raw_purchase_items`` and ``mart.purchase_fields`` take these
    rows in place of messages.

    ``from_json`` reads a document into columns several times faster than values are taken out of a VARIANT, but it is
    laxer. So its fields count only if the text is a well-formed object (``try_parse_json``) without a field of an
    unexpected type or a string that could be the text of another type; else they are taken from the VARIANT."""
    read = F.from_json("payload", f"{_read_type('string', 'boolean')}, _corrupt string", _STRICT)
    rows = with_doc(msgs).select("_doc", "ingested_at", read.alias("d"), F.col("payload").startswith("{").alias("_object"))

    def clear(v):
        return v.isNull() | (v == "") | v.rlike(_TEXT)

    def fields(d, text, flag):
        def line(it):
            return F.struct(text(it["product_id"]).alias("product_id"), text(it["category"]).alias("category"),
                            *[number(it[c]).alias(c) for c in _NUMBERS])

        return F.struct(*[text(d(*keys)).alias(keys[-1]) for keys in _TEXTS], number(d("total_amount")).alias("total_amount"),
                        flag(d("is_delivery")).alias("is_delivery"), F.transform(d("items"), line).alias("_items"))

    def number(v):
        return F.coalesce(v, F.lit(0.0)) + F.lit(0.0)  # no negative zero

    def quick(*keys):
        return F.col(".".join(("d", *keys)))

    def slow(*keys):
        v = F.try_variant_get("_doc", F.lit("$"), f"struct<{_read_type('variant', 'variant')}>")
        for key in keys:
            v = v[key]
        return v

    sure = F.col("_doc").isNotNull() & F.col("_object") & quick("_corrupt").isNull()
    for keys in _TEXTS:
        sure = sure & clear(quick(*keys))
    sure = sure & F.coalesce(F.forall(quick("items"), lambda it: clear(it["product_id"]) & clear(it["category"])), F.lit(True))
    plain = fields(quick, lambda v: F.coalesce(v, F.lit("")), lambda v: F.coalesce(v, F.lit(False)).cast("int"))
    got = rows.select(F.when(sure, plain).otherwise(fields(slow, text_of, flag_of)).alias("f"), "ingested_at")
    return got.select("f.purchase_id", "f.customer_id", "f.store_id", "f.total_amount", "f.payment_method", "f.is_delivery",
                      "f.purchase_datetime", "f._items", "ingested_at")


def raw_purchases(msgs: DataFrame, keep_doc: bool = False) -> DataFrame:
    """``keep_doc`` carries the parsed document along so a downstream array
    join in the same plan (``raw_purchase_items``) does not parse it again.
    Rows of ``read_purchases`` have no text, so their RAW rows have none."""
    if "_items" in msgs.columns:
        return msgs.select(*(["_items"] if keep_doc else []), "purchase_id", "customer_id", "store_id", "total_amount",
                           best_effort_ts("purchase_datetime").alias("purchase_datetime"), "ingested_at")
    d = F.col("_doc")
    return with_doc(msgs).select(
        *(["_doc"] if keep_doc else []),
        js_str(d, "purchase_id").alias("purchase_id"),
        js_str(d, "customer", "customer_id").alias("customer_id"),
        js_str(d, "store", "store_id").alias("store_id"),
        js_double(d, "total_amount").alias("total_amount"),
        best_effort_ts(js_str(d, "purchase_datetime")).alias("purchase_datetime"),
        "payload",
        "ingested_at",
    )


def raw_purchase_items(purchases_raw: DataFrame) -> DataFrame:
    """Array join: one row per element of the purchase's ``items`` array
    (``explode`` is an inner array join: a purchase with ``[]`` or no items
    yields no row).  Lines without a purchase or product id are dropped; the
    element's JSON is kept as the line's payload."""
    d = F.col("_doc")
    known = "_items" in purchases_raw.columns
    src = purchases_raw if known or "_doc" in purchases_raw.columns else with_doc(purchases_raw)
    lines = src.select(
        norm("purchase_id").alias("purchase_id"),
        norm("customer_id").alias("customer_id"),
        norm("store_id").alias("store_id"),
        F.col("purchase_datetime").alias("purchase_dt"),
        "ingested_at",
        F.explode(F.col("_items") if known else js_array(d, "items")).alias("item"),
    )
    it = F.col("item")
    text, number = ((lambda v, c: v[c]),) * 2 if known else (js_str, js_double)
    # the filter reads extracted ids; the element's text comes after it, made only if it is asked for
    read = materialize_row(lines.select(
        "purchase_id",
        "customer_id",
        "store_id",
        norm(text(it, "product_id")).alias("product_id"),
        norm(text(it, "category")).alias("category"),
        number(it, "quantity").alias("quantity"),
        number(it, "price_per_unit").alias("price_per_unit"),
        number(it, "total_price").alias("total_price"),
        "purchase_dt",
        *([] if known else ["item"]),
        "ingested_at",
    ))
    kept = read.where((F.col("purchase_id") != "") & (F.col("product_id") != ""))
    return kept if known else kept.withColumn("item", js_text(it)).withColumnRenamed("item", "payload")


RAW = {
    "stores": raw_stores,
    "products": raw_products,
    "customers": raw_customers,
    "purchases": raw_purchases,
}
