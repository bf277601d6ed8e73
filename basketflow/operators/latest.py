"""Read-time "latest version per key" (a replacing merge, done on read).

One aggregation keyed by the business key: the winning row is the maximum of
``struct(version, <every other column>)`` so ties on the version resolve by
the remaining columns in a fixed order and the result is deterministic.  The
aggregate has a map-side partial step, so re-sent copies of a key collapse
before the shuffle; a hot key (a third of all rows on one id) costs one row
per map task in the exchange, never a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPARABLE_FAIL = ("map", "variant")


def latest_by_key(
    df: DataFrame,
    keys: Sequence[str],
    version: str = "ingested_at",
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    keys = list(keys)
    cols = [c for c in df.columns if c not in keys]
    others = [c for c in cols if c != version]
    if tiebreak is None:
        tiebreak = [c for c in others if not df.schema[c].dataType.simpleString().startswith(_COMPARABLE_FAIL)]
    rest = [c for c in others if c not in tiebreak]
    order = [version, *tiebreak, *rest]
    # field names _v0.. keep the struct free of name clashes with the keys
    packed = F.struct(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(order)])
    out = df.groupBy(*keys).agg(F.max(packed).alias("_w"))
    return out.select(*keys, *[F.col(f"_w._v{i}").alias(c) for i, c in enumerate(order)]).select(*df.columns)


MART_KEYS = {
    "stores": ["store_id"],
    "products": ["product_id"],
    "customers": ["customer_id"],
    "purchases": ["purchase_id"],
    "purchase_items": ["purchase_id", "product_id"],
}


def latest_mart(entity: str, mart_df: DataFrame, with_payload: bool = False) -> DataFrame:
    """Newest row per key. The message text takes no part in the order, and is neither compared nor
    shuffled unless asked for."""
    rows = mart_df if with_payload else mart_df.drop("payload")
    return latest_by_key(rows, MART_KEYS[entity], tiebreak=[c for c in rows.columns if c not in (*MART_KEYS[entity], "ingested_at", "payload")])


def compact(df: DataFrame, keys: Sequence[str], out_path: str, version: str = "ingested_at") -> str:
    """Batch form of the background merge: write the newest version per key
    to ``out_path`` (a fresh dataset; readers switch to it afterwards)."""
    latest_by_key(df, keys, version).write.mode("overwrite").parquet(out_path)
    return out_path
