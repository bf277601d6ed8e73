"""Query catalog: every registered job as (Spark builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables; the oracle is the same question in SQL (``None`` when it
cannot be said in SQL: the driver then checks row counts only).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .. import config as C
from ..functions.norm import ts_text
from ..functions import pii as pii_fn
from ..operators import alerts, feature_history, features, imports, latest, mart, metrics, pii, quality, raw, search
from ..sources import lens
from . import oracle as O
from .tables import AS_OF, mart_table, messages, payload_fields, raw_table, written_fields, written_purchases

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str | None] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return deco


# ----- metrics ----------------------------------------------------------------

ALL_TIME_AS_OF = "2003-01-01 00:00:00"


def _payments_sql(as_of: str, days: int) -> str:
    body = f"""
, m AS (SELECT CASE WHEN lower(trim(payment_method)) = 'card' THEN 'card'
                    WHEN lower(trim(payment_method)) = 'cash' THEN 'cash' ELSE 'sbp' END AS method, purchase_dt
        FROM mart_purchases),
agg AS (SELECT method, count(*) AS all_cnt,
               count_if(purchase_dt >= TIMESTAMP '{as_of}' - to_days({days})) AS win_cnt
        FROM m GROUP BY method),
c AS (SELECT method, CAST(CASE WHEN sum(win_cnt) OVER () > 0 THEN win_cnt ELSE all_cnt END AS BIGINT) AS count
      FROM agg)
SELECT method, count, round(count / sum(count) OVER (), 6) AS share FROM c WHERE count > 0"""
    w = O.with_ctes(["mart_purchases"], "", as_of=as_of)
    return w.rstrip() + body


@register("payments_breakdown", _payments_sql(AS_OF, 7))
def q_payments_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.payments_breakdown(mart_table(spark, d, "purchases"), AS_OF, days=7)


@register("payments_breakdown_all_time", _payments_sql(ALL_TIME_AS_OF, 90))
def q_payments_breakdown_all_time(spark: SparkSession, d: str) -> DataFrame:
    """Clock after the last purchase: the 90-day window is empty, so the
    breakdown falls back to all time."""
    p = mart_table(spark, d, "purchases", as_of=ALL_TIME_AS_OF)
    return metrics.payments_breakdown(p, ALL_TIME_AS_OF, days=90)


# ----- feature matrix -----------------------------------------------------------

PROFILE = C.DRIVER


def feature_inputs(spark: SparkSession, d: str, as_of=AS_OF, spread: bool = False):
    return (
        mart_table(spark, d, "customers", as_of, spread=spread),
        mart_table(spark, d, "purchases", as_of),
        mart_table(spark, d, "products", as_of, spread=spread),
        mart_table(spark, d, "purchase_items", as_of),
    )


def matrix(spark: SparkSession, d: str) -> DataFrame:
    c, p, pr, i = feature_inputs(spark, d)
    return features.feature_matrix(c, p, pr, i, AS_OF, PROFILE)


@register("feat_matrix", O.with_features("SELECT * FROM f_matrix", PROFILE))
def q_feat_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@register("feat_matrix_early", O.with_features("SELECT * FROM f_matrix", PROFILE, C.EARLY_AS_OF))
def q_feat_matrix_early(spark: SparkSession, d: str) -> DataFrame:
    """The same matrix at a clock at which many customers have no purchase yet."""
    c, p, pr, i = feature_inputs(spark, d, C.EARLY_AS_OF)
    return features.feature_matrix(c, p, pr, i, C.EARLY_AS_OF, PROFILE)


#: the clocks of the history: year starts, the clock of the early matrix among them, and midnights between
HISTORY_DATES = tuple(f"{y}-{m:02d}-01 00:00:00" for y in (1993, 1996, 1999) for m in (1, 8))


def _history_sql() -> str:
    one = "SELECT TIMESTAMP '{0}' AS as_of, * FROM ({1})"
    return "\nUNION ALL\n".join(one.format(a, O.with_features("SELECT * FROM f_matrix", PROFILE, a)) for a in HISTORY_DATES)


@register("feat_matrix_history", f"SELECT * REPLACE (strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of) FROM ({_history_sql()})")
def q_feat_matrix_history(spark: SparkSession, d: str) -> DataFrame:
    """The matrix at six dates from one pass; the oracle runs the matrix date by date."""
    c, p, pr, i = feature_inputs(spark, d, max(HISTORY_DATES), spread=True)
    return feature_history.feature_history(c, p, pr, i, HISTORY_DATES, PROFILE).withColumn("as_of", ts_text("as_of"))


@register("feat_customers_base", O.with_features("SELECT customer_id FROM f_base", PROFILE))
def q_feat_customers_base(spark: SparkSession, d: str) -> DataFrame:
    return features.customers_base(mart_table(spark, d, "customers"))


_PAGG_COLS = ["purchases_all_time", "purchases_last_7d", "purchases_last_14d", "purchases_last_30d",
              "purchases_last_90d", "avg_total_amount", "cash_share", "card_share", "weekend_share", "weekday_share",
              "night_share", "morning_share", "delivery_any", "delivery_any_30d", "max_total_amount_90d",
              "distinct_stores_90d", "used_cash_90d", "used_card_90d"]


def _round_sql(cols):
    out = []
    for c in cols:
        if c.startswith(("avg_", "max_total")) or c.endswith("_share"):
            out.append(f"round({c}, 6) AS {c}")
        else:
            out.append(f"CAST({c} AS BIGINT) AS {c}")
    return ", ".join(out)


@register("feat_purchase_agg", O.with_features(f"SELECT customer_id, {_round_sql(_PAGG_COLS)} FROM f_pagg", PROFILE))
def q_feat_purchase_agg(spark: SparkSession, d: str) -> DataFrame:
    agg = features.purchase_agg(features.purchase_flags(mart_table(spark, d, "purchases"), AS_OF, PROFILE))
    return agg.select("customer_id", *[
        (F.round(c, 6) if c.startswith(("avg_", "max_total")) or c.endswith("_share") else F.col(c).cast("long")).alias(c)
        for c in _PAGG_COLS
    ])


@register("feat_purchase_flags", O.with_features(
    "SELECT customer_id, store_id, payment_method, is_last_7d, is_last_14d, is_last_30d, is_last_90d, cash_flag, "
    "card_flag, weekend_flag, weekday_flag, night_flag, morning_flag FROM f_pflags", PROFILE))
def q_feat_purchase_flags(spark: SparkSession, d: str) -> DataFrame:
    f = features.purchase_flags(mart_table(spark, d, "purchases"), AS_OF, PROFILE)
    return f.select("customer_id", "store_id", "payment_method", "is_last_7d", "is_last_14d", "is_last_30d",
                    "is_last_90d", "cash_flag", "card_flag", "weekend_flag", "weekday_flag", "night_flag",
                    "morning_flag")


@register("feat_products_clean", O.with_features("SELECT * FROM f_products", PROFILE))
def q_feat_products_clean(spark: SparkSession, d: str) -> DataFrame:
    return features.products_clean(mart_table(spark, d, "products"))


@register("feat_items_enriched", O.with_features(
    "SELECT customer_id, product_id, category_raw, product_group, is_organic_int, category_norm FROM f_items", PROFILE))
def q_feat_items_enriched(spark: SparkSession, d: str) -> DataFrame:
    e = features.items_enriched(mart_table(spark, d, "purchase_items"), mart_table(spark, d, "products"))
    return e.select("customer_id", "product_id", "category_raw", "product_group", "is_organic_int", "category_norm")


@register("feat_item_flags", O.with_features(
    "SELECT customer_id, product_id, is_last_7d, is_last_30d, is_last_90d, is_milk_item, is_meat_item, "
    "is_fruits_item, is_vegetables_item, is_bakery_item FROM f_items", PROFILE))
def q_feat_item_flags(spark: SparkSession, d: str) -> DataFrame:
    e = features.items_enriched(mart_table(spark, d, "purchase_items"), mart_table(spark, d, "products"))
    f = features.item_flags(e, AS_OF, PROFILE)
    return f.select("customer_id", "product_id", "is_last_7d", "is_last_30d", "is_last_90d", "is_milk_item",
                    "is_meat_item", "is_fruits_item", "is_vegetables_item", "is_bakery_item")


@register("feat_item_agg", O.with_features("SELECT * FROM f_iagg", PROFILE))
def q_feat_item_agg(spark: SparkSession, d: str) -> DataFrame:
    e = features.items_enriched(mart_table(spark, d, "purchase_items"), mart_table(spark, d, "products"))
    return features.item_agg(features.item_flags(e, AS_OF, PROFILE), PROFILE)


@register("feat_no_purchases_count", O.with_features(
    "SELECT CAST(count_if(no_purchases = 1) AS BIGINT) AS no_purchases_customers FROM f_matrix", PROFILE))
def q_feat_no_purchases_count(spark: SparkSession, d: str) -> DataFrame:
    return features.no_purchases_count(matrix(spark, d))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(sum({c}) AS BIGINT) AS ones FROM f_matrix" for c in C.FEATURE_COLUMNS
)


@register("feat_summary", O.with_features(f"SELECT * FROM ({_UNPIVOT})", PROFILE))
def q_feat_summary(spark: SparkSession, d: str) -> DataFrame:
    return features.summary(matrix(spark, d))


@register("feat_search_page", O.with_features(
    "SELECT * FROM f_matrix WHERE contains(lower(customer_id), '0001') ORDER BY customer_id LIMIT 25 OFFSET 25",
    PROFILE))
def q_feat_search_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 (25 per page) of customers whose id contains ``00001``; the
    limit is the feature (a UI page)."""
    return features.search_page(matrix(spark, d), "0001", page=2, page_size=25)


# ----- RAW layer (JSON messages → key columns) ------------------------------------

def _tsq(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def _tss(c: str):
    return ts_text(c).alias(c)


_RAW_SQL = {
    "raw_stores": f"SELECT store_id, store_network, {_tsq('ingested_at')} FROM msg_stores",
    "raw_products": f'SELECT product_id, "group", {_tsq("ingested_at")} FROM msg_products',
    "raw_customers": f"SELECT customer_id, store_id, email AS email_enc, phone AS phone_enc, {_tsq('ingested_at')} "
                     "FROM msg_customers",
    "raw_purchases": f"SELECT purchase_id, customer_id, store_id, total_amount, "
                     f"strftime({O._ts('purchase_datetime')}, '%Y-%m-%d %H:%M:%S') AS purchase_datetime, "
                     f"{_tsq('ingested_at')} FROM msg_purchases",
    "raw_purchase_items": f"SELECT purchase_id, customer_id, store_id, product_id, category, quantity, price_per_unit, "
                          f"total_price, {_tsq('purchase_dt')}, {_tsq('ingested_at')} FROM msg_items",
}


def _sql(names, body):
    return O.with_ctes(names, body)


def _msg_names(body: str) -> list[str]:
    return [n for n in O.all_defs() if n in body]


@register("raw_stores", _sql(["msg_stores"], _RAW_SQL["raw_stores"]))
def q_raw_stores(spark, d):
    return raw_table(spark, d, "stores").select("store_id", "store_network", _tss("ingested_at"))


@register("raw_products", _sql(["msg_products"], _RAW_SQL["raw_products"]))
def q_raw_products(spark, d):
    return raw_table(spark, d, "products").select("product_id", "group", _tss("ingested_at"))


@register("raw_customers", _sql(["msg_customers"], _RAW_SQL["raw_customers"]))
def q_raw_customers(spark, d):
    return raw_table(spark, d, "customers").select("customer_id", "store_id", "email_enc", "phone_enc",
                                                   _tss("ingested_at"))


@register("raw_purchases", _sql(["msg_purchases"], _RAW_SQL["raw_purchases"]))
def q_raw_purchases(spark, d):
    return raw_table(spark, d, "purchases").select("purchase_id", "customer_id", "store_id", "total_amount",
                                                   _tss("purchase_datetime"), _tss("ingested_at"))


@register("raw_purchase_items", _sql(["msg_items"], _RAW_SQL["raw_purchase_items"]))
def q_raw_purchase_items(spark, d):
    return raw_table(spark, d, "purchase_items").select(
        "purchase_id", "customer_id", "store_id", "product_id", "category", "quantity", "price_per_unit",
        "total_price", _tss("purchase_dt"), _tss("ingested_at"))


# ----- MART layer (validation over the message path) ---------------------------------

_MART_OUT = {
    "stores": (["store_id", "store_network", "store_name", "city"], []),
    "products": (["product_id", '"group"', "name", "price", "unit"], []),
    "customers": (["customer_id", "store_id", "email_enc", "phone_enc", "birth_date"], ["registration_dt"]),
    "purchases": (["purchase_id", "customer_id", "store_id", "total_amount", "payment_method", "is_delivery"],
                  ["purchase_dt"]),
    "purchase_items": (["purchase_id", "customer_id", "store_id", "product_id", "category", "quantity",
                        "price_per_unit", "total_price"], ["purchase_dt"]),
}
_NORM_NAME = {"stores": "stores", "products": "products", "customers": "customers", "purchases": "purchases",
              "purchase_items": "items"}


def _mart_sql(entity: str, final: bool) -> str:
    plain, times = _MART_OUT[entity]
    cols = ", ".join(plain + [_tsq(t) for t in times] + [_tsq("ingested_at")])
    src = f"mart_{_NORM_NAME[entity]}_m" if final else f"norm_{_NORM_NAME[entity]}_m"
    where = "" if final else " WHERE is_valid"
    return _sql([src], f"SELECT {cols} FROM {src}{where}")


def _typed_fields(spark, d, entity: str, purchases: DataFrame | None = None) -> DataFrame:
    """The fields without the message text, for tables that do not show it: the MART rows pass through a generator,
    beneath which the optimizer drops no column."""
    return payload_fields(spark, d, entity, purchases).drop("payload")


def _mart_spark(spark, d, entity: str, final: bool) -> DataFrame:
    m = mart.mart(entity, _typed_fields(spark, d, entity), AS_OF, ids=C.DRIVER_IDS)
    if final:
        m = latest.latest_mart(entity, m)
    plain, times = _MART_OUT[entity]
    return m.select(*[c.strip('"') for c in plain], *[_tss(t) for t in times], _tss("ingested_at"))


def _reg_mart(entity: str) -> None:
    register(f"mart_{entity}", _mart_sql(entity, False))(lambda spark, d: _mart_spark(spark, d, entity, False))


for _e in _MART_OUT:
    _reg_mart(_e)


@register("latest_by_key", _mart_sql("purchases", True))
def q_latest_by_key(spark, d):
    """Newest valid version per purchase over the re-sent message stream."""
    return _mart_spark(spark, d, "purchases", True)


@register("latest_by_key_customers", _mart_sql("customers", True))
def q_latest_by_key_customers(spark, d):
    return _mart_spark(spark, d, "customers", True)


@register("latest_by_key_items", _mart_sql("purchase_items", True))
def q_latest_by_key_items(spark, d):
    """Lines keyed by (purchase, product): two lines of one product in one
    purchase collapse to the newest/greatest one."""
    return _mart_spark(spark, d, "purchase_items", True)


@register("latest_by_key_raw_items", _sql(["msg_items"], f"""
SELECT purchase_id, product_id, {_tsq('ingested_at')}, customer_id, store_id, category, quantity, price_per_unit,
       total_price, {_tsq('purchase_dt')}
FROM msg_items
QUALIFY row_number() OVER (PARTITION BY purchase_id, product_id, ingested_at
                           ORDER BY customer_id DESC, store_id DESC, category DESC, quantity DESC,
                                    price_per_unit DESC, total_price DESC, purchase_dt DESC NULLS LAST) = 1"""))
def q_latest_by_key_raw_items(spark, d):
    """RAW line table keyed by (purchase, product, ingested_at): only exact
    re-inserts collapse."""
    r = raw_table(spark, d, "purchase_items").drop("payload")
    out = latest.latest_by_key(r, ["purchase_id", "product_id", "ingested_at"], version="purchase_dt",
                               tiebreak=["customer_id", "store_id", "category", "quantity", "price_per_unit",
                                         "total_price"])
    return out.select("purchase_id", "product_id", _tss("ingested_at"), "customer_id", "store_id", "category",
                      "quantity", "price_per_unit", "total_price", _tss("purchase_dt"))


# ----- quality ---------------------------------------------------------------------

_Q_ENTITIES = ["stores", "products", "customers", "purchases", "purchase_items"]


def _quality_sql(entity: str) -> str:
    e = _NORM_NAME[entity]
    key = O.QUALITY_KEYS[e]
    return f"""
SELECT strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%d %H:%M:%S') AS event_time, '{entity}' AS entity,
       CAST(count(*) AS BIGINT) AS total_rows_raw,
       CAST(count_if(coalesce(is_valid, false)) AS BIGINT) AS inserted_rows_mart,
       CAST(count(*) - count_if(coalesce(is_valid, false)) AS BIGINT) AS invalid_rows,
       CAST(count(*) - count(DISTINCT {key}) AS BIGINT) AS duplicates_rows,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count(DISTINCT {key})) / count(*) END AS duplicates_ratio
FROM norm_{e}_m"""


def _quality_spark(spark, d, entity: str) -> DataFrame:
    q = quality.quality(entity, payload_fields(spark, d, entity), AS_OF, ids=C.DRIVER_IDS)
    return q.withColumn("event_time", ts_text("event_time"))


def _reg_quality(entity: str) -> None:
    register(f"quality_{entity}", _sql([f"norm_{_NORM_NAME[entity]}_m"], _quality_sql(entity)))(
        lambda spark, d: _quality_spark(spark, d, entity))


for _e in _Q_ENTITIES:
    _reg_quality(_e)


def _fields(spark, d) -> dict[str, DataFrame]:
    """The fields of all entities; purchases and their lines read the same written fields."""
    read = written_fields(spark, d)
    return {e: payload_fields(spark, d, e, read) for e in _Q_ENTITIES}


def _snapshot(spark, d) -> DataFrame:
    return quality.snapshot(_fields(spark, d), AS_OF, ids=C.DRIVER_IDS)


@register("quality_snapshot", _sql([f"norm_{_NORM_NAME[e]}_m" for e in _Q_ENTITIES],
                                   "\nUNION ALL\n".join(f"SELECT * FROM ({_quality_sql(e)})" for e in _Q_ENTITIES)))
def q_quality_snapshot(spark, d):
    return _snapshot(spark, d).withColumn("event_time", ts_text("event_time"))


def quality_log(spark, d) -> DataFrame:
    """The daily quality log replayed over the whole message history."""
    return quality.history_all(_fields(spark, d), C.DRIVER_IDS)


def _log_sql(body: str) -> str:
    return _sql(["qlog"], body)


_LOG_COLS = ("entity, total_rows_raw, inserted_rows_mart, invalid_rows, duplicates_rows, duplicates_ratio, "
             "strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time")


@register("quality_history", _log_sql(f"SELECT {_LOG_COLS} FROM qlog"))
def q_quality_history(spark, d):
    return quality_log(spark, d).withColumn("event_time", ts_text("event_time"))


@register("quality_latest_purchases", _log_sql(
    f"SELECT {_LOG_COLS} FROM qlog WHERE entity = 'purchases' ORDER BY event_time DESC LIMIT 1"))
def q_quality_latest_purchases(spark, d):
    return quality.latest_for(quality_log(spark, d), "purchases").withColumn("event_time", ts_text("event_time"))


@register("quality_status", _log_sql(f"""
SELECT round(coalesce(max(duplicates_ratio), 0.0), 6) AS duplicates_ratio, {C.DUPLICATES_BAD_THRESHOLD} AS target_ratio,
       CASE WHEN coalesce(max(duplicates_ratio), 0.0) > {C.DUPLICATES_BAD_THRESHOLD} THEN 'bad' ELSE 'good' END AS status,
       strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS event_time
FROM (SELECT * FROM qlog WHERE entity = 'purchases' ORDER BY event_time DESC LIMIT 1)"""))
def q_quality_status(spark, d):
    return quality.status(quality_log(spark, d), "purchases").withColumn("event_time", ts_text("event_time"))


@register("quality_trend", _log_sql("""
SELECT CAST(row_number() OVER (ORDER BY event_time) AS INTEGER) AS run, round(duplicates_ratio, 6) AS ratio
FROM (SELECT * FROM qlog WHERE entity = 'purchases' ORDER BY event_time DESC LIMIT 10)"""))
def q_quality_trend(spark, d):
    return quality.trend(quality_log(spark, d), "purchases", runs=10)


_RANK = " ".join(f"WHEN '{e}' THEN {i + 1}" for i, e in enumerate(C.QUALITY_ENTITY_ORDER))


@register("quality_latest_by_entity", _log_sql(f"""
SELECT upper(substr(entity, 1, 1)) || lower(substr(entity, 2)) AS entity, total_rows_raw AS total_raw,
       inserted_rows_mart AS valid_mart, duplicates_rows AS duplicates, invalid_rows AS invalid,
       round(duplicates_ratio, 6) AS ratio
FROM (SELECT * FROM qlog
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY event_time DESC) = 1)
WHERE entity IN ({', '.join(repr(e) for e in C.QUALITY_ENTITY_ORDER)})
ORDER BY CASE entity {_RANK} END"""))
def q_quality_latest_by_entity(spark, d):
    return quality.latest_by_entity(quality_log(spark, d))


@register("quality_last_any", _log_sql("""
SELECT entity, duplicates_rows, inserted_rows_mart, invalid_rows, round(duplicates_ratio, 6) AS duplicates_ratio
FROM qlog ORDER BY event_time DESC, entity LIMIT 1"""))
def q_quality_last_any(spark, d):
    return quality.last_any(quality_log(spark, d))


# ----- alerts ----------------------------------------------------------------------

ALERT_THRESHOLD = 0.05  # the driver data re-sends 10 % of keys: ratios sit near 0.09


def _replay_sql(thr: float, cooldown_min: int) -> str:
    fire = (f"s.duplicates_ratio > {thr} AND (r.last_fired IS NULL OR "
            f"s.event_time - r.last_fired > INTERVAL {cooldown_min} MINUTE)")
    body = f"""
, s AS (SELECT entity, event_time, duplicates_ratio,
               row_number() OVER (PARTITION BY entity ORDER BY event_time) AS rn FROM qlog),
r AS (
  SELECT entity, rn, event_time, duplicates_ratio,
         CASE WHEN duplicates_ratio > {thr} THEN 1 ELSE 0 END AS fired,
         CASE WHEN duplicates_ratio > {thr} THEN event_time END AS last_fired
  FROM s WHERE rn = 1
  UNION ALL
  SELECT s.entity, s.rn, s.event_time, s.duplicates_ratio,
         CASE WHEN {fire} THEN 1 ELSE 0 END,
         CASE WHEN {fire} THEN s.event_time ELSE r.last_fired END
  FROM r JOIN s ON s.entity = r.entity AND s.rn = r.rn + 1)"""
    w = _sql(["qlog"], "").rstrip()
    return "WITH RECURSIVE" + w[len("WITH"):] + body


def _written_log(spark, d) -> DataFrame:
    """The quality log of all entities, written once: its readers do not rebuild it."""
    log = quality_log(spark, d)
    path = scratch_path(spark, "quality-log")
    log.write.parquet(path)
    return spark.read.schema(log.schema).parquet(path)


@register("alert_replay", _replay_sql(ALERT_THRESHOLD, C.ALERT_COOLDOWN_MINUTES) + """
SELECT entity, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, duplicates_ratio, CAST(fired AS INTEGER) AS fired
FROM r""")
def q_alert_replay(spark, d):
    r = alerts.replay(_written_log(spark, d), ALERT_THRESHOLD, C.ALERT_COOLDOWN_MINUTES)
    return r.withColumn("event_time", ts_text("event_time"))


@register("alert_duplicates_ratio", _replay_sql(ALERT_THRESHOLD, C.ALERT_COOLDOWN_MINUTES) + f"""
, ev AS (SELECT entity, event_time AS created_at FROM r WHERE fired = 1),
clock AS (SELECT max(event_time) + INTERVAL 10 MINUTE AS now FROM qlog),
latest AS (SELECT entity, duplicates_ratio FROM qlog QUALIFY row_number() OVER (PARTITION BY entity ORDER BY event_time DESC) = 1)
SELECT '{C.ALERT_RULE_NAME}' AS rule_name, l.entity, 'critical' AS severity, l.duplicates_ratio AS observed_value,
       {ALERT_THRESHOLD} AS threshold_value, 'failed' AS status
FROM latest l
WHERE l.duplicates_ratio > {ALERT_THRESHOLD}
  AND l.entity NOT IN (SELECT entity FROM ev, clock
                       WHERE created_at >= clock.now - INTERVAL {C.ALERT_COOLDOWN_MINUTES} MINUTE)""")
def q_alert_duplicates_ratio(spark, d):
    """The online rule run ten minutes after the last snapshot, with the
    replayed events as the event log: entities alerted inside the cooldown
    stay silent."""
    log = _written_log(spark, d)
    events = alerts.replay(log, ALERT_THRESHOLD).where("fired = 1").select(
        F.lit(C.ALERT_RULE_NAME).alias("rule_name"), "entity", F.col("event_time").alias("created_at"))
    latest_rows = log.groupBy("entity").agg(
        F.max_by("duplicates_ratio", "event_time").alias("duplicates_ratio"),
        F.max("event_time").alias("_last"),
    )
    # the clock: ten minutes after the newest snapshot of any entity (a window
    # over one row per entity)
    now = F.timestamp_seconds(F.unix_seconds(F.max("_last").over(Window.partitionBy())) + 600)
    out = alerts.dispatch(latest_rows, events, now, ALERT_THRESHOLD)
    return out.select("rule_name", "entity", "severity", "observed_value", "threshold_value", "status")


# ----- counts and KPIs ---------------------------------------------------------------

def _union_sql(parts: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS t, CAST({expr} AS BIGINT) AS c FROM {src}" for n, (expr, src) in parts)


_RAW_COUNT = [("stores_raw", ("count(*)", "msg_stores")), ("products_raw", ("count(*)", "msg_products")),
              ("customers_raw", ("count(*)", "msg_customers")), ("purchases_raw", ("count(*)", "msg_purchases")),
              ("purchase_items_raw", ("count(*)", "msg_items"))]


@register("raw_row_counts", _sql([s for _, (_, s) in _RAW_COUNT], _union_sql(_RAW_COUNT)))
def q_raw_row_counts(spark, d):
    sent = written_purchases(spark, d)
    return metrics.row_counts({
        "stores_raw": messages(spark, d, "stores"),
        "products_raw": messages(spark, d, "products"),
        "customers_raw": messages(spark, d, "customers"),
        "purchases_raw": sent,
        "purchase_items_raw": raw_table(spark, d, "purchase_items", sent),
    })


_FINAL_COUNT = [("customers_mart_final", ("count(*)", "mart_customers_m")),
                ("purchases_mart_final", ("count(*)", "mart_purchases_m")),
                ("purchase_items_mart_final", ("count(*)", "mart_items_m"))]


def _final(spark, d, entity, purchases=None):
    return latest.latest_mart(entity, mart.mart(entity, _typed_fields(spark, d, entity, purchases), AS_OF, ids=C.DRIVER_IDS))


@register("mart_final_counts", _sql([s for _, (_, s) in _FINAL_COUNT], _union_sql(_FINAL_COUNT)))
def q_mart_final_counts(spark, d):
    sent = written_purchases(spark, d)
    return metrics.row_counts({f"{e}_mart_final": _final(spark, d, e, sent) for e in ("customers", "purchases", "purchase_items")})


_UNIQ = [("stores", ("count(DISTINCT store_id)", "msg_stores")),
         ("products", ("count(DISTINCT product_id)", "msg_products")),
         ("purchases", ("count(DISTINCT purchase_id)", "msg_purchases")),
         ("customers", ("count(DISTINCT customer_id)", "msg_customers"))]


@register("raw_unique_counts", _sql([s for _, (_, s) in _UNIQ], _union_sql(_UNIQ)))
def q_raw_unique_counts(spark, d):
    return metrics.unique_counts({
        "stores": (raw_table(spark, d, "stores"), "store_id"),
        "products": (raw_table(spark, d, "products"), "product_id"),
        "purchases": (raw_table(spark, d, "purchases"), "purchase_id"),
        "customers": (raw_table(spark, d, "customers"), "customer_id"),
    })


@register("stores_by_network", _sql(["msg_stores"], """
SELECT store_network, CAST(count(*) AS BIGINT) AS stores_count FROM msg_stores GROUP BY store_network"""))
def q_stores_by_network(spark, d):
    return metrics.stores_by_network(raw_table(spark, d, "stores"))


@register("kpi_overview", _sql(["mart_stores_m", "mart_purchases_m", "mart_customers_m", "mart_products_m"], """
SELECT (SELECT CAST(count(DISTINCT store_id) AS BIGINT) FROM mart_stores_m) AS stores_uniq,
       (SELECT CAST(count(DISTINCT purchase_id) AS BIGINT) FROM mart_purchases_m) AS purchases_uniq,
       (SELECT CAST(count(*) AS BIGINT) FROM mart_customers_m) AS customers_mart,
       (SELECT CAST(count(DISTINCT product_id) AS BIGINT) FROM mart_products_m) AS items_mart"""))
def q_kpi_overview(spark, d):
    return metrics.kpi_overview(_final(spark, d, "stores"), _final(spark, d, "purchases"),
                                _final(spark, d, "customers"), _final(spark, d, "products"))


INGEST_AS_OF = "2001-08-03 00:00:00"  # just after the last purchase message


@register("ingestion_series", _sql(["msg_purchases"], f"""
SELECT CAST(ingested_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS rows
FROM msg_purchases WHERE ingested_at >= TIMESTAMP '{INGEST_AS_OF}' - INTERVAL 30 DAY
GROUP BY 1"""))
def q_ingestion_series(spark, d):
    return metrics.ingestion_series(raw_table(spark, d, "purchases"), INGEST_AS_OF, days=30)


# ----- PII ---------------------------------------------------------------------------

SALT = C.DEMO_PII_SALT


def _contacts_sql(body: str) -> str:
    return f"WITH contacts AS ({O.CONTACTS}\n)\n{body}"


@register("pii_normalize_email", _contacts_sql(
    f"SELECT customer_id, lower({O.strip_sql('email')}) AS email_norm FROM contacts"))
def q_pii_normalize_email(spark, d):
    c = lens.customer_contacts(spark, d)
    return c.select("customer_id", pii_fn.normalize_email("email").alias("email_norm"))


_PV, _POK = O.phone_norm_sql("phone")


@register("pii_normalize_phone", _contacts_sql(
    f"SELECT customer_id, {_PV} AS phone_norm, CAST({_POK} AS INTEGER) AS ok FROM contacts"))
def q_pii_normalize_phone(spark, d):
    c = lens.customer_contacts(spark, d)
    p = pii_fn.normalize_phone("phone")
    return c.select("customer_id", p.getField("value").alias("phone_norm"), p.getField("ok").cast("int").alias("ok"))


@register("pii_normalize_phone_digits", _contacts_sql("""
SELECT customer_id, CASE WHEN length(d11) > 0 THEN '+' || d11 ELSE d11 END AS phone_digits FROM (
  SELECT customer_id, CASE WHEN length(d10) = 11 AND starts_with(d10, '8') THEN '7' || substr(d10, 2) ELSE d10 END AS d11
  FROM (SELECT customer_id, CASE WHEN length(dg) = 10 THEN '7' || dg ELSE dg END AS d10
        FROM (SELECT customer_id, regexp_replace(phone, '\\D', '', 'g') AS dg FROM contacts)))"""))
def q_pii_normalize_phone_digits(spark, d):
    c = lens.customer_contacts(spark, d)
    return c.select("customer_id", pii_fn.normalize_phone_digits("phone").alias("phone_digits"))


_HASH_SQL = (f"SELECT customer_id, {O.hash_sql('lower(' + O.strip_sql('email') + ')', SALT)} AS email_hash, "
             f"{O.hash_sql(_PV, SALT)} AS phone_hash FROM contacts")


@register("pii_hash", _contacts_sql(_HASH_SQL))
def q_pii_hash(spark, d):
    c = lens.customer_contacts(spark, d)
    return c.select(
        "customer_id",
        pii_fn.hash_value(pii_fn.normalize_email("email"), SALT).alias("email_hash"),
        pii_fn.hash_value(pii_fn.normalize_phone("phone").getField("value"), SALT).alias("phone_hash"),
    )


@register("pii_hash_document", _contacts_sql(
    f"SELECT customer_id, email_hash AS email, phone_hash AS phone, store_id FROM ("
    f"SELECT *, printf('store-%03d', c.c_nationkey) AS store_id FROM ({_HASH_SQL}) h "
    f"JOIN customer c ON h.customer_id = printf('cus-%06d', c.c_custkey))"))
def q_pii_hash_document(spark, d):
    """Schema-driven hashing of whole contact documents (nested fields kept)."""
    docs = pii.hash_document(lens.customer_contact_documents(spark, d), "doc", SALT)
    return docs.select("customer_id", F.col("doc.email").alias("email"), F.col("doc.phone").alias("phone"),
                       F.col("doc.purchase_location.store_id").alias("store_id"))


@register("pii_unnormalized_report", _contacts_sql(
    f"SELECT 'customers' AS entity, CAST(count(*) AS BIGINT) AS unnormalized FROM contacts "
    f"WHERE phone IS NOT NULL AND NOT {_POK}"))
def q_pii_unnormalized_report(spark, d):
    c = lens.customer_contacts(spark, d)
    return pii.phone_report_counts(pii.phone_report(c, "customers", "customer_id", "phone"))


# ----- managed imports --------------------------------------------------------------

_CUS_BATCH = "driver-customers"
_PRD_BATCH = "driver-products"


def _validated_customers(spark, d):
    return imports.validate(lens.customer_import_rows(spark, d), "customers")


def _validated_products(spark, d):
    return imports.validate(lens.product_import_rows(spark, d), "products")


_CUS_SQL = """
  SELECT c_custkey + 2 AS row_number,
         CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'required_field_missing' ELSE '' END AS error_codes,
         CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL ELSE printf('cus-%06d', c_custkey) END
           AS business_key
  FROM customer"""
_PRD_SQL = """
  SELECT p_partkey + 2 AS row_number,
         CASE WHEN p_partkey % 7 = 0 THEN 'required_field_missing' ELSE '' END AS error_codes,
         CASE WHEN p_partkey % 7 = 0 THEN NULL
              WHEN p_partkey % 3 = 0 THEN (CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR)
                                                ELSE 'p-' || CAST(p_partkey AS VARCHAR) END)
              ELSE printf('prd-%04d', p_partkey) END AS business_key
  FROM part"""


def _codes(v: DataFrame) -> DataFrame:
    return v.select("row_number", F.array_join(F.transform("errors", lambda e: e["error_code"]), ",")
                    .alias("error_codes"), "business_key")


@register("import_validate", f"WITH v AS ({_CUS_SQL}) SELECT * FROM v")
def q_import_validate(spark, d):
    return _codes(_validated_customers(spark, d))


@register("import_validate_products", f"WITH v AS ({_PRD_SQL}) SELECT * FROM v")
def q_import_validate_products(spark, d):
    """Either ``product_id`` or ``id`` satisfies the products contract."""
    return _codes(_validated_products(spark, d))


@register("import_row_errors", f"""WITH v AS ({_CUS_SQL})
SELECT '{_CUS_BATCH}' AS batch_id, row_number, 'customer_id' AS field_name, 'required_field_missing' AS error_code,
       'customer_id is required' AS message
FROM v WHERE error_codes <> ''""")
def q_import_row_errors(spark, d):
    e = imports.row_errors(_validated_customers(spark, d), _CUS_BATCH)
    return e.drop("raw_fragment")


@register("import_staging", f"""WITH v AS ({_CUS_SQL})
SELECT '{_CUS_BATCH}' AS batch_id, 'customers' AS entity_type, row_number, business_key FROM v WHERE error_codes = ''""")
def q_import_staging(spark, d):
    return imports.staging(_validated_customers(spark, d), _CUS_BATCH, "customers").drop("payload")


def _summary_sql(src: str, batch: str, entity: str) -> str:
    return f"""WITH v AS ({src}), a AS (SELECT count(*) AS t, count_if(error_codes = '') AS ok FROM v)
SELECT '{batch}' AS batch_id, '{entity}' AS entity_type, '' AS file_name, '' AS file_format,
       CASE WHEN t = 0 OR ok = 0 THEN 'failed' WHEN t - ok > 0 THEN 'partial' ELSE 'success' END AS status,
       CAST(t AS BIGINT) AS total_rows, CAST(ok AS BIGINT) AS valid_rows, CAST(t - ok AS BIGINT) AS invalid_rows,
       CAST(ok AS BIGINT) AS staged_rows,
       CASE WHEN t = 0 THEN 'the file has no data rows'
            WHEN ok = 0 THEN 'no row passed validation' END AS error_message
FROM a"""


@register("import_summary", _summary_sql(_CUS_SQL, _CUS_BATCH, "customers"))
def q_import_summary(spark, d):
    return imports.summary(_validated_customers(spark, d), _CUS_BATCH, "customers")


@register("import_summary_products", _summary_sql(_PRD_SQL, _PRD_BATCH, "products"))
def q_import_summary_products(spark, d):
    return imports.summary(_validated_products(spark, d), _PRD_BATCH, "products")


@register("import_errors_page", f"""WITH v AS ({_CUS_SQL})
SELECT '{_CUS_BATCH}' AS batch_id, row_number, 'customer_id' AS field_name, 'required_field_missing' AS error_code,
       'customer_id is required' AS message
FROM v WHERE error_codes <> '' ORDER BY row_number LIMIT 50""")
def q_import_errors_page(spark, d):
    e = imports.row_errors(_validated_customers(spark, d), _CUS_BATCH).drop("raw_fragment")
    return imports.page(e, 50, 1000)


@register("import_staging_page", f"""WITH v AS ({_CUS_SQL})
SELECT '{_CUS_BATCH}' AS batch_id, 'customers' AS entity_type, row_number, business_key FROM v
WHERE error_codes = '' ORDER BY row_number LIMIT 100""")
def q_import_staging_page(spark, d):
    s = imports.staging(_validated_customers(spark, d), _CUS_BATCH, "customers").drop("payload")
    return imports.page(s, 100, 500)


# ----- exports -----------------------------------------------------------------------

import datetime as _dt  # noqa: E402

from ..session import scratch_path  # noqa: E402
from ..sources import exports  # noqa: E402

RUN_DATE = _dt.date.fromisoformat(AS_OF[:10])


@register("sink_features_csv", O.with_features("SELECT * FROM f_matrix", PROFILE))
def q_sink_features_csv(spark, d):
    """Matrix written as the dated CSV export (parallel parts), read back."""
    path = exports.write_csv(matrix(spark, d), scratch_path(spark, "exports"), RUN_DATE, prefix="features")
    return exports.read_export(spark, path)


@register("sink_features_parquet", O.with_features("SELECT * FROM f_matrix", PROFILE))
def q_sink_features_parquet(spark, d):
    path = exports.write_parquet(matrix(spark, d), scratch_path(spark, "exports"), RUN_DATE)
    return spark.read.parquet(path)


@register("feat_parse_export", O.with_features("SELECT * FROM f_matrix", PROFILE))
def q_feat_parse_export(spark, d):
    """The one-file CSV layout, read back with flag coercion."""
    path = exports.write_csv(matrix(spark, d), scratch_path(spark, "exports"), RUN_DATE, single_file=True)
    return exports.read_export(spark, path)


@register("check_features_export", O.with_features(f"""
SELECT {len(C.FEATURE_COLUMNS) + 1} AS columns, true AS columns_ok, CAST(count(*) AS BIGINT) AS rows,
       CAST(0 AS BIGINT) AS blank_ids, CAST(0 AS BIGINT) AS bad_values, true AS ok FROM f_matrix""", PROFILE))
def q_check_features_export(spark, d):
    path = exports.write_csv(matrix(spark, d), scratch_path(spark, "exports"), RUN_DATE)
    return exports.check_export(exports.read_export(spark, path))


_EXPORT_DAYS = 3


def _export_history(spark, d) -> str:
    """A daily export of the customers who bought on it, for each of the last purchase days, plus a mis-named
    folder, as a listing would find them."""
    base = scratch_path(spark, "exports")
    bought = lens.read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    days = [r["day"] for r in bought.select("day").distinct().orderBy(F.desc("day")).limit(_EXPORT_DAYS).collect()]
    for day in days:
        exports.write_csv(bought.where(F.col("day") == F.lit(day)).select(F.concat(F.lit("cus-"), F.col("o_custkey")).alias("customer_id")).distinct(), base, day)
    bought.limit(1).select("o_custkey").write.option("header", "true").csv(f"{base}/analytic_result_1995_02_30.csv")
    return base


_EXPORTS_SQL = f"""
SELECT strftime(day, 'analytic_result_%Y_%m_%d.csv') AS filename, day AS file_date
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY day DESC LIMIT {_EXPORT_DAYS})"""


@register("src_latest_export", f"SELECT * FROM ({_EXPORTS_SQL}) ORDER BY file_date DESC LIMIT 1")
def q_src_latest_export(spark, d):
    """Newest valid export name; the impossible date 1995-02-30 is skipped."""
    return exports.latest_export(exports.list_exports(spark, _export_history(spark, d))).select("filename", "file_date")


@register("export_listing", f"SELECT * FROM ({_EXPORTS_SQL}) WHERE contains(filename, '0') ORDER BY file_date DESC")
def q_export_listing(spark, d):
    """Exports whose name or date contains a text, newest first."""
    return exports.export_listing(exports.list_exports(spark, _export_history(spark, d)), "0", limit=50).select("filename", "file_date")


# ----- streaming ---------------------------------------------------------------------

from ..streaming import ingest  # noqa: E402


def _stamped_topic(spark, d, entity: str) -> str:
    """Publish the entity's messages (with their arrival times) as a topic
    folder of JSON lines, compressed (a message repeats all its field names)."""
    path = scratch_path(spark, f"topic-{entity}")
    messages(spark, d, entity).write.mode("overwrite").option("compression", "lz4").json(path)
    return path


_RAW_OUT = {
    "stores": (["store_id", "store_network"], ["ingested_at"]),
    "products": (["product_id", "group"], ["ingested_at"]),
    "customers": (["customer_id", "store_id", "email_enc", "phone_enc"], ["ingested_at"]),
    "purchases": (["purchase_id", "customer_id", "store_id", "total_amount"], ["purchase_datetime", "ingested_at"]),
    "purchase_items": (["purchase_id", "customer_id", "store_id", "product_id", "category", "quantity", "price_per_unit",
                        "total_price"], ["purchase_dt", "ingested_at"]),
}


def _streamed(stream: DataFrame, name: str) -> str:
    """Drains a stream into a fresh table (checkpointed, one availableNow run)."""
    out = scratch_path(stream.sparkSession, name)
    ingest.run_available(ingest.write_parquet(stream, out, scratch_path(stream.sparkSession, f"ck-{name}")))
    return out


def _raw_stream(spark, d, entity: str) -> str:
    """Topic → RAW table; the lines of purchases come from the RAW purchases table, itself a stream."""
    if entity == "purchase_items":
        purchases = ingest.read_table(spark, _raw_stream(spark, d, "purchases"))
        return _streamed(ingest.to_raw(purchases.select("payload", "ingested_at"), entity), "raw-purchase_items")
    return _streamed(ingest.to_raw(ingest.read_stamped(spark, _stamped_topic(spark, d, entity)), entity), f"raw-{entity}")


def _reg_streams(entity: str, suffix: str) -> None:
    def raw_query(spark, d):
        plain, times = _RAW_OUT[entity]
        return spark.read.parquet(_raw_stream(spark, d, entity)).select(*plain, *[_tss(t) for t in times])

    def mart_query(spark, d):
        m = ingest.to_mart(ingest.read_table(spark, _raw_stream(spark, d, entity)), entity, ids=C.DRIVER_IDS)
        plain, times = _MART_OUT[entity]
        return spark.read.parquet(_streamed(m, f"mart-{entity}")).select(*[c.strip('"') for c in plain], *[_tss(t) for t in times], _tss("ingested_at"))

    raw_query.__doc__ = f"Continuous consume of the {entity} topic into RAW, read back."
    mart_query.__doc__ = f"RAW {entity} as a stream into the MART, validity judged at each row's arrival."
    msg, norm = ("msg_items", "norm_items_h") if entity == "purchase_items" else (f"msg_{entity}", f"norm_{entity}_h")
    plain, times = _MART_OUT[entity]
    register(f"stream_ingest_raw{suffix}", _sql([msg], _RAW_SQL[f"raw_{entity}"]))(raw_query)
    register(f"mart_from_raw_stream{suffix}", _sql([norm], f"SELECT {', '.join(plain + [_tsq(t) for t in times] + [_tsq('ingested_at')])} FROM {norm} WHERE is_valid"))(mart_query)


for _e in _RAW_OUT:
    _reg_streams(_e, "" if _e == "purchases" else f"_{_e}")


# ----- document sources and sinks ------------------------------------------------------

from ..sources import documents  # noqa: E402

_PRODUCT_DOC_SCHEMA = ("id string, name string, `group` string, price double, unit string, is_organic boolean")


@register("src_json_documents", O.with_ctes(["lens_products"], """
SELECT product_id AS id, name, "group", price, unit, is_organic FROM lens_products"""))
def q_src_json_documents(spark, d):
    """Product documents written as a JSON document folder and read back with
    a declared schema."""
    path = scratch_path(spark, "docs-products")
    lens.product_documents(spark, d).select("doc.*").write.mode("overwrite").json(path)
    schema = DataType.fromDDL(_PRODUCT_DOC_SCHEMA)
    return documents.read_documents(spark, path, schema, one_per_file=False)


def _upsert_inputs(spark, d):
    """Stored: the products whose key is no multiple of 3. Incoming, for all others and every even
    key: one document with a higher price, and a second one with a new field and no price."""
    p = lens.products(spark, d).select(F.col("product_id").alias("id"), "name", "group", "price", "unit")
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    existing = p.where(k % 3 != 0)
    sent = p.where((k % 3 == 0) | (k % 2 == 0))
    first = sent.select("id", "group", (F.col("price") + 1.0).alias("price"), F.lit(None).cast("string").alias("shelf"), F.lit(1).alias("at"))
    second = sent.select("id", F.lit(None).cast("string").alias("group"), F.lit(None).cast("double").alias("price"), F.concat(F.lit("shelf-"), k % 7).alias("shelf"), F.lit(2).alias("at"))
    return existing, first.unionByName(second)


def _upserted(spark, d):
    existing, incoming = _upsert_inputs(spark, d)
    merged, counts = documents.upsert(existing, incoming, "id", order="at")
    return merged.drop("at"), counts


_UPSERT_SQL = """
, e AS (SELECT product_id AS id, name, "group", price, unit FROM lens_products WHERE _k % 3 <> 0),
i AS (SELECT product_id AS id, "group", price + 1.0 AS price, 'shelf-' || (_k % 7) AS shelf FROM lens_products WHERE _k % 3 = 0 OR _k % 2 = 0)"""


@register("src_upsert_documents", O.with_ctes(["lens_products"], "").rstrip() + _UPSERT_SQL + """
SELECT coalesce(e.id, i.id) AS id, e.name AS name, coalesce(i."group", e."group") AS "group",
       coalesce(i.price, e.price) AS price, e.unit AS unit, i.shelf AS shelf
FROM e FULL OUTER JOIN i ON e.id = i.id""")
def q_src_upsert_documents(spark, d):
    """Field-level merge: documents keep what they don't carry, new fields and new ids are added."""
    return _upserted(spark, d)[0]


@register("src_upsert_counts", O.with_ctes(["lens_products"], "").rstrip() + _UPSERT_SQL + """
SELECT CAST(2 * count(i.id) AS BIGINT) AS processed,
       CAST(count_if(i.id IS NOT NULL AND e.id IS NULL) AS BIGINT) AS inserted,
       CAST(count_if(i.id IS NOT NULL AND e.id IS NOT NULL) AS BIGINT) AS updated
FROM e FULL OUTER JOIN i ON e.id = i.id""")
def q_src_upsert_counts(spark, d):
    return _upserted(spark, d)[1]


@register("src_replace_documents", O.with_ctes(["lens_stores"], """
SELECT store_id, store_name, store_network, city FROM lens_stores"""))
def q_src_replace_documents(spark, d):
    """Delete-all + insert: a second load replaces, never appends."""
    path = scratch_path(spark, "collection-stores")
    s = lens.stores(spark, d).drop("ingested_at")
    documents.replace_collection(s, path)
    documents.replace_collection(s, path)
    return spark.read.parquet(path)


@register("src_publish_stream", """
SELECT 'stores' AS topic, CAST(count(*) AS BIGINT) AS messages FROM supplier
UNION ALL SELECT 'products', CAST(count(*) AS BIGINT) FROM part
UNION ALL SELECT 'customers', CAST(count(*) AS BIGINT) FROM customer
UNION ALL SELECT 'purchases', CAST(count(*) AS BIGINT) FROM orders""")
def q_src_publish_stream(spark, d):
    """Every document → one JSON message on its entity's topic, written and read back; counts."""
    paths = documents.publish_topics({e: documents.publish(fn(spark, d)) for e, fn in lens.DOCUMENTS.items()}, scratch_path(spark, "topics"))
    return documents.publish_counts({e: spark.read.text(path) for e, path in paths.items()})


@register("src_published_messages", O.with_ctes(["lens_products"], """
SELECT product_id AS id, name, "group", price, unit, is_organic FROM lens_products"""))
def q_src_published_messages(spark, d):
    """The product topic's messages as a reader gets them."""
    paths = documents.publish_topics({"products": documents.publish(lens.product_documents(spark, d))}, scratch_path(spark, "topic"))
    return spark.read.text(paths["products"]).select(F.from_json("value", DataType.fromDDL(_PRODUCT_DOC_SCHEMA)).alias("doc")).select("doc.*")


@register("src_json_document_files", O.with_ctes(["lens_stores"], """
SELECT store_id, store_name, city, true AS has_file FROM lens_stores"""))
def q_src_json_document_files(spark, d):
    """Store documents, one pretty-printed object a file, read whole per file."""
    path = scratch_path(spark, "doc-files")
    docs = lens.store_documents(spark, d).select(F.to_json("doc", {"pretty": "true"}).alias("value"))
    # a folder a task: a thousand files each, moved as one when the job commits and listed in parallel
    folders = max(4, docs.count() // 1000)
    docs.repartition(folders).withColumn("folder", F.spark_partition_id()).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    schema = DataType.fromDDL("store_id string, store_name string, store_network string, location struct<city: string>")
    got = documents.read_documents(spark, path, schema, file_column="file")
    return got.select("store_id", "store_name", "location.city", F.col("file").contains("part-").alias("has_file"))


ENVELOPE_TS = "2024-01-01 00:00:00"


@register("src_publish_envelope", O.with_ctes(["lens_customers"], f"""
SELECT customer_id AS key, 'customers' AS source, customer_id AS object_id,
       '{ENVELOPE_TS.replace(' ', 'T')}.000000Z' AS event_ts FROM lens_customers"""))
def q_src_publish_envelope(spark, d):
    e = documents.envelope(lens.customer_documents(spark, d), "customers", ENVELOPE_TS)
    return e.select("key", "source", "object_id", "event_ts")


@register("src_envelope_roundtrip", O.with_ctes(["lens_customers"], """
SELECT customer_id, store_id, email AS email_enc, phone AS phone_enc FROM lens_customers"""))
def q_src_envelope_roundtrip(spark, d):
    """Enveloped messages unwrapped and extracted by the RAW layer."""
    e = documents.envelope(lens.customer_documents(spark, d), "customers", ENVELOPE_TS)
    msgs = documents.unwrap_envelope(e.select(F.to_json(F.struct("source", "object_id", "payload", "event_ts"))
                                              .alias("value")))
    return raw.raw_customers(msgs).select("customer_id", "store_id", "email_enc", "phone_enc")


@register("src_table_scan", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def q_src_table_scan(spark, d):
    """Named-table scan with projection and a filter pushed into the scan."""
    t = documents.table_scan(spark, "orders", d)
    return t.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


# ----- contract checks, generator ----------------------------------------------------

from ..operators import checks  # noqa: E402


@register("check_raw_counts", O.with_ctes(["msg_stores", "msg_products", "msg_purchases", "msg_customers"], """
SELECT 'raw_stores_uniq' AS "check", (SELECT count(*) FROM supplier) AS expected,
       (SELECT count(DISTINCT store_id) FROM msg_stores) AS actual
UNION ALL SELECT 'raw_products_uniq', (SELECT count(*) FROM part), (SELECT count(DISTINCT product_id) FROM msg_products)
UNION ALL SELECT 'raw_purchases_uniq', (SELECT count(*) FROM orders),
                 (SELECT count(DISTINCT purchase_id) FROM msg_purchases)
UNION ALL SELECT 'raw_customers_uniq', (SELECT count(*) FROM customer),
                 (SELECT count(DISTINCT customer_id) FROM msg_customers)""").replace(
    "SELECT 'raw_stores_uniq'", "SELECT *, actual = expected AS ok FROM (SELECT 'raw_stores_uniq'") + ")")
def q_check_raw_counts(spark, d):
    """Every source document reached RAW exactly once per id."""
    src = {n: lens.read(spark, d, t) for n, t in
           (("stores", "supplier"), ("products", "part"), ("purchases", "orders"), ("customers", "customer"))}
    return checks.compare({
        f"raw_{n}_uniq": (src[n], F.count(F.lit(1)), raw_table(spark, d, n), F.count_distinct(k))
        for n, k in (("stores", "store_id"), ("products", "product_id"), ("purchases", "purchase_id"),
                     ("customers", "customer_id"))
    })


@register("check_mart_counts", _sql(["mart_customers_m", "mart_purchases_m", "mart_items_m"], """
SELECT 'mart_customers_final' AS "check", '>= 45' AS expected, CAST(count(*) AS BIGINT) AS actual, count(*) >= 45 AS ok
FROM mart_customers_m
UNION ALL SELECT 'mart_purchases_final', '>= 200', CAST(count(*) AS BIGINT), count(*) >= 200 FROM mart_purchases_m
UNION ALL SELECT 'mart_items_gt_purchases', '> purchases', (SELECT CAST(count(*) AS BIGINT) FROM mart_items_m),
                 (SELECT count(*) FROM mart_items_m) > (SELECT count(*) FROM mart_purchases_m)"""))
def q_check_mart_counts(spark, d):
    sent = written_purchases(spark, d)
    return checks.mart_counts(*[_final(spark, d, e, sent) for e in ("customers", "purchases", "purchase_items")])


_SNAPSHOT_SQL = "\nUNION ALL\n".join(f"SELECT * FROM ({_quality_sql(e)})" for e in _Q_ENTITIES)


@register("check_quality_bounds", _sql([f"norm_{_NORM_NAME[e]}_m" for e in _Q_ENTITIES], f"""
, snap AS ({_SNAPSHOT_SQL}),
found AS (SELECT 'invalid_rows_non_negative' AS "check", CAST(count_if(invalid_rows < 0) AS BIGINT) AS actual FROM snap
          UNION ALL SELECT 'ratio_in_unit_interval', CAST(count_if(NOT duplicates_ratio BETWEEN 0 AND 1) AS BIGINT) FROM snap)
SELECT "check", '0 violations' AS expected, actual, actual = 0 AS ok FROM found"""))
def q_check_quality_bounds(spark, d):
    return checks.quality_bounds(_snapshot(spark, d))


@register("check_pii_hash", """
SELECT 'same_after_normalising' AS "check", '0 violations' AS expected, CAST(0 AS BIGINT) AS actual, true AS ok
UNION ALL SELECT 'different_values_differ', '0 collisions', CAST(0 AS BIGINT), true
UNION ALL SELECT 'hex64', '0 violations', CAST(0 AS BIGINT), true
UNION ALL SELECT 'blank_is_empty', '0 violations', CAST(0 AS BIGINT), true""")
def q_check_pii_hash(spark, d):
    return checks.pii_hash(lens.customer_contacts(spark, d), SALT)




_SEARCHED = ("0001", "13", "cus-00000", "7")  # four pages: a few trigrams, short texts, a prefix that many share


def _searched_sql() -> str:
    one = "SELECT '{0}' AS text, * FROM (SELECT * FROM f_matrix WHERE contains(customer_id, '{0}') ORDER BY customer_id LIMIT 25)"
    return " UNION ALL ".join(one.format(t) for t in _SEARCHED)


@register("feat_search_indexed", O.with_features(_searched_sql(), PROFILE))
def q_feat_search_indexed(spark, d):
    """First pages of searches through the gram index of the written matrix (a page is the feature)."""
    rows = exports.write_parquet(matrix(spark, d), scratch_path(spark, "searched"), RUN_DATE)
    rows = spark.read.parquet(rows)
    index = search.build(rows, "customer_id", scratch_path(spark, "grams"))
    pages = [search.page(spark, index, rows, "customer_id", t, 1, 25).select(F.lit(t).alias("text"), "*") for t in _SEARCHED]
    return functools.reduce(DataFrame.unionByName, pages)


# ----- run log, audit, compaction, registry, dq errors -----------------------------------

_RUNS_SQL = """
  SELECT event_id AS id, event_type AS job_name,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN 'running'
              WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(ts AS TIMESTAMP) AS started_at,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
              ELSE CAST(ts AS TIMESTAMP) + to_microseconds(CAST(value * 1000000 AS BIGINT)) END AS finished_at,
         CAST(ts AS TIMESTAMP) AS created_at
  FROM events"""


@register("job_run_duration", f"""WITH runs AS ({_RUNS_SQL})
SELECT id, job_name, status, epoch_ms(finished_at) - epoch_ms(started_at) AS duration_ms FROM runs""")
def q_job_run_duration(spark, d):
    r = metrics.job_run_duration(lens.job_runs(spark, d))
    return r.select("id", "job_name", "status", "duration_ms")


@register("job_run_recent", f"""WITH runs AS ({_RUNS_SQL})
SELECT id, job_name, status, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM runs ORDER BY created_at DESC, id DESC LIMIT 10""")
def q_job_run_recent(spark, d):
    """Newest 10 runs (a top-k report)."""
    r = metrics.job_run_recent(lens.job_runs(spark, d), 10)
    return r.select("id", "job_name", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
                    .alias("created_at"))


@register("export_audit", O.with_features(f"""
SELECT 'analytic_result_{RUN_DATE:%Y_%m_%d}.csv' AS filename, 'uploaded' AS status, count(*) * 70 > 1024 AS above_1024,
       CAST(NULL AS VARCHAR) AS error_message FROM f_matrix""", PROFILE))
def q_export_audit(spark, d):
    """The audit row of an export run: a row of the file takes 70 bytes and more."""
    path = exports.write_csv(matrix(spark, d), scratch_path(spark, "exports"), RUN_DATE)
    return exports.audit(spark, path).select(F.regexp_extract("key", "([^/]+)$", 1).alias("filename"), "status",
                                             (F.col("size_bytes") > 1024).alias("above_1024"), "error_message")


@register("compact_latest", _mart_sql("purchases", True))
def q_compact_latest(spark, d):
    """Background merge as a batch rewrite: newest version per key written to
    a fresh dataset (the old one is left for readers until the swap)."""
    m = mart.mart("purchases", payload_fields(spark, d, "purchases"), AS_OF, ids=C.DRIVER_IDS)
    path = latest.compact(m, ["purchase_id"], scratch_path(spark, "compact-purchases"))
    plain, times = _MART_OUT["purchases"]
    return spark.read.parquet(path).select(*plain, *[_tss(t) for t in times], _tss("ingested_at"))


def _registry_values() -> str:
    rows = features.registry(PROFILE)
    vals = ", ".join(
        f"('{r['feature']}', '{r['family']}', {r['lookback_days'] if r['lookback_days'] is not None else 'NULL'}, "
        f"'{r['rule']}', '{r['sources']}')" for r in rows)
    return f"(VALUES {vals}) AS reg(feature, family, lookback_days, rule, sources)"


@register("feat_registry", O.with_features(
    f"SELECT reg.feature, reg.family, CAST(reg.lookback_days AS INTEGER) AS lookback_days, reg.rule, reg.sources, "
    f"s.ones FROM {_registry_values()} JOIN (" + _UNPIVOT + ") s ON reg.feature = s.feature", PROFILE))
def q_feat_registry(spark, d):
    """Feature definitions (from the same config that builds them) with the
    number of customers currently flagged."""
    reg = spark.createDataFrame(features.registry(PROFILE),
                                "feature string, family string, lookback_days int, rule string, sources string")
    return reg.join(features.summary(matrix(spark, d)), "feature")


_DQ_REASONS = [
    ("purchase_id", f"NOT (purchase_id <> '' AND regexp_matches(purchase_id, '{C.DRIVER_IDS.purchase}'))"),
    ("customer_id", f"NOT (customer_id <> '' AND regexp_matches(customer_id, '{C.DRIVER_IDS.customer}'))"),
    ("store_id", f"NOT (store_id <> '' AND regexp_matches(store_id, '{C.DRIVER_IDS.store}'))"),
    ("total_amount", "NOT (total_amount >= 0)"),
    ("payment_method", "NOT (payment_method IN (" + ", ".join(f"'{m}'" for m in C.PAYMENT_METHODS) + "))"),
    ("purchase_dt", f"NOT coalesce(purchase_dt IS NOT NULL AND purchase_dt <= TIMESTAMP '{C.EARLY_AS_OF}', false)"),
]


@register("dq_errors", _sql(["norm_purchases_m"], "\nUNION ALL\n".join(
    f"SELECT purchase_id AS business_key, '{n}' AS reason, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at "
    f"FROM norm_purchases_m WHERE {cond}" for n, cond in _DQ_REASONS)))
def q_dq_errors(spark, d):
    """Purchase messages rejected at the early clock, one row per failed rule."""
    e = mart.dq_errors("purchases", payload_fields(spark, d, "purchases"), C.EARLY_AS_OF, "purchase_id", C.DRIVER_IDS)
    return e.select("business_key", "reason", _tss("ingested_at"))


# ----- import files ------------------------------------------------------------------

from ..sources import imports as import_src  # noqa: E402


def _customer_csv(spark, d, bad: int | None = 11) -> str:
    """The customer table exported as CSV files with a header, as an uploaded
    import would arrive; ids are blank on every ``bad``-th key."""
    path = scratch_path(spark, "upload-customers.csv")
    c = lens.read(spark, d, "customer")
    k = F.col("c_custkey")
    blank = k % bad == 0 if bad else F.lit(False)
    c.select(F.when(blank, F.lit("  ")).otherwise(lens.key_id("cus-", k, 6)).alias("customer_id"),
             "c_name", "c_mktsegment", "c_acctbal") \
        .write.mode("overwrite").option("header", "true").csv(path)
    return path


def _order_jsonl(spark, d) -> str:
    path = scratch_path(spark, "upload-purchases.jsonl")
    o = lens.read(spark, d, "orders")
    o.select(F.to_json(F.struct(lens.key_id("ord-", "o_orderkey", 6).alias("purchase_id"),
                                F.col("o_totalprice").alias("total_amount"))).alias("value")) \
        .write.mode("overwrite").text(path)
    return path


def _numbered(rows: DataFrame, key: str, first: int) -> DataFrame:
    """Each row's key, and whether its number is its place among its file's keys (the files are
    written in key order)."""
    k = F.try_variant_get("row", f"$.{key}", "string").cast("long")
    place = F.row_number().over(Window.partitionBy("_file").orderBy(k))
    return rows.select(k.alias("key"), (F.col("row_number") == place + (first - 1)).alias("in_place"))


@register("src_import_csv", "SELECT c_custkey AS key, true AS in_place FROM customer")
def q_src_import_csv(spark, d):
    """Uploaded CSV files: every row once, numbered from 2 in file order."""
    path = scratch_path(spark, "upload-keys.csv")
    lens.read(spark, d, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey") \
        .write.mode("overwrite").option("header", "true").csv(path)
    return _numbered(import_src.read_csv(spark, path), "c_custkey", 2)


@register("src_import_json", "SELECT o_orderkey AS key, true AS in_place FROM orders")
def q_src_import_json(spark, d):
    """Uploaded JSON Lines: every line once, numbered from 1 in file order."""
    path = scratch_path(spark, "upload-keys.jsonl")
    lens.read(spark, d, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey") \
        .write.mode("overwrite").json(path)
    return _numbered(import_src.read_json(spark, path), "o_orderkey", 1)


def _upload(df: DataFrame, path: str, line, first: str, between: str, last: str) -> str:
    """Writes each partition as one text file: ``first``, its lines with ``between`` after all but the last one, ``last``."""
    def framed(batches):
        lead, held = first, []
        for batch in batches:
            lines = [*held, *[x for x in batch.column(0).to_pylist() if x is not None]]
            lines, held = lines[:-1], lines[-1:]
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [lead + lines[0] + between, *[x + between for x in lines[1:]]]})
                lead = ""
        if held:
            yield pa.RecordBatch.from_pydict({"value": [lead + held[0] + last]})

    df.select(line.alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)
    return path


@register("src_import_json_array", """
SELECT o_orderkey AS key, true AS in_place, '[1, "' || chr(123) || '"] \\ ,' AS note FROM orders""")
def q_src_import_json_array(spark, d):
    """Uploaded JSON arrays (elements over several lines, commas and brackets in strings): every element once,
    numbered from 1 in file order."""
    o = lens.read(spark, d, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    note = F.lit('[1, "{"] \\ ,')
    line = F.to_json(F.struct("o_orderkey", "o_totalprice", note.alias("note"), F.array(F.struct(F.lit(1).alias("x"))).alias("list")), {"pretty": "true"})
    path = _upload(o, scratch_path(spark, "upload-array.json"), line, "[", ",", "]")
    rows = import_src.read_json(spark, path).withColumn("note", F.try_variant_get("row", "$.note", "string"))
    place = F.row_number().over(Window.partitionBy("_file").orderBy(F.try_variant_get("row", "$.o_orderkey", "long")))
    return rows.select(F.try_variant_get("row", "$.o_orderkey", "long").alias("key"), (F.col("row_number") == place).alias("in_place"), "note")


@register("src_import_csv_quoted", """
SELECT c_custkey AS key, c_name || chr(10) || 'says "so", twice' AS name,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN '["more","' || c_custkey || '"]' END AS rest
FROM customer""")
def q_src_import_csv_quoted(spark, d):
    """Uploaded CSV with line ends and quotes inside fields, short records and fields beyond the header."""
    c = lens.read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").repartitionByRange(4, "c_custkey")
    name = F.concat(F.lit('"'), "c_name", F.lit('\nsays ""so"", twice"'))
    more = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(",more,"), "c_custkey")).otherwise(F.lit(""))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), name, F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(","), "c_mktsegment", more)))
    path = _upload(c, scratch_path(spark, "upload-quoted.csv"), line, "key,name,segment\n", "", "")
    rows = import_src.read_csv(spark, path)
    text = lambda f: F.try_variant_get("row", f"$.{f}", "string").alias(f)
    rest = F.try_variant_get("row", f"$['{import_src.REST}']", "variant")
    return rows.select(text("key").cast("long").alias("key"), text("name"), text("segment"), F.when(rest.isNotNull(), F.to_json(rest)).alias("rest"))


@register("import_replay", f"""
SELECT 'driver-upload' AS batch_id,
       CASE WHEN count(*) = 0 OR count_if(c_custkey % 22 <> 0) = 0 THEN 'failed'
            WHEN count_if(c_custkey % 22 = 0) > 0 THEN 'partial' ELSE 'success' END AS status,
       CAST(count(*) AS BIGINT) AS total_rows, CAST(count_if(c_custkey % 22 <> 0) AS BIGINT) AS valid_rows,
       1 AS replay_count, CAST(nullif(count_if(c_custkey % 22 = 0), 0) AS BIGINT) AS error_rows,
       CAST(count_if(c_custkey % 22 <> 0) AS BIGINT) AS staging_rows
FROM customer
UNION ALL
SELECT 'repaired-upload', 'success', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT), 1, NULL, CAST(count(*) AS BIGINT)
FROM customer""")
def q_import_replay(spark, d):
    """Two uploads imported and, after a correction, replayed: of one, half of the bad rows are mended,
    of the other all. Only the replay's errors and staging are live."""
    out = scratch_path(spark, "imports")
    for batch, bad_after in (("driver-upload", 22), ("repaired-upload", None)):
        s, e, st = imports.run_batch(spark, _customer_csv(spark, d, 11), batch, "customers", "customers.csv")
        imports.write_batch(out, s, e, st)
        imports.replay_batch(spark, out, _customer_csv(spark, d, bad_after), batch, "customers", "customers.csv")
    count = lambda name, df: imports.live_rows(spark, out, name, df.schema).groupBy("batch_id").agg(F.count(F.lit(1)).alias(f"{name[:7].rstrip('s')}_rows"))
    errors, staged = count("errors", e), count("staging", st)
    b = spark.read.parquet(f"{out}/batches").select("batch_id", "status", "total_rows", "valid_rows", "replay_count")
    return b.join(errors, "batch_id", "left").join(staged, "batch_id", "left")


@register("import_stored_page", """
WITH e AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n, count(*) OVER () AS total FROM customer WHERE c_custkey % 11 = 0)
SELECT n - 3 AS place, total, 'customer_id' AS field_name FROM e WHERE n > 3 AND n <= 23""")
def q_import_stored_page(spark, d):
    """The fourth to twenty-third stored error of an upload, with the total of all, through the row index."""
    out = scratch_path(spark, "imports-page")
    s, e, st = imports.run_batch(spark, _customer_csv(spark, d, 11), "paged", "customers", "customers.csv")
    imports.write_batch(out, s, e, st)
    rows, total = imports.stored_page(spark, out, "errors", "paged", e.schema, 20, 1000, offset=3)
    place = F.row_number().over(Window.orderBy("row_number"))  # a page
    return rows.select(place.cast("long").alias("place"), F.lit(total).cast("long").alias("total"), "field_name")


@register("import_detect_format", """
SELECT DISTINCT 'csv' AS file_format, CAST(NULL AS VARCHAR) AS error_code FROM customer
UNION ALL SELECT DISTINCT 'json', NULL FROM orders
UNION ALL SELECT DISTINCT NULL, 'import_unsupported_file' FROM part""")
def q_import_detect_format(spark, d):
    """Formats met in an upload folder: customers as CSV, orders as JSON Lines, and part files with an
    extension that is not accepted."""
    folder = scratch_path(spark, "uploads")
    lens.read(spark, d, "customer").write.mode("overwrite").option("header", "true").csv(f"{folder}/customers")
    lens.read(spark, d, "orders").select("o_orderkey").write.mode("overwrite").json(f"{folder}/orders")
    lens.read(spark, d, "part").write.mode("overwrite").parquet(f"{folder}/parts")
    found = import_src.detect_formats(spark, folder).where(~F.col("file_name").startswith("_"))
    return found.select("file_format", "error_code").distinct()


from ..streaming import alerts as stream_alerts  # noqa: E402


@register("alert_replay_stream", _replay_sql(ALERT_THRESHOLD, C.ALERT_COOLDOWN_MINUTES) + """
SELECT entity, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, duplicates_ratio, CAST(fired AS INTEGER) AS fired
FROM r""")
def q_alert_replay_stream(spark, d):
    """The alert rule as a stateful stream over the quality log (state: last
    fired time per entity), fed in time-ordered files, read back."""
    log_dir = scratch_path(spark, "qlog")
    log = _written_log(spark, d).select("entity", "event_time", "duplicates_ratio")
    # the log arrives in time order: one file per year, appended in sequence
    # (a year of daily snapshots is a few thousand rows)
    years = sorted(r[0] for r in log.select(F.year("event_time")).distinct().collect())
    for y in years:
        log.where(F.year("event_time") == y).coalesce(1).write.mode("append").parquet(log_dir)
    schema = "entity string, event_time timestamp, duplicates_ratio double"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(log_dir)
    out, ck = scratch_path(spark, "alerts"), scratch_path(spark, "ck-alerts")
    q = stream_alerts.alert_stream(src, ALERT_THRESHOLD).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    ingest.run_available(q)
    return spark.read.parquet(out).withColumn("event_time", ts_text("event_time"))


@register("alert_replay_stream_late", _replay_sql(ALERT_THRESHOLD, C.ALERT_COOLDOWN_MINUTES) + """
SELECT entity, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, duplicates_ratio, CAST(fired AS INTEGER) AS fired
FROM r""")
def q_alert_replay_stream_late(spark, d):
    """The alert rule over a log that arrives out of order: snapshots wait in the state until the watermark has
    passed them; a clock row at the end moves it past the last one."""
    log_dir = scratch_path(spark, "qlog-late")
    log = _written_log(spark, d).select("entity", "event_time", "duplicates_ratio")
    log.repartition(3, F.xxhash64("entity", "event_time")).write.parquet(log_dir)
    src = spark.readStream.schema("entity string, event_time timestamp, duplicates_ratio double").option("maxFilesPerTrigger", "2").parquet(log_dir)
    out, ck = scratch_path(spark, "alerts-late"), scratch_path(spark, "ck-alerts-late")

    def drain():
        q = stream_alerts.alert_stream_late(src, "3660 days", ALERT_THRESHOLD).writeStream.format("parquet").outputMode("append") \
            .option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        ingest.run_available(q)

    drain()
    clock = F.max("event_time") + F.expr("INTERVAL 7400 DAYS")
    log.agg(clock.alias("event_time")).select(F.lit(stream_alerts.CLOCK).alias("entity"), "event_time", F.lit(None).cast("double").alias("duplicates_ratio")) \
        .write.mode("append").parquet(log_dir)
    drain()
    return spark.read.parquet(out).withColumn("event_time", ts_text("event_time"))


_CONTACT_SCHEMA = ("customer_id string, email string, phone string, purchase_location struct<store_id: string>")


@register("pii_hash_json", _contacts_sql(
    f"SELECT customer_id, email_hash AS email, phone_hash AS phone FROM ({_HASH_SQL})"))
def q_pii_hash_json(spark, d):
    """Contact documents as JSON text hashed through the declared schema (the
    batch would fail on an unknown field), read back from the output text."""
    schema = DataType.fromDDL(_CONTACT_SCHEMA)
    docs = lens.customer_contact_documents(spark, d).select(F.to_json("doc").alias("payload"))
    out = pii.hash_json_documents(docs, "payload", schema, SALT)
    j = F.from_json("payload", schema)
    return out.select(j["customer_id"].alias("customer_id"), j["email"].alias("email"), j["phone"].alias("phone"))


@register("pii_hash_any_json", _contacts_sql(
    f"SELECT customer_id, email_hash AS email, phone_hash AS phone, email_hash AS inner_email FROM ({_HASH_SQL})"))
def q_pii_hash_any_json(spark, d):
    """Contact documents of no declared schema (the contact in a list in a map under the customer's own key) hashed at
    any depth, read back from the output text."""
    docs = lens.customer_contact_documents(spark, d).select("doc", F.col("doc.customer_id").alias("id"))
    inner = F.array(F.struct(F.create_map(F.concat(F.lit('a "key" of '), "id"), F.struct(F.col("doc.email").alias("email"))).alias("by")))
    payload = F.to_json(F.struct("id", F.col("doc").alias("contact"), inner.alias("list")), {"ignoreNullFields": "false"})
    out = pii.hash_any_json(docs.select(payload.alias("payload")), "payload", SALT)
    v = F.try_parse_json("payload")
    by = F.from_json(F.to_json(F.try_variant_get(v, "$.list[0].by", "variant")), "map<string,struct<email:string>>")
    text = lambda path, name: F.try_variant_get(v, path, "string").alias(name)
    return out.select(text("$.id", "customer_id"), text("$.contact.email", "email"), text("$.contact.phone", "phone"),
                      F.element_at(F.map_values(by), 1)["email"].alias("inner_email"))


from ..streaming import quality as stream_quality  # noqa: E402

_KEPT = ["stores", "customers", "purchases"]


@register("quality_snapshot_kept", _sql([f"norm_{_NORM_NAME[e]}_m" for e in _KEPT], "\nUNION ALL\n".join(f"SELECT * FROM ({_quality_sql(e)})" for e in _KEPT)))
def q_quality_snapshot_kept(spark, d):
    """The snapshot from counters that streams over the RAW fields keep, fed in several micro-batches; the second
    run of the streams finds nothing new."""
    out, ck = scratch_path(spark, "kept-quality"), scratch_path(spark, "ck-kept-quality")
    for entity in _KEPT:
        src = scratch_path(spark, f"raw-{entity}")
        # as many files as a shuffle has partitions, so that none grows with the table alone; two thirds of them a batch
        files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
        payload_fields(spark, d, entity).repartition(files).write.parquet(src)
        for _ in range(2):
            fields = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", str(files * 2 // 3)).parquet(src)
            for q in stream_quality.count_stream(entity, fields, out, ck, AS_OF, C.DRIVER_IDS):
                ingest.run_available(q)
    return stream_quality.kept_snapshot(spark, out, AS_OF).withColumn("event_time", ts_text("event_time"))


from ..operators import compacted  # noqa: E402


@register("compact_latest_merged", _mart_sql("purchases", True))
def q_compact_latest_merged(spark, d):
    """Current purchases kept in a compacted table: three merges of the RAW history's parts (re-sent rows in other parts
    than the first ones), read from the last version."""
    m = mart.mart("purchases", _typed_fields(spark, d, "purchases"), AS_OF, ids=C.DRIVER_IDS)
    path = scratch_path(spark, "compacted-purchases")
    m.withColumn("_third", F.pmod(F.xxhash64("purchase_id", "ingested_at"), F.lit(3))).write.parquet(f"{path}-in")
    rows, t = spark.read.parquet(f"{path}-in"), compacted.CompactedTable(spark, path, ["purchase_id"], buckets=8)
    for third in range(3):
        t.merge(rows.where(F.col("_third") == third).drop("_third"))
    plain, times = _MART_OUT["purchases"]
    return t.read().select(*plain, *[_tss(x) for x in times], _tss("ingested_at"))


from ..functions.times import best_effort_ts  # noqa: E402

_TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "dd.MM.yyyy HH:mm:ss", "d/M/yyyy hh:mm:ss a", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MMMM d, yyyy HH:mm:ss",
                 "yyyy/M/d HH:mm:ss '+00:00'", "yyyyMMddHHmmss", "'on' yyyy-MM-dd HH:mm:ss"]


@register("raw_purchase_times", f"""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % {len(_TIME_FORMATS)} <> {len(_TIME_FORMATS) - 1}
       THEN strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS purchase_datetime
FROM orders""")
def q_raw_purchase_times(spark, d):
    """RAW times from texts of many formats; the last format is refused."""
    o = lens.read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 7919 % 86400)
    text = F.lit(None).cast("string")
    for i, fmt in enumerate(_TIME_FORMATS):
        text = F.when(F.col("o_orderkey") % len(_TIME_FORMATS) == i, F.date_format(at, fmt)).otherwise(text)
    payload = F.to_json(F.struct(lens.key_id("ord-", "o_orderkey", 6).alias("purchase_id"), text.alias("purchase_datetime")))
    r = raw.raw_purchases(o.select("o_orderkey", payload.alias("payload"), F.lit(AS_OF).cast("timestamp").alias("ingested_at")))
    key = F.regexp_extract("purchase_id", "([0-9]+)$", 1).cast("long")
    return r.select(key.alias("key"), ts_text("purchase_datetime").alias("purchase_datetime"))
