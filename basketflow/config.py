"""Thresholds, patterns and profiles shared by every job.

Two profiles exist:

* ``RETAIL`` keeps the business rules of the original retail pipeline unchanged.
  It is what a user of the original platform runs on store/product/customer/
  purchase documents.
* ``DRIVER`` is the same rule set re-scaled for the TPC-H-shaped driver tables
  (see ``sources/lens.py``): orders there are sparse (about ten per customer over
  six years) and priced in the hundreds of thousands, so the windows and the
  money thresholds are stretched.  Column names never change, so downstream
  consumers see the same 30-column matrix either way.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --------------------------------------------------------------------------
# These must equal the original platform's rules for results to
# match.  Kept together, in their original order.
# --------------------------------------------------------------------------
PAYMENT_PREFERENCE_MIN_SHARE = 0.7
DAY_OF_WEEK_SHOPPER_MIN_SHARE = 0.6
TIME_OF_DAY_SHOPPER_MIN_SHARE = 0.5
RECURRENT_BUYER_MIN_PURCHASES_30D = 2
FREQUENT_SHOPPER_MIN_PURCHASES_14D = 3
BULK_BUYER_MIN_AVG_TOTAL_AMOUNT = 1000.0
LOW_COST_BUYER_MAX_AVG_TOTAL_AMOUNT = 200.0
HIGH_TICKET_MIN_TOTAL_AMOUNT_90D = 1500.0
HIGH_QUANTITY_MIN_ITEMS_30D = 2.0
CROSS_STORE_MIN_DISTINCT_STORES_90D = 2
NIGHT_SHOPPER_START_HOUR = 20
MORNING_SHOPPER_END_HOUR = 10

PURCHASE_ACTIVITY_WINDOWS = (7, 14, 30, 90)
ITEM_ACTIVITY_WINDOWS = (7, 30, 90)

MILK_CATEGORY_PATTERN = "молоч|dairy"
MEAT_CATEGORY_PATTERN = "мяс|рыб|яйц|бобов|meat|fish|egg|bean|protein"
FRUITS_CATEGORY_PATTERN = "фрукт|ягод|fruit|berry"
VEGETABLES_CATEGORY_PATTERN = "овощ|зел|vegetable|green"
BAKERY_CATEGORY_PATTERN = "зернов|хлеб|grain|bakery|bread"

FEATURE_COLUMNS = [
    "recurrent_buyer",
    "delivery_user",
    "bulk_buyer",
    "low_cost_buyer",
    "prefers_cash",
    "prefers_card",
    "weekend_shopper",
    "weekday_shopper",
    "night_shopper",
    "morning_shopper",
    "no_purchases",
    "has_purchases_last_7d",
    "has_purchases_last_14d",
    "has_purchases_last_30d",
    "has_purchases_last_90d",
    "frequent_shopper_last_14d",
    "high_ticket_last_90d",
    "delivery_last_30d",
    "cross_store_shopper_last_90d",
    "mixed_payment_user_last_90d",
    "bought_milk_last_7d",
    "bought_milk_last_30d",
    "bought_meat_last_7d",
    "bought_meat_last_30d",
    "bought_fruits_last_30d",
    "bought_vegetables_last_30d",
    "bought_bakery_last_30d",
    "bought_organic_last_90d",
    "high_quantity_buyer_last_30d",
    "vegetarian_profile",
]

# MART validation patterns (anchored at both ends of the text).
STORE_ID_PATTERN = r"^store-[0-9]{3}$"
PRODUCT_ID_PATTERN = r"^prd-[0-9]{4}$"
CUSTOMER_ID_PATTERN = r"^cus-[0-9]{6}$"
PURCHASE_ID_PATTERN = r"^ord-[0-9]{6}$"
# Tables whose keys outgrow the fixed widths: at least as many digits.
WIDE_STORE_ID_PATTERN = r"^store-[0-9]{3,}$"
WIDE_PRODUCT_ID_PATTERN = r"^prd-[0-9]{4,}$"
WIDE_CUSTOMER_ID_PATTERN = r"^cus-[0-9]{6,}$"
WIDE_PURCHASE_ID_PATTERN = r"^ord-[0-9]{6,}$"
HASH_PATTERN = r"^[0-9a-f]{64}$"
PAYMENT_METHODS = ("card", "cash", "online_wallet", "sbp", "other")

# Metric endpoints.
DUPLICATES_BAD_THRESHOLD = 0.5
QUALITY_ENTITY_ORDER = ["purchases", "customers", "stores", "products", "purchase_items"]
ALERT_RULE_NAME = "duplicates_ratio_threshold"
ALERT_COOLDOWN_MINUTES = 15

# Imports.
IMPORT_FORMATS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "ndjson", ".csv": "csv"}
IMPORT_REQUIRED_FIELDS = {
    "stores": (("store_id",),),
    "products": (("product_id", "id"),),
    "customers": (("customer_id",),),
    "purchases": (("purchase_id",),),
}

# Exports.
EXPORT_NAME_PATTERN = r"^analytic_result_(\d{4})_(\d{2})_(\d{2})\.csv$"
EXPORT_FLAG_TRUE_VALUES = ("1", "true", "yes", "y")

# PII.
PII_MIN_SALT_LENGTH = 16
# --------------------------------------------------------------------------


def java_anchor(pattern: str) -> str:
    """Java's ``$`` also matches before a trailing newline; ``\\z`` does not.

    The original engine's regex dialect treats ``$`` as end-of-text, so every
    anchored pattern is rewritten once here.
    """
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


@dataclass(frozen=True)
class IdPatterns:
    """The id rules of the MART validation."""

    store: str = STORE_ID_PATTERN
    product: str = PRODUCT_ID_PATTERN
    customer: str = CUSTOMER_ID_PATTERN
    purchase: str = PURCHASE_ID_PATTERN


RETAIL_IDS = IdPatterns()
# validity must not depend on how many rows a table has
DRIVER_IDS = IdPatterns(WIDE_STORE_ID_PATTERN, WIDE_PRODUCT_ID_PATTERN, WIDE_CUSTOMER_ID_PATTERN, WIDE_PURCHASE_ID_PATTERN)


@dataclass(frozen=True)
class FeatureProfile:
    """All knobs of the feature matrix.  ``windows`` maps the nominal window
    in a column name (7, 14, 30, 90) to the number of days actually used."""

    name: str = "retail"
    windows: dict = field(default_factory=lambda: {7: 7, 14: 14, 30: 30, 90: 90})
    payment_share: float = PAYMENT_PREFERENCE_MIN_SHARE
    day_share: float = DAY_OF_WEEK_SHOPPER_MIN_SHARE
    time_share: float = TIME_OF_DAY_SHOPPER_MIN_SHARE
    recurrent_min_30d: int = RECURRENT_BUYER_MIN_PURCHASES_30D
    frequent_min_14d: int = FREQUENT_SHOPPER_MIN_PURCHASES_14D
    bulk_avg: float = BULK_BUYER_MIN_AVG_TOTAL_AMOUNT
    low_cost_avg: float = LOW_COST_BUYER_MAX_AVG_TOTAL_AMOUNT
    high_ticket_90d: float = HIGH_TICKET_MIN_TOTAL_AMOUNT_90D
    high_quantity_30d: float = HIGH_QUANTITY_MIN_ITEMS_30D
    cross_store_min_90d: int = CROSS_STORE_MIN_DISTINCT_STORES_90D
    night_start_hour: int = NIGHT_SHOPPER_START_HOUR
    morning_end_hour: int = MORNING_SHOPPER_END_HOUR
    milk_pattern: str = MILK_CATEGORY_PATTERN
    meat_pattern: str = MEAT_CATEGORY_PATTERN
    fruits_pattern: str = FRUITS_CATEGORY_PATTERN
    vegetables_pattern: str = VEGETABLES_CATEGORY_PATTERN
    bakery_pattern: str = BAKERY_CATEGORY_PATTERN

    def days(self, nominal: int) -> int:
        return int(self.windows[nominal])

    def with_(self, **kw) -> "FeatureProfile":
        return replace(self, **kw)


RETAIL = FeatureProfile()

# Driver profile: same rules, stretched to the sparse, high-priced TPC-H orders.
DRIVER = FeatureProfile(
    name="driver",
    windows={7: 30, 14: 90, 30: 180, 90: 300},
    bulk_avg=300000.0,
    low_cost_avg=150000.0,
    high_ticket_90d=400000.0,
    high_quantity_30d=25.0,
    milk_pattern="standard",
    meat_pattern="promo",
    fruits_pattern="small",
    vegetables_pattern="large",
    bakery_pattern="economy",
)

# The driver data's purchases span 1995-01-01 .. 2001-08-01; validity is "not in
# the future", so the clock stands after the last purchase and keeps all of them.
DRIVER_AS_OF = "2001-08-03 00:00:00"
# One extra feature query runs at this clock, at which many customers have no purchase yet.
EARLY_AS_OF = "1996-01-01 00:00:00"
RETAIL_AS_OF = "2025-07-10 12:00:00"

PROFILES = {"retail": RETAIL, "driver": DRIVER}

# The PII salt is configuration: real jobs pass it in or set BASKETFLOW_PII_SALT.
# The catalog's PII queries run on invented contact data (see lens
# ``customer_contacts``) and use this fixed, non-secret demo salt so that the
# SQL oracle can reproduce the hashes.
DEMO_PII_SALT = "synthetic-demo-salt-not-a-secret"


def pii_salt(explicit: str | None = None) -> str:
    import os

    s = explicit or os.environ.get("BASKETFLOW_PII_SALT", "")
    if not s.strip():
        raise ValueError("PII hash salt is required (argument or BASKETFLOW_PII_SALT)")
    return s
