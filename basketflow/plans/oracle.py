"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

The driver registers the raw driver tables as views; these CTEs rebuild the
lens, the MART normalisation/validation and the read-time FINAL in plain SQL,
written independently of the Spark code so the two can check each other.
"""

from __future__ import annotations

from .. import config as C

AS_OF = C.DRIVER_AS_OF

LENS = {
    "lens_stores": """
  SELECT printf('store-%03d', s.s_suppkey) AS store_id, s.s_name AS store_name,
         CASE WHEN n.n_regionkey % 2 = 0 THEN 'north' ELSE 'south' END AS store_network,
         coalesce(n.n_name, '') AS city,
         TIMESTAMP '1995-12-01 00:00:00' + to_seconds(s.s_suppkey * 60) AS ingested_at, s.s_suppkey AS _k
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "lens_products": """
  SELECT printf('prd-%04d', p_partkey) AS product_id, p_name AS name, p_type AS "group",
         p_retailprice AS price, p_brand AS unit, (p_size % 2 = 0) AS is_organic,
         TIMESTAMP '1995-12-01 00:00:00' + to_seconds(p_partkey * 60) AS ingested_at, p_partkey AS _k
  FROM part""",
    "lens_customers": """
  SELECT printf('cus-%06d', c_custkey) AS customer_id, printf('store-%03d', c_nationkey) AS store_id,
         CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 97 = 0 THEN 'not-a-hash'
              ELSE sha256('lens:' || lower(c_name) || '@example.com') END AS email,
         sha256('lens:+7' || printf('%010d', c_custkey)) AS phone,
         CASE WHEN c_custkey % 53 = 0 THEN ''
              ELSE strftime(DATE '1950-01-01' + CAST(c_custkey % 15000 AS INTEGER), '%Y-%m-%d') END AS birth_date,
         CASE WHEN c_acctbal < 0 THEN ''
              ELSE strftime(TIMESTAMP '1990-01-01 00:00:00' + to_seconds(c_custkey * 3600), '%Y-%m-%dT%H:%M:%SZ') END
           AS registration_date,
         TIMESTAMP '1995-12-01 00:00:00' + to_seconds(c_custkey * 60) AS ingested_at, c_custkey AS _k
  FROM customer""",
    "lens_purchases": """
  SELECT printf('ord-%06d', o_orderkey) AS purchase_id, printf('cus-%06d', o_custkey) AS customer_id,
         printf('store-%03d', o_orderkey % 100) AS store_id, o_totalprice AS total_amount,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'cash' WHEN '3-MEDIUM' THEN 'sbp'
              WHEN '4-NOT SPECIFIED' THEN 'online_wallet' WHEN '5-LOW' THEN 'other' ELSE '' END AS payment_method,
         (o_orderstatus = 'F') AS is_delivery,
         strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey % 24) * 3600), '%Y-%m-%dT%H:%M:%SZ')
           AS purchase_datetime,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey % 24) * 3600 + 86400) AS ingested_at,
         o_orderkey AS _k
  FROM orders""",
    "lens_items": """
  SELECT printf('ord-%06d', l.l_orderkey) AS purchase_id, printf('cus-%06d', o.o_custkey) AS customer_id,
         printf('store-%03d', l.l_orderkey % 100) AS store_id, printf('prd-%04d', l.l_partkey) AS product_id,
         CASE WHEN l.l_linenumber = 7 THEN '' ELSE coalesce(p.p_type, '') END AS category,
         l.l_quantity AS quantity,
         CASE WHEN l.l_quantity <> 0 THEN l.l_extendedprice / l.l_quantity ELSE 0.0 END AS price_per_unit,
         l.l_extendedprice AS total_price,
         CAST(o.o_orderdate AS TIMESTAMP) + to_seconds((o.o_orderkey % 24) * 3600) AS purchase_dt,
         CAST(l.l_shipdate AS TIMESTAMP) AS ingested_at
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey""",
}


def _ts(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN try_cast({x} AS TIMESTAMP) END"


def _id(x: str, pattern: str) -> str:
    return f"({x} <> '' AND regexp_matches({x}, '{pattern}'))"


def _hash_or_blank(x: str) -> str:
    return f"({x} = '' OR regexp_matches({x}, '{C.HASH_PATTERN}'))"


def norm_ctes(as_of: str = AS_OF, src: str = "lens", sfx: str = "", a_expr: str | None = None) -> dict[str, str]:
    a = a_expr or f"TIMESTAMP '{as_of}'"
    methods = ", ".join(f"'{m}'" for m in C.PAYMENT_METHODS)
    return {
        f"norm_stores{sfx}": f"""
  SELECT *, ({_id('store_id', C.DRIVER_IDS.store)} AND store_network <> '' AND city <> '') AS is_valid FROM (
    SELECT lower(trim(store_id)) AS store_id, lower(trim(store_network)) AS store_network,
           lower(trim(store_name)) AS store_name, lower(trim(city)) AS city, ingested_at
    FROM {src}_stores)""",
        f"norm_products{sfx}": f"""
  SELECT *, ({_id('product_id', C.DRIVER_IDS.product)} AND price >= 0 AND unit <> '') AS is_valid FROM (
    SELECT lower(trim(product_id)) AS product_id, lower(trim("group")) AS "group", lower(trim(name)) AS name,
           coalesce(CAST(price AS DOUBLE), 0.0) AS price, lower(trim(unit)) AS unit, is_organic, ingested_at
    FROM {src}_products)""",
        f"norm_customers{sfx}": f"""
  SELECT *, ({_id('customer_id', C.DRIVER_IDS.customer)} AND {_id('store_id', C.DRIVER_IDS.store)}
             AND {_hash_or_blank('email_enc')} AND {_hash_or_blank('phone_enc')}
             AND birth_date IS NOT NULL AND birth_date <= CAST({a} AS DATE)
             AND (registration_raw = '' OR registration_dt IS NOT NULL)) AS is_valid FROM (
    SELECT lower(trim(customer_id)) AS customer_id, lower(trim(store_id)) AS store_id,
           trim(email) AS email_enc, trim(phone) AS phone_enc,
           CASE WHEN regexp_matches(trim(birth_date), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
                THEN CAST(try_strptime(trim(birth_date), '%Y-%m-%d') AS DATE) END AS birth_date,
           trim(registration_date) AS registration_raw,
           {_ts('trim(registration_date)')} AS registration_dt, ingested_at
    FROM {src}_customers)""",
        f"norm_purchases{sfx}": f"""
  SELECT *, ({_id('purchase_id', C.DRIVER_IDS.purchase)} AND {_id('customer_id', C.DRIVER_IDS.customer)}
             AND {_id('store_id', C.DRIVER_IDS.store)} AND total_amount >= 0
             AND payment_method IN ({methods}) AND purchase_dt IS NOT NULL AND purchase_dt <= {a}) AS is_valid FROM (
    SELECT lower(trim(purchase_id)) AS purchase_id, lower(trim(customer_id)) AS customer_id,
           lower(trim(store_id)) AS store_id, coalesce(CAST(total_amount AS DOUBLE), 0.0) AS total_amount,
           lower(trim(payment_method)) AS payment_method, coalesce(CAST(is_delivery AS INTEGER), 0) AS is_delivery,
           {_ts('trim(purchase_datetime)')} AS purchase_dt, ingested_at
    FROM {src}_purchases)""",
        f"norm_items{sfx}": f"""
  SELECT *, ({_id('purchase_id', C.DRIVER_IDS.purchase)} AND {_id('customer_id', C.DRIVER_IDS.customer)}
             AND {_id('store_id', C.DRIVER_IDS.store)} AND {_id('product_id', C.DRIVER_IDS.product)}
             AND category <> '' AND purchase_dt IS NOT NULL AND purchase_dt <= {a}
             AND quantity > 0 AND price_per_unit >= 0 AND total_price >= 0) AS is_valid FROM (
    SELECT lower(trim(purchase_id)) AS purchase_id, lower(trim(customer_id)) AS customer_id,
           lower(trim(store_id)) AS store_id, lower(trim(product_id)) AS product_id,
           lower(trim(category)) AS category, coalesce(CAST(quantity AS DOUBLE), 0.0) AS quantity,
           coalesce(CAST(price_per_unit AS DOUBLE), 0.0) AS price_per_unit,
           coalesce(CAST(total_price AS DOUBLE), 0.0) AS total_price,
           CAST(purchase_dt AS TIMESTAMP) AS purchase_dt, ingested_at
    FROM {src}_items)""",
    }


def _latest(src: str, keys: list[str], order: list[str]) -> str:
    o = ", ".join(f"{c} DESC NULLS LAST" for c in order)
    return f"""
  SELECT * EXCLUDE (is_valid) FROM {src} WHERE is_valid
  QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {o}) = 1"""


def mart_ctes(sfx: str = "") -> dict[str, str]:
    return {
        f"mart_stores{sfx}": _latest(f"norm_stores{sfx}", ["store_id"], ["ingested_at", "store_network", "store_name", "city"]),
        f"mart_products{sfx}": _latest(f"norm_products{sfx}", ["product_id"],
                                       ["ingested_at", '"group"', "name", "price", "unit", "is_organic"]),
        f"mart_customers{sfx}": _latest(f"norm_customers{sfx}", ["customer_id"],
                                        ["ingested_at", "store_id", "email_enc", "phone_enc", "birth_date",
                                         "registration_dt"]),
        f"mart_purchases{sfx}": _latest(f"norm_purchases{sfx}", ["purchase_id"],
                                        ["ingested_at", "customer_id", "store_id", "total_amount", "payment_method",
                                         "is_delivery", "purchase_dt"]),
        f"mart_items{sfx}": _latest(f"norm_items{sfx}", ["purchase_id", "product_id"],
                                    ["ingested_at", "customer_id", "store_id", "category", "quantity",
                                     "price_per_unit", "total_price", "purchase_dt"]),
    }


MART_CTES = mart_ctes()


def _resend(lens_name: str) -> str:
    return f"""
  SELECT * FROM {lens_name}
  UNION ALL
  SELECT * REPLACE (ingested_at + INTERVAL 1 HOUR AS ingested_at) FROM {lens_name} WHERE _k % 10 = 3"""


# Stream messages as the RAW layer sees them (re-sent copies included) and the
# array-joined purchase lines.
MSG = {
    "msg_stores": _resend("lens_stores"),
    "msg_products": _resend("lens_products"),
    "msg_customers": _resend("lens_customers"),
    "msg_purchases": _resend("lens_purchases"),
    "msg_items": f"""
  SELECT * FROM (
    SELECT lower(trim(m.purchase_id)) AS purchase_id, lower(trim(m.customer_id)) AS customer_id,
           lower(trim(m.store_id)) AS store_id, lower(trim(printf('prd-%04d', l.l_partkey))) AS product_id,
           lower(trim(CASE WHEN l.l_linenumber = 7 THEN '' ELSE coalesce(p.p_type, '') END)) AS category,
           l.l_quantity AS quantity,
           CASE WHEN l.l_quantity <> 0 THEN l.l_extendedprice / l.l_quantity ELSE 0.0 END AS price_per_unit,
           l.l_extendedprice AS total_price,
           {_ts('m.purchase_datetime')} AS purchase_dt, m.ingested_at
    FROM msg_purchases m JOIN lineitem l ON m._k = l.l_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey)
  WHERE purchase_id <> '' AND product_id <> ''""",
}


QUALITY_KEYS = {
    "stores": "store_id", "products": "product_id", "customers": "customer_id", "purchases": "purchase_id",
    "items": "purchase_id || '|' || product_id",
}
QUALITY_ENTITY = {"stores": "stores", "products": "products", "customers": "customers", "purchases": "purchases",
                  "items": "purchase_items"}


def _history(e: str) -> str:
    w = "OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
  SELECT CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS event_time, '{QUALITY_ENTITY[e]}' AS entity,
         CAST(sum(n) {w} AS BIGINT) AS total_rows_raw, CAST(sum(v) {w} AS BIGINT) AS inserted_rows_mart,
         CAST(sum(n) {w} - sum(v) {w} AS BIGINT) AS invalid_rows,
         CAST(sum(n) {w} - sum(nw) {w} AS BIGINT) AS duplicates_rows,
         CASE WHEN sum(n) {w} = 0 THEN 0.0 ELSE (sum(n) {w} - sum(nw) {w}) / sum(n) {w} END AS duplicates_ratio
  FROM (
    SELECT a.day, a.n, a.v, coalesce(b.nw, 0) AS nw
    FROM (SELECT CAST(ingested_at AS DATE) AS day, count(*) AS n, count_if(coalesce(is_valid, false)) AS v
          FROM norm_{e}_h GROUP BY 1) a
    LEFT JOIN (SELECT d AS day, count(*) AS nw
               FROM (SELECT {QUALITY_KEYS[e]} AS k, min(CAST(ingested_at AS DATE)) AS d FROM norm_{e}_h GROUP BY 1)
               GROUP BY 1) b ON a.day = b.day)"""


HISTORY = {f"hist_{e}": _history(e) for e in QUALITY_KEYS}
HISTORY["qlog"] = "\n  UNION ALL ".join(f"SELECT * FROM hist_{e}" for e in QUALITY_KEYS)


def all_defs(as_of: str = AS_OF) -> dict[str, str]:
    return {**LENS, **MSG, **norm_ctes(as_of), **MART_CTES, **norm_ctes(as_of, "msg", "_m"), **mart_ctes("_m"),
            **norm_ctes(as_of, "msg", "_h", a_expr="ingested_at"), **HISTORY}


def _deps(defs: dict[str, str], name: str) -> list[str]:
    import re
    text = defs[name]
    return [n for n in defs if n != name and re.search(rf"\b{n}\b", text)]


def with_ctes(names: list[str], body: str, as_of: str = AS_OF, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named CTEs (and what they need) + body."""
    defs = {**all_defs(as_of), **(extra or {})}
    order: list[str] = []

    def need(n: str) -> None:
        for dep in _deps(defs, n):
            need(dep)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS ({defs[n]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


def feature_ctes(profile: C.FeatureProfile, as_of: str = AS_OF) -> dict[str, str]:
    """Feature matrix in SQL (DuckDB ``dayofweek``: 0 = Sunday)."""
    a = f"TIMESTAMP '{as_of}'"

    def since(nominal: int) -> str:
        return f"{a} - to_days({profile.days(nominal)})"

    pw = ",\n".join(
        f"    CASE WHEN purchase_dt >= {since(w)} THEN 1 ELSE 0 END AS is_last_{w}d" for w in C.PURCHASE_ACTIVITY_WINDOWS
    )
    iw = ",\n".join(
        f"    CASE WHEN purchase_dt >= {since(w)} THEN 1 ELSE 0 END AS is_last_{w}d" for w in C.ITEM_ACTIVITY_WINDOWS
    )
    sums = ",\n".join(f"    sum(is_last_{w}d) AS purchases_last_{w}d" for w in C.PURCHASE_ACTIVITY_WINDOWS)
    pr = profile

    def rx(p: str) -> str:
        return f"CASE WHEN regexp_matches(coalesce(category_norm, ''), '{p}') THEN 1 ELSE 0 END"

    def z(c: str) -> str:
        return f"coalesce({c}, 0)"

    return {
        "f_base": """
  SELECT DISTINCT customer_id FROM mart_customers WHERE customer_id IS NOT NULL AND customer_id <> ''""",
        "f_pflags": f"""
  SELECT customer_id, lower(trim(store_id)) AS store_id, CAST(total_amount AS DOUBLE) AS total_amount,
         lower(trim(payment_method)) AS payment_method, CAST(is_delivery AS INTEGER) AS is_delivery, purchase_dt,
{pw},
    CASE WHEN lower(trim(payment_method)) = 'cash' THEN 1 ELSE 0 END AS cash_flag,
    CASE WHEN lower(trim(payment_method)) = 'card' THEN 1 ELSE 0 END AS card_flag,
    CASE WHEN dayofweek(purchase_dt) IN (0, 6) THEN 1 ELSE 0 END AS weekend_flag,
    CASE WHEN dayofweek(purchase_dt) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS weekday_flag,
    CASE WHEN hour(purchase_dt) >= {pr.night_start_hour} THEN 1 ELSE 0 END AS night_flag,
    CASE WHEN hour(purchase_dt) < {pr.morning_end_hour} THEN 1 ELSE 0 END AS morning_flag
  FROM mart_purchases WHERE customer_id IS NOT NULL AND customer_id <> ''""",
        "f_pagg": f"""
  SELECT customer_id, count(*) AS purchases_all_time,
{sums},
    avg(total_amount) AS avg_total_amount, avg(cash_flag) AS cash_share, avg(card_flag) AS card_share,
    avg(weekend_flag) AS weekend_share, avg(weekday_flag) AS weekday_share, avg(night_flag) AS night_share,
    avg(morning_flag) AS morning_share, max(is_delivery) AS delivery_any,
    max(CASE WHEN is_last_30d = 1 AND is_delivery = 1 THEN 1 ELSE 0 END) AS delivery_any_30d,
    max(CASE WHEN is_last_90d = 1 THEN total_amount END) AS max_total_amount_90d,
    count(DISTINCT CASE WHEN is_last_90d = 1 THEN store_id END) AS distinct_stores_90d,
    max(CASE WHEN is_last_90d = 1 AND payment_method = 'cash' THEN 1 ELSE 0 END) AS used_cash_90d,
    max(CASE WHEN is_last_90d = 1 AND payment_method = 'card' THEN 1 ELSE 0 END) AS used_card_90d
  FROM f_pflags GROUP BY customer_id""",
        "f_products": """
  SELECT product_id, lower(trim("group")) AS product_group, CAST(is_organic AS INTEGER) AS is_organic_int
  FROM mart_products WHERE product_id IS NOT NULL AND product_id <> ''""",
        "f_items": f"""
  SELECT *,
{iw},
    {rx(pr.milk_pattern)} AS is_milk_item, {rx(pr.meat_pattern)} AS is_meat_item,
    {rx(pr.fruits_pattern)} AS is_fruits_item, {rx(pr.vegetables_pattern)} AS is_vegetables_item,
    {rx(pr.bakery_pattern)} AS is_bakery_item
  FROM (
    SELECT i.customer_id, i.product_id, lower(trim(i.category)) AS category_raw, CAST(i.quantity AS DOUBLE) AS quantity,
           i.purchase_dt, p.product_group, p.is_organic_int,
           coalesce(CASE WHEN length(lower(trim(i.category))) > 0 THEN lower(trim(i.category)) END, p.product_group)
             AS category_norm
    FROM mart_items i LEFT JOIN f_products p ON i.product_id = p.product_id
    WHERE i.customer_id IS NOT NULL AND i.customer_id <> '' AND i.product_id IS NOT NULL AND i.product_id <> '')""",
        "f_iagg": f"""
  SELECT customer_id,
    max(CASE WHEN is_milk_item = 1 AND is_last_7d = 1 THEN 1 ELSE 0 END) AS bought_milk_last_7d,
    max(CASE WHEN is_milk_item = 1 AND is_last_30d = 1 THEN 1 ELSE 0 END) AS bought_milk_last_30d,
    max(CASE WHEN is_meat_item = 1 AND is_last_7d = 1 THEN 1 ELSE 0 END) AS bought_meat_last_7d,
    max(CASE WHEN is_meat_item = 1 AND is_last_30d = 1 THEN 1 ELSE 0 END) AS bought_meat_last_30d,
    max(CASE WHEN is_fruits_item = 1 AND is_last_30d = 1 THEN 1 ELSE 0 END) AS bought_fruits_last_30d,
    max(CASE WHEN is_vegetables_item = 1 AND is_last_30d = 1 THEN 1 ELSE 0 END) AS bought_vegetables_last_30d,
    max(CASE WHEN is_bakery_item = 1 AND is_last_30d = 1 THEN 1 ELSE 0 END) AS bought_bakery_last_30d,
    max(CASE WHEN is_organic_int = 1 AND is_last_90d = 1 THEN 1 ELSE 0 END) AS bought_organic_last_90d,
    max(CASE WHEN quantity > {pr.high_quantity_30d} AND is_last_30d = 1 THEN 1 ELSE 0 END) AS high_quantity_buyer_last_30d,
    max(CASE WHEN is_meat_item = 1 AND is_last_90d = 1 THEN 1 ELSE 0 END) AS has_meat_last_90d,
    max(CASE WHEN (is_fruits_item = 1 OR is_vegetables_item = 1) AND is_last_90d = 1 THEN 1 ELSE 0 END)
      AS has_plant_last_90d
  FROM f_items GROUP BY customer_id""",
        "f_matrix": f"""
  SELECT b.customer_id,
    CAST({z('pa.purchases_last_30d')} > {pr.recurrent_min_30d} AS INTEGER) AS recurrent_buyer,
    CAST({z('pa.delivery_any')} > 0 AS INTEGER) AS delivery_user,
    CAST({z('pa.avg_total_amount')} > {pr.bulk_avg} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS bulk_buyer,
    CAST({z('pa.avg_total_amount')} < {pr.low_cost_avg} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS low_cost_buyer,
    CAST({z('pa.cash_share')} >= {pr.payment_share} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS prefers_cash,
    CAST({z('pa.card_share')} >= {pr.payment_share} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS prefers_card,
    CAST({z('pa.weekend_share')} >= {pr.day_share} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS weekend_shopper,
    CAST({z('pa.weekday_share')} >= {pr.day_share} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS weekday_shopper,
    CAST({z('pa.night_share')} >= {pr.time_share} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS night_shopper,
    CAST({z('pa.morning_share')} >= {pr.time_share} AND {z('pa.purchases_all_time')} > 0 AS INTEGER) AS morning_shopper,
    CAST({z('pa.purchases_all_time')} = 0 AS INTEGER) AS no_purchases,
    CAST({z('pa.purchases_last_7d')} > 0 AS INTEGER) AS has_purchases_last_7d,
    CAST({z('pa.purchases_last_14d')} > 0 AS INTEGER) AS has_purchases_last_14d,
    CAST({z('pa.purchases_last_30d')} > 0 AS INTEGER) AS has_purchases_last_30d,
    CAST({z('pa.purchases_last_90d')} > 0 AS INTEGER) AS has_purchases_last_90d,
    CAST({z('pa.purchases_last_14d')} >= {pr.frequent_min_14d} AS INTEGER) AS frequent_shopper_last_14d,
    CAST({z('pa.max_total_amount_90d')} > {pr.high_ticket_90d} AS INTEGER) AS high_ticket_last_90d,
    CAST({z('pa.delivery_any_30d')} > 0 AS INTEGER) AS delivery_last_30d,
    CAST({z('pa.distinct_stores_90d')} >= {pr.cross_store_min_90d} AS INTEGER) AS cross_store_shopper_last_90d,
    CAST({z('pa.used_cash_90d')} = 1 AND {z('pa.used_card_90d')} = 1 AS INTEGER) AS mixed_payment_user_last_90d,
    CAST({z('ia.bought_milk_last_7d')} AS INTEGER) AS bought_milk_last_7d,
    CAST({z('ia.bought_milk_last_30d')} AS INTEGER) AS bought_milk_last_30d,
    CAST({z('ia.bought_meat_last_7d')} AS INTEGER) AS bought_meat_last_7d,
    CAST({z('ia.bought_meat_last_30d')} AS INTEGER) AS bought_meat_last_30d,
    CAST({z('ia.bought_fruits_last_30d')} AS INTEGER) AS bought_fruits_last_30d,
    CAST({z('ia.bought_vegetables_last_30d')} AS INTEGER) AS bought_vegetables_last_30d,
    CAST({z('ia.bought_bakery_last_30d')} AS INTEGER) AS bought_bakery_last_30d,
    CAST({z('ia.bought_organic_last_90d')} AS INTEGER) AS bought_organic_last_90d,
    CAST({z('ia.high_quantity_buyer_last_30d')} AS INTEGER) AS high_quantity_buyer_last_30d,
    CAST({z('ia.has_meat_last_90d')} = 0 AND {z('ia.has_plant_last_90d')} = 1 AND {z('pa.purchases_all_time')} > 0
         AS INTEGER) AS vegetarian_profile
  FROM f_base b LEFT JOIN f_pagg pa ON b.customer_id = pa.customer_id
       LEFT JOIN f_iagg ia ON b.customer_id = ia.customer_id""",
    }


FEATURE_CTE_ORDER = ["f_base", "f_pflags", "f_pagg", "f_products", "f_items", "f_iagg", "f_matrix"]


def with_features(body: str, profile: C.FeatureProfile, as_of: str = AS_OF) -> str:
    return with_ctes(FEATURE_CTE_ORDER, body, as_of, extra=feature_ctes(profile, as_of))


CONTACTS = """
  SELECT printf('cus-%06d', c_custkey) AS customer_id,
         CASE WHEN c_custkey % 7 = 0 THEN '  ' || upper(lower(c_name) || '@example.com') || chr(9)
              ELSE lower(c_name) || '@example.com' END AS email,
         CASE c_custkey % 5
           WHEN 0 THEN '8 (' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 2) || '-' || substr(d, 9, 2)
           WHEN 1 THEN '+7-' || substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7, 2) || '-' || substr(d, 9, 2)
           WHEN 2 THEN d
           WHEN 3 THEN 'tel ' || d
           ELSE ' 7' || d || chr(9) END AS phone
  FROM (SELECT *, printf('%010d', 9000000000 + c_custkey) AS d FROM customer)"""

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS})"


def phone_norm_sql(x: str) -> tuple[str, str]:
    cleaned = f"regexp_replace({strip_sql(x)}, '[\\s()\\-]', '', 'g')"
    ok = f"(starts_with({cleaned}, '+') OR regexp_matches({cleaned}, '^[78][0-9]{{10}}$'))"
    value = (f"CASE WHEN starts_with({cleaned}, '+') THEN {cleaned} "
             f"WHEN regexp_matches({cleaned}, '^[78][0-9]{{10}}$') THEN '+7' || substr({cleaned}, 2) ELSE {x} END")
    return value, ok


def hash_sql(x: str, salt: str) -> str:
    v = strip_sql(x)
    return f"CASE WHEN {x} IS NULL OR {v} = '' THEN '' ELSE sha256('{salt}:' || {v}) END"
