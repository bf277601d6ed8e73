"""The matrix at many dates equals the matrix made date by date."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketflow import config as C
from basketflow.operators import feature_history, features

START = dt.datetime(2025, 7, 10, 12)
DATES = [START + dt.timedelta(days=n) for n in (0, 1, 14, 90, 200)]
DAY = dt.timedelta(days=1)


def _tables(spark, seed, n):
    r = random.Random(seed)

    def when():
        day = START + r.randint(-120, 210) * DAY
        # a third stands on a date or at the very start of a window
        return day + r.choice([dt.timedelta(), -dt.timedelta(microseconds=1), dt.timedelta(microseconds=1), dt.timedelta(seconds=r.randint(0, 86399))])

    who = ["hot"] * 4 + [f"c{i}" for i in range(6)]
    purchases = [(f"p{i}", r.choice(who), f"store-00{r.randint(1, 3)}", r.choice([10.0, 150.0, 1500.0, 1500.5, 4000.0]),
                  r.choice(["cash", "card", "sbp"]), r.randint(0, 1), when()) for i in range(n)]
    items = [(r.choice(who), f"prd-{r.randint(1, 4)}", r.choice(["dairy", "meat", "fruit", "", "bread"]), r.choice([1.0, 2.0, 3.0]), 5.0, when())
             for i in range(n)]
    customers = [(c,) for c in sorted(set(who)) + ["none"]]
    return (spark.createDataFrame(customers, "customer_id string"),
            spark.createDataFrame(purchases, "purchase_id string, customer_id string, store_id string, total_amount double, "
                                             "payment_method string, is_delivery int, purchase_dt timestamp"),
            spark.createDataFrame([(f"prd-{i}", g, i % 2 == 0) for i, g in enumerate(["dairy", "greens", "fish", "bread", "other"])],
                                  "product_id string, `group` string, is_organic boolean"),
            spark.createDataFrame(items, "customer_id string, product_id string, category string, quantity double, total_price double, "
                                         "purchase_dt timestamp"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed,n", [(2, 400)])
def test_equals_the_matrix_date_by_date(spark, seed, n):
    c, p, pr, i = _tables(spark, seed, n)
    got = {}
    for row in feature_history.feature_history(c, p, pr, i, DATES + DATES[:2], C.RETAIL).collect():
        got.setdefault(row["as_of"], []).append(tuple(row[x] for x in ["customer_id", *C.FEATURE_COLUMNS]))
    assert sorted(got) == DATES
    for date in DATES:
        past = F.col("purchase_dt") <= F.lit(date)
        assert sorted(got[date]) == _rows(features.feature_matrix(c, p.where(past), pr, i.where(past), date, C.RETAIL)), date


def test_no_rows_and_one_date(spark):
    c, p, pr, i = _tables(spark, 3, 10)
    got = feature_history.feature_history(c, p.limit(0), pr, i.limit(0), [START], C.RETAIL).collect()
    assert len(got) == c.count() and all(r["no_purchases"] == 1 for r in got)


def test_dates_of_one_time_of_day(spark):
    with pytest.raises(ValueError):
        feature_history.Grid([START, START + dt.timedelta(hours=1)])
    with pytest.raises(ValueError):
        feature_history.Grid([])


def test_one_exchange_of_cells_serves_the_windows(spark):
    c, p, pr, i = _tables(spark, 4, 10)
    grid = feature_history.Grid(DATES)
    flags = features.purchase_flags(p, DATES[-1], C.RETAIL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = feature_history.reduced_at(flags, c, tuple(m for m in features.PURCHASE_MEASURES if m.reduce in ("count", "any")), grid, C.RETAIL)
        plan = told._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the cells, and the running sum by customer; the reduction to dates adds none
    assert plan.count("Exchange hashpartitioning") == 2
