"""The gram index answers as ``contains`` does."""

import pytest
from pyspark.sql import functions as F

from basketflow.operators import search

KEYS = ["cus-000001", "cus-000010", "cus-000100", "CUS-00A1", "a", "ab", "aba", "ababab", "ÄÖ-1", "x%y_z", "aaa", "0001", "", "aaaa", "a b"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(KEYS + KEYS[:3])] + [(None, 99)], "key string, n int")
    return search.build(rows, "key", str(tmp_path_factory.mktemp("grams") / "index"), 3)


@pytest.mark.parametrize("text", ["0", "00", "0001", "cus", "CUS-0", "ba", "bab", "ababab", "äö", "%y", "y_z", "zzz", "aab", "aaa", "aaaa", "cus-000001x", "a b", " ab "])
def test_equals_contains(spark, index, text):
    got = sorted(r["key"] for r in search.find(spark, index, text).collect())
    assert got == sorted(k for k in KEYS if text.strip().lower() in k.lower())


def test_pages(spark, index):
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(KEYS)], "id string, n int")
    page = [r["id"] for r in search.page(spark, index, rows, "id", "a", 1, 10).collect()]
    assert page == sorted(k for k in KEYS if "a" in k.lower())[:10]
    assert search.page(spark, index, rows, "id", "a", 2, 10).count() == 0
    for bad in ({"number": 0}, {"size": 11}):
        with pytest.raises(ValueError):
            search.page(spark, index, rows, "id", "a", **bad)
    with pytest.raises(ValueError):
        search.find(spark, index, "  ")


def test_the_scan_is_pruned_by_gram(spark, index):
    plan = search.find(spark, index, "0001")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [000,001])]" in plan.split("PushedFilters:")[1]


def test_empty_table(spark, tmp_path):
    path = search.build(spark.createDataFrame([], "key string"), "key", str(tmp_path / "none"))
    assert search.find(spark, path, "a").count() == 0
