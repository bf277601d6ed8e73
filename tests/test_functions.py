import datetime as dt

from pyspark.sql import functions as F

from basketflow.functions import jsonx, norm


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_js_str_defaults(spark):
    d = jsonx.parse("x")
    cases = {
        '{"a": "v"}': "v",
        '{"a": null}': "",
        "{}": "",
        '{"a": 5}': "",          # a number is not a string: default
        '{"a": {"b": 1}}': "",
        "not json": "",
    }
    for text, want in cases.items():
        assert _one(spark, jsonx.js_str(d, "a"), text) == want, text


def test_js_double_and_bool(spark):
    d = jsonx.parse("x")
    assert _one(spark, jsonx.js_double(d, "t"), '{"t": 12.5}') == 12.5
    assert _one(spark, jsonx.js_double(d, "t"), "{}") == 0.0
    assert _one(spark, jsonx.js_double(d, "t"), '{"t": "5"}') == 5.0
    assert _one(spark, jsonx.js_double(d, "t"), '{"t": "abc"}') == 0.0
    assert _one(spark, jsonx.js_bool(d, "b"), '{"b": true}') == 1
    assert _one(spark, jsonx.js_bool(d, "b"), '{"b": "true"}') == 0
    assert _one(spark, jsonx.js_bool(d, "b"), "{}") == 0


def test_nested_path_and_array(spark):
    d = jsonx.parse("x")
    assert _one(spark, jsonx.js_str(d, "customer", "customer_id"), '{"customer": {"customer_id": "cus-1"}}') == "cus-1"
    assert _one(spark, F.size(jsonx.js_array(d, "items")), '{"items": [{"a": 1}, {"a": 2}]}') == 2
    assert _one(spark, F.size(jsonx.js_array(d, "items")), "{}") == 0


def test_trim_strip_and_anchor(spark):
    assert _one(spark, norm.norm("x"), "  ABC ") == "abc"
    assert _one(spark, norm.norm("x"), "\tABC") == "\tabc"          # trim: spaces only
    assert _one(spark, norm.strip_ws("x"), "\t ab c \n") == "ab c"   # strip: all whitespace
    assert _one(spark, norm.matches("x", r"^[a-z]{3}$"), "abc") is True
    assert _one(spark, norm.matches("x", r"^[a-z]{3}$"), "abc\n") is False


def test_dates(spark):
    assert _one(spark, norm.iso_date("x"), "2025-07-10") == dt.date(2025, 7, 10)
    for bad in ("2025", "2025-02-30", "garbage", "2025-07-10 junk", ""):
        assert _one(spark, norm.iso_date("x"), bad) is None, bad
    assert _one(spark, norm.iso_ts("x"), "2025-07-10T12:00:00Z") == dt.datetime(2025, 7, 10, 12, 0)
    assert _one(spark, norm.iso_ts("x"), "2025-07-10T12:00:00+03:00") == dt.datetime(2025, 7, 10, 9, 0)
    assert _one(spark, norm.iso_ts("x"), "garbage") is None
    assert _one(spark, norm.iso_ts("x"), "") is None
