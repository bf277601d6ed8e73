"""Purchase messages read once into columns give what the VARIANT path gives, on regular and odd documents."""

import datetime as dt
import json

from basketflow import config as C
from basketflow.operators import mart, quality, raw

AT = dt.datetime(2024, 5, 1, 23, 30)
LINE = {"product_id": "prd-0001", "category": "a", "quantity": 2.0, "price_per_unit": 1.5, "total_price": 3}
DOC = {"purchase_id": "ord-000001", "customer": {"customer_id": "cus-000001"}, "store": {"store_id": "store-001"}, "items": [LINE, LINE],
       "total_amount": 3.0, "payment_method": "card", "is_delivery": True, "purchase_datetime": "2024-04-30T10:00:00Z"}


def _texts():
    odd = [{"purchase_id": 5}, {"purchase_id": "5"}, {"purchase_id": "true"}, {"purchase_id": None}, {"purchase_id": {"a": 1}}, {"purchase_id": "{}"},
           {"customer": "x"}, {"customer": {"customer_id": ["a"]}}, {"store": None}, {"total_amount": "7.5"}, {"total_amount": True},
           {"total_amount": 10**30}, {"total_amount": -0.0}, {"total_amount": [1]}, {"is_delivery": "true"}, {"is_delivery": 1}, {"is_delivery": None},
           {"purchase_datetime": 1714557600}, {"purchase_datetime": "1714557600"}, {"purchase_datetime": "2024-04-30"}, {"purchase_datetime": " "},
           {"items": []}, {"items": None}, {"items": {}}, {"items": "x"}, {"items": [1, None, "a", [LINE], LINE]}, {"payment_method": 'a "b" \\ é 😀'},
           {"items": [{**LINE, "product_id": 12}, {**LINE, "product_id": "12"}]}, {"items": [{**LINE, "quantity": "3"}, {**LINE, "category": False}, {}]}]
    texts = [json.dumps({**DOC, **o}) for o in odd] + [json.dumps({k: v for k, v in DOC.items() if k != gone}) for gone in DOC]
    whole = json.dumps(DOC)
    twice = whole[:-1] + ', "purchase_id": "ord-000002"}'
    inner = whole.replace('"category"', '"category": "z", "category"', 1)
    return texts + [whole, whole + " junk", "  " + whole, f"[{whole}]", whole[:-1], twice, inner, whole.replace('"', "'"), "", "null", "5", "{}", None,
                    whole.replace("2.0", "NaN", 1), whole.replace("3.0", "1e400")]


def _rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_fields_are_those_of_the_variant(spark):
    sent = spark.createDataFrame([(t, AT + dt.timedelta(hours=i)) for i, t in enumerate(_texts())], "payload string, ingested_at timestamp")
    read = raw.read_purchases(sent)
    assert _rows(mart.purchase_fields(read)) == _rows(mart.purchase_fields(sent).drop("payload"))
    assert _rows(raw.raw_purchases(read)) == _rows(raw.raw_purchases(sent).drop("payload"))
    lines = raw.raw_purchase_items(raw.raw_purchases(read, keep_doc=True))
    assert _rows(lines) == _rows(raw.raw_purchase_items(raw.raw_purchases(sent, keep_doc=True)).drop("payload"))


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_shuffles_rows_once_without_lists(spark):
    fields = spark.createDataFrame([(f"store-{k:03d}" if k else None, "n", "s", "c", at and AT + dt.timedelta(days=at - 1))
                                    for k, at in ((1, 1), (1, 2), (1, 2), (2, 2), (0, 3), (0, 4), (3, None), (2, None))],
                                   "store_id string, store_network string, store_name string, city string, ingested_at timestamp")
    log = quality.history("stores", fields, C.RETAIL_IDS)
    assert "collect_list" not in _text(log) and _text(log).count("hashpartitioning(_key") == 1
    got = [(str(r["event_time"])[:10], r["total_rows_raw"], r["inserted_rows_mart"], r["duplicates_rows"]) for r in log.orderBy("event_time").collect()]
    assert got == [("None", 2, 2, 2), ("2024-05-02", 3, 3, 2), ("2024-05-03", 6, 6, 4), ("2024-05-04", 7, 6, 4), ("2024-05-05", 8, 6, 5)]


def test_quality_log_parses_messages_once(spark, monkeypatch):
    from basketflow.plans import catalog, tables
    parsed = []
    monkeypatch.setattr(raw, "with_doc", lambda df, *a, _old=raw.with_doc, **k: (parsed.append(1), _old(df, *a, **k))[1])
    d = "/root/testdata/sf0.001"
    fields = catalog._fields(spark, d)
    assert parsed == [1] and "payload" not in fields["purchases"].columns + fields["purchase_items"].columns
    for e in ("purchases", "purchase_items"):
        assert "parseJson" not in _text(fields[e])
        assert _rows(fields[e]) == _rows(tables.payload_fields(spark, d, e).drop("payload"))


def test_small_files_are_dealt_to_all_tasks(spark):
    from basketflow.plans import catalog
    from basketflow.sources import lens
    d = "/root/testdata/sf0.001"
    c, _, p, _ = catalog.feature_inputs(spark, d, spread=True)
    for rows in (lens.messages(spark, d, "customers"), lens.messages(spark, d, "products"), c, p):
        text = _text(rows)
        assert text.index("Project") < text.index("REPARTITION_BY_COL") < text.rindex("FileScan")
