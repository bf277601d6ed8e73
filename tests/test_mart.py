import json

from pyspark.sql import functions as F

from basketflow.operators import latest, mart, raw

AS_OF = "2025-07-10 12:00:00"


def _msgs(spark, docs):
    rows = [(json.dumps(d) if not isinstance(d, str) else d, t) for d, t in docs]
    return spark.createDataFrame(rows, "payload string, ingested_at string").withColumn(
        "ingested_at", F.col("ingested_at").cast("timestamp"))


def _purchase(pid, **kw):
    d = {"purchase_id": pid, "customer": {"customer_id": "cus-000001"}, "store": {"store_id": "store-001"},
         "total_amount": 10.0, "payment_method": "card", "purchase_datetime": "2025-07-01T10:00:00Z",
         "items": [{"product_id": "prd-0001", "category": "Dairy", "quantity": 1, "price_per_unit": 10.0,
                    "total_price": 10.0}]}
    d.update(kw)
    return d


def test_purchase_validity_edges(spark):
    cases = [
        (_purchase(" ORD-000001 "), True),            # upper case + padding: kept after normalising
        (_purchase(""), False),
        (_purchase("ord-000002\n"), True),            # trim keeps a newline?  no: trim removes spaces only
        (_purchase("ord-00003"), False),              # 5 digits
        (_purchase("ord-0000004"), False),            # 7 digits
        (_purchase("ord-20250710-0001"), False),
        ({k: v for k, v in _purchase("ord-000005").items() if k != "total_amount"}, True),  # missing total = 0.0
        (_purchase("ord-000006", total_amount=-0.01), False),
        (_purchase("ord-000007", total_amount=0), True),
        (_purchase("ord-000008", total_amount="5"), True),
        (_purchase("ord-000009", total_amount=None), True),   # JSON null → 0.0
        (_purchase("ord-000010", purchase_datetime="garbage"), False),
        (_purchase("ord-000011", purchase_datetime="2025-07-10T12:00:00Z"), True),   # equal to as_of
        (_purchase("ord-000012", purchase_datetime="2025-07-10T12:00:01Z"), False),  # 1 s after
        (_purchase("ord-000013", payment_method="Online_Wallet"), True),
        (_purchase("ord-000014", payment_method="bitcoin"), False),
        ({k: v for k, v in _purchase("ord-000015").items() if k != "purchase_datetime"}, False),
    ]
    msgs = _msgs(spark, [(d, "2025-07-10 00:00:00") for d, _ in cases])
    got = {r["purchase_id"] for r in mart.mart_purchases(msgs, AS_OF).collect()}
    want = {"ord-000001", "ord-000005", "ord-000007", "ord-000008", "ord-000009", "ord-000011", "ord-000013"}
    # "ord-000002\n": trim removes spaces only, so the newline stays and "\z" rejects it
    assert got == want


def test_newest_invalid_version_keeps_older_valid(spark):
    msgs = _msgs(spark, [
        (_purchase("ord-000001", total_amount=1.0), "2025-07-01 00:00:00"),
        (_purchase("ord-000001", total_amount=-5.0), "2025-07-02 00:00:00"),   # newer but invalid
        (_purchase("ord-000002", total_amount=1.0), "2025-07-01 00:00:00"),
        (_purchase("ord-000002", total_amount=2.0), "2025-07-03 00:00:00"),    # newer valid wins
        (_purchase("ord-000003", total_amount=3.0), "2025-07-01 00:00:00"),
        (_purchase("ord-000003", total_amount=4.0), "2025-07-01 00:00:00"),    # tie: fixed order picks one
    ])
    final = latest.latest_mart("purchases", mart.mart_purchases(msgs, AS_OF))
    got = {r["purchase_id"]: r["total_amount"] for r in final.collect()}
    assert got == {"ord-000001": 1.0, "ord-000002": 2.0, "ord-000003": 4.0}


def test_items_array_join(spark):
    msgs = _msgs(spark, [
        (_purchase("ord-000001", items=[]), "2025-07-01 00:00:00"),
        ({k: v for k, v in _purchase("ord-000002").items() if k != "items"}, "2025-07-01 00:00:00"),
        (_purchase("ord-000003", items=[
            {"product_id": "PRD-0001", "category": " Dairy ", "quantity": 2, "price_per_unit": 1.5, "total_price": 3.0},
            {"product_id": "prd-0001", "category": "Dairy", "quantity": 1, "price_per_unit": 1.5, "total_price": 1.5},
            {"product_id": "", "category": "x", "quantity": 1},
            {"product_id": "prd-0002", "category": "", "quantity": 1, "price_per_unit": 1, "total_price": 1},
            {"product_id": "prd-0003", "category": "Meat", "quantity": 0, "price_per_unit": 1, "total_price": 1},
        ]), "2025-07-01 00:00:00"),
    ])
    items = raw.raw_purchase_items(raw.raw_purchases(msgs))
    rows = items.collect()
    assert len(rows) == 4                     # empty/missing arrays give nothing, blank product dropped
    assert {r["category"] for r in rows} == {"dairy", "", "meat"}
    m = mart.mart_purchase_items(items, AS_OF)
    assert m.count() == 2                     # blank category and quantity 0 rejected
    final = latest.latest_mart("purchase_items", m)
    assert final.count() == 1                 # same product twice in one purchase collapses


def test_customer_rules(spark):
    h = "a" * 64
    base = {"customer_id": "cus-000001", "purchase_location": {"store_id": "store-001"}, "email": h, "phone": "",
            "birth_date": "1990-01-01", "registration_date": ""}

    def c(cid, **kw):
        d = dict(base, customer_id=cid)
        d.update(kw)
        return (d, "2025-07-01 00:00:00")

    msgs = _msgs(spark, [
        c("cus-000001"),
        c("cus-000002", email="A" * 64),                 # upper hex: not lowered → invalid
        c("cus-000003", email="a" * 63),
        c("cus-000004", birth_date="2025"),
        c("cus-000005", birth_date="2025-02-30"),
        c("cus-000006", registration_date="garbage"),
        c("cus-000007", registration_date="2024-01-01T00:00:00Z"),
        c("cus-000008", birth_date="2025-07-11"),        # after as_of
        c("cus-000009", email=f"  {h}  "),               # trimmed
    ])
    got = {r["customer_id"] for r in mart.mart_customers(msgs, AS_OF).collect()}
    assert got == {"cus-000001", "cus-000007", "cus-000009"}
