import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from basketflow import config as C
from basketflow.operators import generate
from basketflow.session import scratch_path
from basketflow.sources import documents, exports


def test_upsert_field_merge_and_counts(spark):
    existing = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "id string, name string, price double")
    incoming = spark.createDataFrame([("a", None, 5.0), ("c", "z", 3.0), ("c", "z2", 4.0), ("b", "y", 2.0)],
                                     "id string, name string, price double")
    merged, counts = documents.upsert(existing, incoming, "id")
    got = {r["id"]: (r["name"], r["price"]) for r in merged.collect()}
    assert got["a"] == ("x", 5.0)               # absent field keeps the stored value
    assert got["b"] == ("y", 2.0)
    assert got["c"] == ("z2", 4.0)               # one row per key, deterministic pick
    c = counts.first()
    assert (c["processed"], c["inserted"], c["updated"]) == (4, 1, 1)   # 4 documents; b matched, unchanged


def test_envelope_roundtrip(spark):
    docs = spark.createDataFrame([("cus-000001", "e")], "customer_id string, email string").select(
        F.struct("customer_id", "email").alias("doc"))
    e = documents.envelope(docs, "customers", "2024-01-01 00:00:00")
    r = e.first()
    assert (r["key"], r["source"], r["object_id"], r["event_ts"]) == (
        "cus-000001", "customers", "cus-000001", "2024-01-01T00:00:00.000000Z")
    back = documents.unwrap_envelope(e.select(F.to_json(F.struct("source", "object_id", "payload", "event_ts"))
                                              .alias("value")))
    assert back.first()["payload"] == '{"customer_id":"cus-000001","email":"e"}'


def test_export_roundtrip_and_flags(spark):
    m = spark.createDataFrame([("cus-1", 1, 0), ("  ", 1, 1)], "customer_id string, a int, b int")
    path = exports.write_csv(m, scratch_path(spark, "t-exp"), dt.date(2025, 7, 10), single_file=True)
    assert path.endswith("analytic_result_2025_07_10.csv")
    back = exports.read_export(spark, path)
    assert [tuple(r) for r in back.collect()] == [("cus-1", 1, 0)]
    vals = spark.createDataFrame([(v,) for v in ["1", "TRUE", " yes ", "y", "0", "no", "", "01", "2", "abc", None]],
                                 "v string")
    assert [r[0] for r in vals.select(exports.to_flag(F.col("v"))).collect()] == [1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0]


def test_latest_export_skips_impossible_dates(spark):
    base = scratch_path(spark, "t-list")
    m = spark.createDataFrame([("c", 1)], "customer_id string, a int")
    for d in (dt.date(2025, 7, 8), dt.date(2025, 7, 9)):
        exports.write_csv(m, base, d)
    m.write.mode("overwrite").option("header", "true").csv(f"{base}/analytic_result_2025_02_30.csv")
    m.write.mode("overwrite").option("header", "true").csv(f"{base}/other_2026_01_01.csv")
    latest = exports.latest_export(exports.list_exports(spark, base)).first()
    assert latest["filename"] == "analytic_result_2025_07_09.csv"


def test_generator_self_check(spark):
    keys = spark.range(1, 201).withColumnRenamed("id", "k")
    checks = generate.self_check(generate.stores(spark), generate.products(spark), generate.customers(spark),
                                 generate.purchases(keys, "k"))
    assert all(r["ok"] for r in checks.collect())
    p = generate.purchases(keys, "k")
    r = p.select(F.min(F.size("items")), F.max(F.size("items"))).first()
    assert (r[0], r[1]) == (1, 3)
    assert p.where(F.abs(F.col("total_amount") - F.round(F.aggregate("items", F.lit(0.0),
                                                                    lambda a, x: a + x["total_price"]), 2)) > 1e-9
                   ).count() == 0


def test_feature_columns_fixed():
    assert len(C.FEATURE_COLUMNS) == 30 and len(set(C.FEATURE_COLUMNS)) == 30


def test_one_pretty_printed_document_a_file(spark, tmpdir_path):
    import json
    docs = [{"store_id": f"store-{i:03d}", "location": {"city": "A\nB" if i else None}} for i in range(5)]
    for i, d in enumerate(docs):
        with open(f"{tmpdir_path}/{i}.json", "w", encoding="utf-8") as f:
            f.write(json.dumps(d, indent=2))
    got = documents.read_documents(spark, tmpdir_path, DataType.fromDDL("store_id string, location struct<city: string>"), file_column="file")
    rows = sorted(got.collect(), key=lambda r: r["file"])
    assert [{"store_id": r.store_id, "location": {"city": r.location.city}} for r in rows] == docs


def test_published_topics_hold_the_documents(spark, tmpdir_path):
    df = spark.createDataFrame([(("c1", None),), (("c2", 'say "x"'),)], "doc struct<customer_id: string, note: string>")
    paths = documents.publish_topics({"customers": documents.publish(df)}, f"{tmpdir_path}/topics")
    assert sorted(r.value for r in spark.read.text(paths["customers"]).collect()) == ['{"customer_id":"c1","note":null}', '{"customer_id":"c2","note":"say \\"x\\""}']
