"""Inputs that the driver tables don't hold: corrected replays, partial documents, times without a date, PII outside
the schema, cooldown islands."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.functions.norm import iso_ts
from basketflow.operators import alerts, imports, pii
from basketflow.session import scratch_path
from basketflow.sources import documents


def _batch(spark, rows, batch="b"):
    df = spark.createDataFrame(rows, "row_number long, j string").select("row_number", F.parse_json("j").alias("row"))
    v = imports.validate(df, "stores")
    return imports.summary(v, batch, "stores"), imports.row_errors(v, batch), imports.staging(v, batch, "stores")


def test_corrected_replay_leaves_no_stale_rows(spark):
    out = scratch_path(spark, "t-imports")
    first = _batch(spark, [(1, '{"store_id": "a"}'), (2, '{"x": 1}')])
    imports.write_batch(out, *first)
    assert imports.live_rows(spark, out, "errors", first[1].schema).count() == 1
    fixed = _batch(spark, [(1, '{"store_id": "a"}'), (2, '{"store_id": "b"}')])
    imports.write_batch(out, *fixed, replay=True)
    assert imports.live_rows(spark, out, "errors", fixed[1].schema).count() == 0
    assert imports.live_rows(spark, out, "staging", fixed[2].schema).count() == 2
    failed = imports.failed_batch(spark, "b", "stores", "BROKEN", "unreadable")
    imports.write_batch(out, *failed, replay=True)
    assert imports.live_rows(spark, out, "staging", fixed[2].schema).count() == 0
    assert [r["replay_count"] for r in spark.read.parquet(f"{out}/batches").collect()] == [2]


def test_all_errors_are_kept_whole(spark):
    rows = [(i, '{"x": "' + "y" * 1500 + '"}') for i in range(700)]
    got = _batch(spark, rows)[1].collect()
    assert len(got) == 700 and all(len(r["raw_fragment"]) > 1500 for r in got)


def test_upsert_adds_fields_and_merges_partial_documents(spark):
    old = spark.createDataFrame([("k", "old", 1), ("z", "kept", 2)], "id string, name string, v int")
    new = spark.createDataFrame([("k", "first", None, None, 1), ("k", None, 9, "e", 2)], "id string, name string, v int, extra string, at int")
    merged, counts = documents.upsert(old, new, "id", order="at")
    got = {r["id"]: (r["name"], r["v"], r["extra"]) for r in merged.collect()}
    assert got == {"k": ("first", 9, "e"), "z": ("kept", 2, None)}
    assert tuple(counts.first()) == (2, 0, 1)


def test_upsert_carried_null_replaces(spark):
    old = spark.createDataFrame([("k", "old", 1)], "id string, name string, v int")
    new = spark.createDataFrame([("k", None, None, ["name"])], "id string, name string, v int, fields array<string>")
    merged, counts = documents.upsert(old, new, "id", carried="fields")
    assert [tuple(r) for r in merged.collect()] == [("k", None, 1)] and counts.first()["updated"] == 1


def test_upsert_without_key_fails(spark):
    new = spark.createDataFrame([(None, "x")], "id string, name string")
    with pytest.raises(Exception, match="no id"):
        documents.upsert(new.limit(0), new, "id")[0].collect()


def test_times_need_a_date(spark):
    texts = ["12:30", "T10:00", "2025", "2025-01", "20250101", "2025-02-30", "2025-07-10", "2025-07-10T12:00:00Z", "2025-07-10 12:00:00.5", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(iso_ts("t")).collect()]
    assert [x is None for x in got] == [True] * 6 + [False] * 3 + [True] * 2
    assert got[7] == dt.datetime(2025, 7, 10, 12)


SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("email", T.StringType()),
    T.StructField("place", T.StructType([T.StructField("city", T.StringType())])),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType())])))])


@pytest.mark.parametrize("text, path", [
    ('{"customer_id": "a", "ssn": 1}', "ssn"), ('[1]', pii.NOT_AN_OBJECT), ('{broken', pii.NOT_AN_OBJECT), ('5', pii.NOT_AN_OBJECT),
    ('{"place": {"zip": 1}}', "place.zip"), ('{"place": "text"}', "place"), ('{"tags": [{"n": 1}, {"m": 2}]}', "tags[].m")])
def test_pii_guard_judges_every_row(spark, text, path):
    df = spark.createDataFrame([('{"customer_id": "a", "email": "x@y.z", "place": {"city": "c"}, "tags": [{"n": 1}]}',), ('{"place": null}',), (text,)], "payload string")
    assert pii.unknown_fields(df, "payload", SCHEMA) == [path]
    with pytest.raises(pii.UnknownFieldsError):
        pii.hash_json_documents(df, "payload", SCHEMA, "a-salt-of-sixteen-or-more")


def test_cooldown_restarts_at_fired_snapshots(spark):
    t = dt.datetime(2025, 1, 1)
    minutes = [0, 10, 16, 20, 31, 33, 100, 101]
    ratios = [0.9, 0.9, 0.9, 0.1, 0.9, 0.9, 0.9, None]
    log = spark.createDataFrame([("a", t + dt.timedelta(minutes=m), r) for m, r in zip(minutes, ratios)] + [("b", t, 0.9)], "entity string, event_time timestamp, duplicates_ratio double")
    got = {(r["entity"], r["event_time"]): r["fired"] for r in alerts.replay(log, 0.5, 15).collect()}
    assert [got["a", t + dt.timedelta(minutes=m)] for m in minutes] == [1, 0, 1, 0, 0, 1, 1, 0] and got["b", t] == 1
