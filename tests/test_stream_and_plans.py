"""Stream = batch equality and plan-shape checks on the driver tables."""

import tempfile

from conftest import SF
from pyspark.sql import functions as F

from basketflow import config as C
from basketflow.operators import features, mart
from basketflow.plans import tables
from basketflow.session import scratch_path
from basketflow.streaming import ingest


def test_stream_mart_equals_batch(spark):
    msgs = tables.messages(spark, SF, "purchases")
    topic = scratch_path(spark, "t-topic")
    msgs.write.mode("overwrite").json(topic)
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    q = ingest.write_parquet(ingest.to_mart(ingest.read_stamped(spark, topic), "purchases", C.DRIVER_AS_OF), out, ck)
    ingest.run_available(q)
    streamed = spark.read.parquet(out).drop("payload")
    batch = mart.mart("purchases", mart.purchase_fields(msgs), C.DRIVER_AS_OF).drop("payload")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_message_parsed_once(spark):
    df = mart.mart("purchases", tables.payload_fields(spark, SF, "purchases"), C.DRIVER_AS_OF)
    df.write.format("noop").mode("overwrite").save()
    assert _plan(df).count("parseJson") == 1


def test_feature_joins_reuse_aggregate_partitioning(spark):
    """The two left joins on customer_id add no exchange: every side is
    already hash-partitioned by customer_id by its own aggregation."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c, p, pr, i = (tables.mart_table(spark, SF, e) for e in ("customers", "purchases", "products",
                                                                 "purchase_items"))
        base = features.customers_base(c)
        pa = features.purchase_agg(features.purchase_flags(p, C.DRIVER_AS_OF, C.DRIVER))
        ia = features.item_agg(features.item_flags(features.items_enriched(i, pr), C.DRIVER_AS_OF, C.DRIVER))
        joined = features.assemble(base, pa, ia, C.DRIVER)
        parts = [_plan(x).count("Exchange hashpartitioning") for x in (base, pa, ia, joined)]
        assert parts[3] == parts[0] + parts[1] + parts[2]
        # no broadcast hint on anything that grows with the data
        assert "BroadcastExchange" not in _plan(joined)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["customer_id"] + C.FEATURE_COLUMNS
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
