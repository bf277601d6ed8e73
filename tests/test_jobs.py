"""End-to-end jobs on the smallest driver data: topic → RAW/MART → quality
log → feature export."""

from conftest import SF
from pyspark.sql import functions as F

from basketflow import config as C
from basketflow.plans import jobs, tables
from basketflow.session import scratch_path


def test_pipeline_end_to_end(spark):
    raw_dir, mart_dir, ck = scratch_path(spark, "j-raw"), scratch_path(spark, "j-mart"), scratch_path(spark, "j-ck")
    for e in ("stores", "products", "customers", "purchases"):
        topic = scratch_path(spark, f"j-topic-{e}")
        tables.messages(spark, SF, e).select(F.col("payload").alias("value")).write.mode("overwrite").text(topic)
        jobs.ingest_job(spark, topic, e, raw_dir, mart_dir, ck)
    # purchase lines come from the purchases RAW table
    items_topic_raw = spark.read.parquet(f"{raw_dir}/purchases_raw")
    from basketflow.operators import mart as M, raw as R
    items_raw = R.raw_purchase_items(items_topic_raw)
    items_raw.write.mode("overwrite").parquet(f"{raw_dir}/purchase_items_raw")
    M.mart_purchase_items(items_raw, C.DRIVER_AS_OF).write.mode("overwrite").parquet(f"{mart_dir}/purchase_items_mart")
    n_msgs = tables.messages(spark, SF, "purchases").count()
    assert spark.read.parquet(f"{raw_dir}/purchases_raw").count() == n_msgs

    log = scratch_path(spark, "j-log")
    snap = jobs.quality_job(spark, raw_dir, log, "2024-01-01 00:00:00")
    assert snap.count() == 5
    assert spark.read.parquet(log).count() == 5

    out = scratch_path(spark, "j-out")
    audit = jobs.feature_job(spark, mart_dir, out, "1996-01-01 00:00:00", C.DRIVER, parquet=True).first()
    assert audit["status"] == "uploaded" and audit["size_bytes"] > 1024
    m = spark.read.parquet(f"{out}/parquet/analytic_result_1996_01_01")
    assert len(m.columns) == 31 and m.count() > 0
