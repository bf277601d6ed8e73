"""End-to-end jobs: what a scheduler runs.

    python -m basketflow.plans.jobs features --mart DIR --out DIR --as-of "2025-07-10 12:00:00" [--parquet]
    python -m basketflow.plans.jobs quality  --raw DIR --log DIR --event-time "..."
    python -m basketflow.plans.jobs ingest   --topic DIR --entity purchases --raw DIR --mart DIR

MART/RAW tables are Parquet datasets named after the entity (``purchases_mart``,
``purchases_raw`` …).  Each job reads whole tables, writes its outputs and
returns a small audit row; none collects data to the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import features, latest, mart, quality
from ..session import get_spark
from ..sources import exports
from ..streaming import ingest

MART_TABLES = {"customers": "customers_mart", "purchases": "purchases_mart", "products": "products_mart",
               "purchase_items": "purchase_items_mart"}
RAW_TABLES = {"stores": "stores_raw", "products": "products_raw", "customers": "customers_raw",
              "purchases": "purchases_raw", "purchase_items": "purchase_items_raw"}


def read_mart(spark: SparkSession, mart_dir: str, entity: str, final: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{mart_dir.rstrip('/')}/{MART_TABLES[entity]}")
    return latest.latest_mart(entity, df) if final else df


def feature_job(spark: SparkSession, mart_dir: str, out_dir: str, as_of: str,
                profile: C.FeatureProfile = C.RETAIL, parquet: bool = False, prefix: str = "",
                single_file: bool = False) -> DataFrame:
    """MART → feature matrix → dated CSV (and optionally Parquet) → export
    check over the whole written file → audit row."""
    t = {e: read_mart(spark, mart_dir, e) for e in MART_TABLES}
    m = features.feature_matrix(t["customers"], t["purchases"], t["products"], t["purchase_items"], as_of, profile)
    run_date = dt.datetime.fromisoformat(as_of).date()
    # materialise once (shared by the CSV, the Parquet copy and the check)
    stage = exports.write_parquet(m, out_dir, run_date, prefix=f"{prefix}/_stage" if prefix else "_stage")
    m = spark.read.parquet(stage)
    path = exports.write_csv(m, out_dir, run_date, prefix, single_file=single_file)
    if parquet:
        exports.write_parquet(m, out_dir, run_date, prefix)
    check = exports.check_export(exports.read_export(spark, path))
    if not check.first()["ok"]:
        raise RuntimeError(f"feature export failed its check: {path}")
    return exports.audit(spark, path)


def quality_job(spark: SparkSession, raw_dir: str, log_dir: str, event_time: str) -> DataFrame:
    """RAW → one quality snapshot (all entities) appended to the log."""
    fields = {}
    for e, name in RAW_TABLES.items():
        r = spark.read.parquet(f"{raw_dir.rstrip('/')}/{name}")
        fields[e] = r if e == "purchase_items" else mart.FIELDS[e](r)
    snap = quality.snapshot(fields, event_time)
    quality.append_snapshot(snap, log_dir)
    return snap


def ingest_job(spark: SparkSession, topic_dir: str, entity: str, raw_dir: str, mart_dir: str, checkpoints: str):
    """One availableNow run: topic → RAW table and topic → MART table, each
    with its own checkpoint, so a restart resumes after the last commit."""
    msgs = ingest.read_topic(spark, topic_dir)
    q1 = ingest.write_parquet(ingest.to_raw(msgs, entity), f"{raw_dir}/{RAW_TABLES[entity]}",
                              f"{checkpoints}/raw-{entity}")
    ingest.run_available(q1)
    if entity in MART_TABLES or entity == "stores":
        raw_stream = spark.readStream.schema(spark.read.parquet(f"{raw_dir}/{RAW_TABLES[entity]}").schema) \
            .parquet(f"{raw_dir}/{RAW_TABLES[entity]}")
        src = raw_stream if entity == "purchase_items" else raw_stream.select("payload", "ingested_at")
        name = MART_TABLES.get(entity, f"{entity}_mart")
        q2 = ingest.write_parquet(ingest.to_mart(src, entity), f"{mart_dir}/{name}", f"{checkpoints}/mart-{entity}")
        ingest.run_available(q2)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="basketflow.plans.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    f = sub.add_parser("features")
    f.add_argument("--mart", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--as-of", required=True)
    f.add_argument("--profile", default="retail", choices=list(C.PROFILES))
    f.add_argument("--parquet", action="store_true")
    f.add_argument("--prefix", default="")
    f.add_argument("--single-file", action="store_true")
    q = sub.add_parser("quality")
    q.add_argument("--raw", required=True)
    q.add_argument("--log", required=True)
    q.add_argument("--event-time", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--topic", required=True)
    i.add_argument("--entity", required=True, choices=list(RAW_TABLES))
    i.add_argument("--raw", required=True)
    i.add_argument("--mart", required=True)
    a = ap.parse_args(argv)
    spark = get_spark(f"basketflow-{a.job}")
    if a.job == "features":
        feature_job(spark, a.mart, a.out, a.as_of, C.PROFILES[a.profile], a.parquet, a.prefix, a.single_file).show()
    elif a.job == "quality":
        quality_job(spark, a.raw, a.log, a.event_time).show()
    else:
        from ..session import checkpoint_dir
        ingest_job(spark, a.topic, a.entity, a.raw, a.mart, checkpoint_dir(spark).rstrip("/") + "/streams")


if __name__ == "__main__":
    main()
