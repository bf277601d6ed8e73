"""Structured Streaming: topic messages → RAW → MART.

Every RAW/MART transform is stateless (projection + filter + array join), so
the batch functions run unchanged on a streaming DataFrame; no watermark is
needed because no operator keeps event-time state.  "Current" MART state is
the read-time ``latest_by_key`` (plus ``compact_latest`` as a batch rewrite).

Sources are files here (one JSON message per line, a folder per topic) so
jobs run without a broker; with a broker, ``read_topic(..., kafka=...)``
reads the Kafka topic's ``value`` instead.  Sinks append Parquet with a
checkpoint under the shared checkpoint folder, so a restarted or
re-scheduled job resumes exactly where the last committed micro-batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import mart, raw

MESSAGE_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def read_topic(spark: SparkSession, path: str, kafka: dict | None = None, max_files: int | None = None) -> DataFrame:
    """A stream of messages as (payload, ingested_at): arrival time is the
    processing time of the micro-batch, as an insert-time ``now()``."""
    if kafka:
        s = spark.readStream.format("kafka").options(**kafka).load()
        s = s.select(F.col("value").cast("string").alias("value"))
    else:
        r = spark.readStream.schema(MESSAGE_SCHEMA).format("text")
        if max_files:
            r = r.option("maxFilesPerTrigger", str(max_files))
        s = r.load(path)
    return s.select(F.col("value").alias("payload"), F.current_timestamp().alias("ingested_at"))


def read_stamped(spark: SparkSession, path: str) -> DataFrame:
    """Messages that carry their own arrival time: JSON lines of
    ``{"payload": "...", "ingested_at": "..."}`` (replays, tests)."""
    schema = T.StructType([T.StructField("payload", T.StringType()), T.StructField("ingested_at", T.TimestampType())])
    return spark.readStream.schema(schema).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A written table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def to_raw(messages: DataFrame, entity: str) -> DataFrame:
    if entity == "purchase_items":
        return raw.raw_purchase_items(raw.raw_purchases(messages, keep_doc=True))
    return raw.RAW[entity](messages)


def to_mart(raw_stream: DataFrame, entity: str, as_of=None, ids: C.IdPatterns = C.RETAIL_IDS) -> DataFrame:
    """RAW rows → valid MART rows.  ``as_of=None`` judges "not in the future"
    against each row's arrival time, as an insert-time view does."""
    when = F.col("ingested_at") if as_of is None else as_of
    if entity == "purchase_items":
        return mart.mart("purchase_items", raw_stream, when, ids)
    return mart.mart(entity, mart.FIELDS[entity](raw_stream), when, ids)


def write_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, name: str | None = None):
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(path)


def run_available(q) -> None:
    """Drain an ``availableNow`` query and surface its failure, if any."""
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
