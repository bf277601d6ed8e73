"""Quality counters kept by a stream, so that a snapshot reads sums instead of all RAW rows.

Two queries per entity follow the RAW fields: one counts rows and valid rows of each micro-batch, the other
lets every id through once (a state store keyed by id) and counts those that are new. Both write one small
row under the batch's number and overwrite it if the batch is replayed, so a batch costs its own rows
only and counts once. When both have caught up, the sums equal a recount of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import predicates as P
from ..operators import quality
from ..operators.mart import NORMALIZE, as_of_col
from .alerts import STORE


def _counted(path: str, kind: str, entity: str, *aggregates):
    """A micro-batch's aggregates as one row at the batch's own place."""
    def write(batch: DataFrame, number: int) -> None:
        batch.agg(*aggregates).coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}/entity={entity}/batch={number}")
    return write


def count_stream(entity: str, fields: DataFrame, path: str, checkpoint: str, as_of, ids: C.IdPatterns = C.RETAIL_IDS, available_now: bool = True) -> list:
    """Starts both queries over a stream of the entity's raw ``fields``; counters go to ``path``."""
    fields.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = NORMALIZE[entity](fields).select(P.is_valid(entity, as_of_col(as_of), ids).alias("valid"), quality.dup_key(entity).alias("id"))
    parts = {
        "rows": (rows, [F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid")]),
        "ids": (rows.where("id IS NOT NULL").select("id").dropDuplicates(["id"]), [F.count(F.lit(1)).alias("ids")]),
    }
    started = []
    for kind, (stream, aggregates) in parts.items():
        w = stream.writeStream.foreachBatch(_counted(path, kind, entity, *aggregates)).option("checkpointLocation", f"{checkpoint}/{kind}-{entity}")
        started.append((w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start())
    return started


def kept_snapshot(spark: SparkSession, path: str, event_time) -> DataFrame:
    """The quality rows of all counted entities from the kept counters: one row a batch is read."""
    rows = spark.read.schema("total long, valid long, entity string, batch long").parquet(f"{path}/rows").groupBy("entity").agg(F.sum("total").alias("total"), F.sum("valid").alias("valid"))
    ids = spark.read.schema("ids long, entity string, batch long").parquet(f"{path}/ids").groupBy("entity").agg(F.sum("ids").alias("ids"))
    both = rows.join(ids, "entity", "left")
    return quality.counters(both.withColumn("ids", F.coalesce("ids", F.lit(0))), F.col("entity"), as_of_col(event_time), "total", "valid", "ids")
