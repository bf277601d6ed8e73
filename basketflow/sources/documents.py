"""Document sources and sinks: JSON document folders, keyed upsert into a
document collection, stream publishing (plain and enveloped), table scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ENTITY_KEYS = {"stores": "store_id", "products": "id", "customers": "customer_id", "purchases": "purchase_id"}


def read_documents(spark: SparkSession, path: str, schema: T.StructType, one_per_file: bool = True, file_column: str | None = None) -> DataFrame:
    """A folder of JSON documents with a declared schema (no inference pass).
    ``one_per_file``: each file holds one (possibly pretty-printed) object,
    read whole per file; otherwise JSON Lines, split across tasks. ``file_column`` adds each document's file
    path, by which a later document of a key is told from an earlier one (files count in name order)."""
    r = spark.read.schema(schema).option("mode", "PERMISSIVE")
    if one_per_file:
        r = r.option("multiLine", "true")
    docs = r.json(path)
    return docs.select("*", F.col("_metadata.file_path").alias(file_column)) if file_column else docs


def publish(docs: DataFrame, doc_col: str = "doc", drop=("_id",)) -> DataFrame:
    """Documents → stream messages: JSON text with nulls kept, store-side
    ``_id`` dropped."""
    d = F.col(doc_col)
    st = docs.schema[doc_col].dataType
    if isinstance(st, T.StructType) and any(f.name in drop for f in st.fields):
        d = d.dropFields(*[f for f in drop if f in st.fieldNames()])
    return docs.select(F.to_json(d, {"ignoreNullFields": "false"}).alias("value"))


def publish_topics(topics: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Writes each topic's messages, one JSON text a line, to a folder of its own; topic → folder."""
    paths = {name: f"{folder}/{name}" for name in topics}
    for name, messages in topics.items():
        messages.select("value").write.text(paths[name])
    return paths


def publish_counts(topics: dict[str, DataFrame]) -> DataFrame:
    """Messages per topic (entity)."""
    out = None
    for name, df in topics.items():
        one = df.select(F.lit(name).alias("topic"), F.count(F.lit(1)).alias("messages"))
        out = one if out is None else out.unionByName(one)
    return out


def envelope(docs: DataFrame, entity: str, event_ts, doc_col: str = "doc") -> DataFrame:
    """Keyed envelope message: key = object id; value =
    ``{source, object_id, payload (JSON text), event_ts}``."""
    key_field = ENTITY_KEYS.get(entity)
    d = F.col(doc_col)
    oid = F.coalesce(d.getField(key_field).cast("string"), F.lit("")) if key_field else F.lit("")
    ts = F.date_format(F.lit(str(event_ts)).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.to_json(d, {"ignoreNullFields": "false"})
    return docs.select(oid.alias("key"), F.lit(entity).alias("source"), oid.alias("object_id"),
                       payload.alias("payload"), ts.alias("event_ts"))


def unwrap_envelope(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Envelope messages → the plain messages the RAW extractors expect."""
    s = "struct<source:string,object_id:string,payload:string,event_ts:string>"
    e = F.from_json(F.col(value_col), s)
    return messages.select(e.getField("payload").alias("payload"),
                           F.try_to_timestamp(e.getField("event_ts")).alias("ingested_at"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None,
           carried: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keyed upsert, field by field.

    A field that an incoming document carries replaces the stored one, all others keep their value;
    unknown keys and unknown fields are added. ``carried`` names a column with the array of fields a
    document carries, so that a carried null replaces a value; without it, non-null fields are
    carried. Of several documents for one key, each field comes from the last (by ``order``, else the
    greatest value) that carries it. A document without the key fails the job.

    Returns (collection, counts): counts = processed / inserted / updated (matched and changed). Both
    sides meet in one full join on the key, after a partial aggregation of the incoming documents."""
    control = {key, carried}
    new = [c for c in incoming.columns if c not in control]
    stored_fields = [c for c in existing.columns if c != key]
    fields = stored_fields + [c for c in new if c not in stored_fields]
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"an incoming document has no {key}"))).otherwise(F.col(key))
    last = {}
    for c in new:
        has = F.array_contains(carried, c) if carried else F.col(c).isNotNull()
        by = F.col(order) if order else F.col(c)
        # nulls of max_by's ordering are skipped: only documents that carry the field compete
        rank = F.when(has, F.struct(by.isNotNull().alias("known"), by.alias("by")))
        last[c] = F.max_by(F.struct(F.col(c).alias("v")), rank)
    inc = incoming.withColumn(key, checked).groupBy(key).agg(*[x.alias(f"_n_{c}") for c, x in last.items()], F.count(F.lit(1)).alias("_cnt"))
    old = existing.withColumn("_old", F.lit(True))
    both = old.join(inc, key, "full_outer")
    merged, changed = [], F.lit(False)
    for c in fields:
        was = F.col(c) if c in stored_fields else F.lit(None).cast(incoming.schema[c].dataType)
        if c in new:
            now = F.when(F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}.v")).otherwise(was)
            changed = changed | ~now.eqNullSafe(was)
            was = now
        merged.append(was.alias(c))
    out = both.select(key, *merged, "_old", "_cnt", changed.alias("_changed"))
    counts = out.agg(
        F.coalesce(F.sum("_cnt"), F.lit(0)).alias("processed"),
        F.count_if(F.col("_cnt").isNotNull() & F.col("_old").isNull()).alias("inserted"),
        F.count_if(F.col("_cnt").isNotNull() & F.col("_old") & F.col("_changed")).alias("updated"),
    )
    return out.select(key, *fields), counts


def replace_collection(docs: DataFrame, path: str) -> None:
    """Delete all + insert: an overwrite of the collection's dataset."""
    docs.write.mode("overwrite").parquet(path)


def table_scan(spark: SparkSession, name: str, base_dir: str | None = None, jdbc: dict | None = None,
               columns: list[str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Scan a named table.  Parquet by default (columns and filters pushed into
    the scan); with ``jdbc`` options a JDBC read, split into ``partition`` =
    (column, lower, upper, num_partitions) parallel range queries instead of
    one single-connection scan."""
    if jdbc:
        r = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
        if partition:
            col, lo, hi, n = partition
            r = r.option("partitionColumn", col).option("lowerBound", lo).option("upperBound", hi) \
                .option("numPartitions", n)
        df = r.load()
    else:
        df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
