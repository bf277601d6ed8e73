"""Managed imports: validate rows, keep row errors and staged valid rows.

Input rows are ``(row_number, row: variant)``.  A row must be a JSON object
(or CSV record) and carry a non-blank value for each required field group of
its entity (products: ``product_id`` or ``id``).  Blank means NULL, missing
or whitespace-only text; any non-null non-string value counts as present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.norm import strip_ws


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(row: Column, name: str) -> Column:
    return F.try_variant_get(row, f"$['{name}']", "variant")


def _present(row: Column, name: str) -> Column:
    v = _field(row, name)
    k = _kind(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull() | (k == "VOID"), F.lit(False)).when(
        k == "STRING", F.length(strip_ws(text)) > 0).otherwise(F.lit(True))


def _as_text(row: Column, name: str) -> Column:
    v = _field(row, name)
    k = _kind(v)
    return (F.when(k == "STRING", strip_ws(F.try_variant_get(v, "$", "string")))
            .when(k == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
            .otherwise(F.to_json(v)))


def validate(rows: DataFrame, entity: str) -> DataFrame:
    """Adds ``errors: array<struct<field_name, error_code, message>>``
    (empty for a valid row) and ``business_key``."""
    groups = C.IMPORT_REQUIRED_FIELDS.get(entity, ())
    row = F.col("row")
    is_obj = _kind(row).startswith("OBJECT")
    errs = []
    for g in groups:
        label = " / ".join(g)
        ok = F.lit(False)
        for name in g:
            ok = ok | _present(row, name)
        errs.append(F.when(is_obj & ~ok, F.struct(
            F.lit(label).alias("field_name"), F.lit("required_field_missing").alias("error_code"),
            F.lit(f"{label} is required").alias("message"))))
    not_obj = F.when(~is_obj | row.isNull(), F.struct(
        F.lit("").alias("field_name"), F.lit("invalid_row_type").alias("error_code"),
        F.lit("a row is a JSON object or a CSV record").alias("message")))
    errors = F.when(~is_obj | row.isNull(), F.array(not_obj)).otherwise(F.array_compact(F.array(*errs))) \
        if errs else F.array_compact(F.array(not_obj))
    key = None
    for g in groups:
        for name in g:
            k = F.when(_present(row, name), _as_text(row, name))
            key = k if key is None else F.coalesce(key, k)
    return rows.select("*", errors.alias("errors"),
                       (key if key is not None else F.lit(None).cast("string")).alias("business_key"))


def row_errors(validated: DataFrame, batch_id: str) -> DataFrame:
    """One row per error, with the whole row as JSON text."""
    e = validated.where(F.size("errors") > 0).select(
        F.lit(batch_id).alias("batch_id"), F.greatest(F.col("row_number"), F.lit(0)).alias("row_number"),
        F.explode("errors").alias("_e"), F.to_json("row").alias("raw_fragment"))
    return e.select("batch_id", "row_number", F.col("_e.field_name").alias("field_name"),
                    F.col("_e.error_code").alias("error_code"), F.col("_e.message").alias("message"),
                    "raw_fragment")


def staging(validated: DataFrame, batch_id: str, entity: str) -> DataFrame:
    return validated.where(F.size("errors") == 0).select(
        F.lit(batch_id).alias("batch_id"), F.lit(entity).alias("entity_type"),
        F.greatest(F.col("row_number"), F.lit(0)).alias("row_number"), "business_key",
        F.to_json("row").alias("payload"))


def summary(validated: DataFrame, batch_id: str, entity: str, file_name: str = "", file_format: str = "") -> DataFrame:
    """total/valid/invalid/staged and the batch status: ``failed`` without
    rows or without a valid row, ``partial`` with some invalid rows, else
    ``success``."""
    a = validated.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.count_if(F.size("errors") == 0).alias("valid_rows"))
    total, valid = F.col("total_rows"), F.col("valid_rows")
    status = (F.when(total == 0, "failed").when(valid == 0, "failed")
              .when(total - valid > 0, "partial").otherwise("success"))
    msg = (F.when(total == 0, "the file has no data rows")
           .when(valid == 0, "no row passed validation"))
    return a.select(F.lit(batch_id).alias("batch_id"), F.lit(entity).alias("entity_type"),
                    F.lit(file_name).alias("file_name"), F.lit(file_format).alias("file_format"),
                    status.alias("status"), total.cast("long").alias("total_rows"),
                    valid.cast("long").alias("valid_rows"), (total - valid).cast("long").alias("invalid_rows"),
                    valid.cast("long").alias("staged_rows"), msg.alias("error_message"))


def failed_batch(spark, batch_id: str, entity: str, code: str, message: str, file_name: str = "",
                 file_format: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A read error: no staging, one error row (row 0), total 0, invalid 1."""
    s = spark.createDataFrame(
        [(batch_id, entity, file_name, file_format, "failed", 0, 0, 1, 0, message)],
        "batch_id string, entity_type string, file_name string, file_format string, status string, "
        "total_rows long, valid_rows long, invalid_rows long, staged_rows long, error_message string")
    e = spark.createDataFrame([(batch_id, 0, "", code.lower(), message, None)],
                              "batch_id string, row_number long, field_name string, error_code string, "
                              "message string, raw_fragment string")
    st = spark.createDataFrame([], "batch_id string, entity_type string, row_number long, business_key string, "
                                   "payload string")
    return s, e, st


def run_batch(spark, path: str, batch_id: str, entity: str, file_name: str | None = None):
    """Whole import of one uploaded file → (summary, errors, staging)."""
    from ..sources.imports import ImportError_, detect_format, read_import

    name = file_name or path.rsplit("/", 1)[-1]
    try:
        fmt = detect_format(name)
        rows = read_import(spark, path, name)
    except ImportError_ as exc:
        fmt = C.IMPORT_FORMATS.get("." + name.rsplit(".", 1)[-1].lower(), "") if "." in name else ""
        return failed_batch(spark, batch_id, entity, exc.code, exc.message, name, fmt)
    v = validate(rows, entity)
    return summary(v, batch_id, entity, name, fmt), row_errors(v, batch_id), staging(v, batch_id, entity)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _create_new(spark, path: str) -> bool:
    """Creates an empty file; False if it is there already, also if another writer was faster."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    return fs.createNewFile(p)


def claim_attempt(spark, out_dir: str, batch_id: str) -> int:
    """The number of a new attempt at a batch (from 1), which no other replay can get."""
    last = None
    if _exists(spark, f"{out_dir}/batches"):
        last = spark.read.parquet(f"{out_dir}/batches").where(F.col("batch_id") == batch_id).agg(F.max("replay_count")).first()[0]
    attempt = (last or 0) + 1
    while not _create_new(spark, f"{out_dir}/attempts/{batch_id}/{attempt}"):
        attempt += 1
    return attempt


def write_batch(out_dir: str, summary_df: DataFrame, errors_df: DataFrame, staging_df: DataFrame,
                replay: bool = False) -> None:
    """Persist one attempt at a batch. Errors and staging are appended under the attempt's number, in files of
    successive row numbers with an index of them, and the batch row, written last, names the live attempt: a
    replay that finds nothing, or fails on the way, leaves no old row live and hides none of the rows that
    still are."""
    spark = summary_df.sparkSession
    batch = summary_df.first()  # one row
    attempt = claim_attempt(spark, out_dir, batch["batch_id"]) if replay else 0
    for name, df in (("errors", errors_df), ("staging", staging_df)):
        rows = df.withColumn("attempt", F.lit(attempt)).repartitionByRange("row_number").sortWithinPartitions("row_number")
        rows.write.mode("append").partitionBy("batch_id", "attempt").parquet(f"{out_dir}/{name}")
        _write_index(spark, out_dir, name, batch["batch_id"], attempt)
    spark.createDataFrame([batch], summary_df.schema).withColumn("replay_count", F.lit(attempt)) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out_dir}/batches")


INDEX = "first_row long, last_row long, rows long, batch_id string, attempt int"


def _write_index(spark, out_dir: str, name: str, batch_id: str, attempt: int) -> None:
    """One row for each file of the attempt: its row numbers and how many rows it has."""
    path = f"{out_dir}/{name}/batch_id={batch_id}/attempt={attempt}"
    if not _exists(spark, path):  # no rows
        return
    files = spark.read.schema("row_number long").parquet(path).groupBy(F.input_file_name().alias("file")).agg(
        F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"), F.count(F.lit(1)).alias("rows"))
    files.drop("file").withColumns({"batch_id": F.lit(batch_id), "attempt": F.lit(attempt)}).coalesce(1) \
        .write.mode("append").partitionBy("batch_id", "attempt").parquet(f"{out_dir}/{name}_index")


def stored_page(spark, out_dir: str, name: str, batch_id: str, schema, limit: int, max_limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """Rows ``offset`` to ``offset + limit`` (1..max_limit) of a batch's live ``errors`` or ``staging`` by row number,
    and how many there are. The total comes from the index, and only files that the page touches are opened."""
    if not 1 <= int(limit) <= max_limit or offset < 0:
        raise ValueError(f"limit must be 1 to {max_limit}")
    batch = spark.read.parquet(f"{out_dir}/batches").where(F.col("batch_id") == batch_id).select("replay_count").first()
    none = spark.createDataFrame([], schema)
    if batch is None or not _exists(spark, f"{out_dir}/{name}_index"):
        return none, 0
    attempt = batch["replay_count"]
    index = spark.read.schema(INDEX).parquet(f"{out_dir}/{name}_index").where((F.col("batch_id") == batch_id) & (F.col("attempt") == attempt))
    # one row a file of one batch
    order = Window.orderBy("first_row", "last_row")
    index = index.select("first_row", "last_row", "rows", (F.sum("rows").over(order) - F.col("rows")).alias("before"))
    touched = (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)
    at = index.agg(F.sum("rows").alias("total"), F.min(F.when(touched, F.col("first_row"))).alias("low"), F.max(F.when(touched, F.col("last_row"))).alias("high"),
                   F.min(F.when(touched, F.col("before"))).alias("before")).first()
    if at["low"] is None:
        return none, at["total"] or 0
    path = f"{out_dir}/{name}"
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("attempt", T.IntegerType())])).parquet(path)
    rows = rows.where((F.col("batch_id") == batch_id) & (F.col("attempt") == attempt) & F.col("row_number").between(at["low"], at["high"]))
    rest = [c for c in schema.names if c != "row_number"]
    page = rows.orderBy("row_number", *rest).offset(offset - at["before"]).limit(int(limit))
    return page.select(*schema.names), at["total"]


def replay_batch(spark, out_dir: str, path: str, batch_id: str, entity: str, file_name: str | None = None) -> None:
    """Imports the file of a batch again and makes the new attempt live. Refused while another import or replay of the
    batch runs, and when the file is gone."""
    running = f"{out_dir}/running/{batch_id}"
    replay_allowed("running" if _exists(spark, running) else "done", _exists(spark, path))
    if not _create_new(spark, running):
        replay_allowed("running", True)
    try:
        s, e, st = run_batch(spark, path, batch_id, entity, file_name)
        write_batch(out_dir, s, e, st, replay=True)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(running)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


def live_rows(spark, out_dir: str, name: str, schema) -> DataFrame:
    """The ``errors`` or ``staging`` rows of every batch's live attempt (``schema``: their columns)."""
    batches = spark.read.parquet(f"{out_dir}/batches").select("batch_id", F.col("replay_count").alias("attempt"))
    if not _exists(spark, f"{out_dir}/{name}"):
        return spark.createDataFrame([], schema)
    path = f"{out_dir}/{name}"
    rows = spark.read.schema(T.StructType(schema.fields + [T.StructField("attempt", T.IntegerType())])).parquet(path)
    return rows.join(batches, ["batch_id", "attempt"], "left_semi").select(*schema.names)


def replay_allowed(status: str, file_exists: bool) -> None:
    """Refuse a replay while the batch is queued/running or its file is gone."""
    if status in ("queued", "running"):
        raise ImportError_("IMPORT_BUSY", "this batch is still running")
    if not file_exists:
        raise ImportError_("IMPORT_FILE_MISSING", "the uploaded file is gone")


from ..sources.imports import ImportError_  # noqa: E402  (re-export for callers)


def page(df: DataFrame, limit: int, max_limit: int) -> DataFrame:
    """The first ``limit`` (1..max_limit) rows by row number."""
    if not 1 <= int(limit) <= max_limit:
        raise ValueError(f"limit must be 1 to {max_limit}")
    return df.orderBy("row_number").limit(int(limit))
