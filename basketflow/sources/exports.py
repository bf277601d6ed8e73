"""Feature-matrix exports: CSV / Parquet sinks, the latest-export pick and
reading an export back.

The CSV sink writes a *dataset* named ``analytic_result_YYYY_MM_DD.csv``
(one part file per task, each with the header): a single-file CSV of a
matrix with one row per customer would push the final stage through one
task.  ``single_file=True`` keeps the old one-file layout for small outputs;
it first materialises the matrix as Parquet (in parallel) and only then
funnels the finished rows through one writer task, so the joins and
aggregations upstream never run in a single task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..session import scratch_path


def export_name(run_date: dt.date, ext: str = ".csv") -> str:
    return f"analytic_result_{run_date:%Y_%m_%d}{ext}"


def _join(*parts: str) -> str:
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(parts) if p)


def write_csv(matrix: DataFrame, out_dir: str, run_date: dt.date, prefix: str = "", single_file: bool = False) -> str:
    path = _join(out_dir, prefix, export_name(run_date))
    df = matrix
    if single_file:
        tmp = scratch_path(matrix.sparkSession, "export-stage")
        matrix.write.mode("overwrite").parquet(tmp)
        df = matrix.sparkSession.read.parquet(tmp).coalesce(1)
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_parquet(matrix: DataFrame, out_dir: str, run_date: dt.date, prefix: str = "") -> str:
    """Snappy Parquet under ``[prefix/]parquet/analytic_result_YYYY_MM_DD``;
    re-running the same day replaces that day's dataset (idempotent)."""
    path = _join(out_dir, prefix, "parquet", export_name(run_date, ""))
    matrix.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def list_exports(spark: SparkSession, base_dir: str) -> DataFrame:
    """Exports under ``base_dir`` whose name matches the pattern and whose
    date exists: (key, filename, file_date, last_modified).  File contents are
    not read (only the listing columns are selected)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base_dir)
             .select("path", "modificationTime"))
    # a CSV export is a folder of parts: the export name is the folder (or file) name
    name = F.regexp_extract("path", r"(analytic_result_[^/]*\.csv)(/|$)", 1)
    m = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("_dir"), "path", name.alias("filename"),
                     "modificationTime")
    pat = C.EXPORT_NAME_PATTERN
    ok = m.where(F.col("filename").rlike(C.java_anchor(pat)))
    key = F.when(F.col("path").endswith(F.concat(F.lit("/"), F.col("filename"))), F.col("path")).otherwise(F.col("_dir"))
    rows = ok.select(key.alias("key"), "filename", F.try_to_date(F.format_string(
        "%s-%s-%s", F.regexp_extract("filename", pat, 1), F.regexp_extract("filename", pat, 2),
        F.regexp_extract("filename", pat, 3)), "yyyy-MM-dd").alias("file_date"),
        F.col("modificationTime").alias("last_modified"))
    return rows.where(F.col("file_date").isNotNull()).groupBy("key", "filename", "file_date").agg(
        F.max("last_modified").alias("last_modified"))


def latest_export(exports: DataFrame) -> DataFrame:
    """The newest export by (file date, modification time, key)."""
    return exports.orderBy(F.desc("file_date"), F.desc("last_modified"), F.desc("key")).limit(1)


def to_flag(c) -> F.Column:
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return (F.when(t.isin(*C.EXPORT_FLAG_TRUE_VALUES), 1)
            .when(t.isin("0", "false", "no", "n", ""), 0)
            .when(t.try_cast("int") == 1, 1).otherwise(0)).cast("int")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export read back: BOM tolerated, header must hold ``customer_id``,
    rows with a blank id dropped, every other column coerced to 0/1."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    cols = [c.lstrip("﻿").strip() for c in df.columns]
    df = df.toDF(*cols)
    cols = [c for c in cols if c]
    if not cols:
        raise ValueError(f"no header in the export {path}")
    if "customer_id" not in cols:
        raise ValueError(f"the export {path} has no customer_id among its columns")
    feats = [c for c in cols if c != "customer_id"]
    cid = F.trim(F.coalesce(F.col("customer_id"), F.lit("")))
    return df.select(cid.alias("customer_id"), *[to_flag(F.col(f"`{c}`")).alias(c) for c in feats]) \
        .where(F.col("customer_id") != "")


def check_export(export: DataFrame, expected_columns: int = len(C.FEATURE_COLUMNS) + 1) -> DataFrame:
    """Assertion table over a whole export: column count, non-empty ids and
    0/1 values in every row."""
    feats = [c for c in export.columns if c != "customer_id"]
    bad_values = F.lit(0)
    for c in feats:
        bad_values = bad_values + F.count_if(~F.col(c).isin(0, 1) | F.col(c).isNull())
    a = export.agg(F.count(F.lit(1)).alias("rows"),
                   F.count_if(F.trim(F.coalesce("customer_id", F.lit(""))) == "").alias("blank_ids"),
                   bad_values.alias("bad_values"))
    return a.select(
        F.lit(len(export.columns)).alias("columns"),
        F.lit(len(export.columns) == expected_columns).alias("columns_ok"),
        "rows", "blank_ids", "bad_values",
        ((F.col("blank_ids") == 0) & (F.col("bad_values") == 0) & F.lit(len(export.columns) == expected_columns)
         ).alias("ok"),
    )


def export_listing(exports: DataFrame, search: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """Exports filtered by a substring of the name or date, newest first,
    paged (limit 1..200)."""
    if not 1 <= int(limit) <= 200:
        raise ValueError("limit must be 1 to 200")
    n = int(limit)
    e = exports
    if search:
        s = search.strip().lower()
        e = e.where(F.lower("filename").contains(s) | F.date_format("file_date", "yyyy-MM-dd").contains(s))
    return e.orderBy(F.desc("file_date"), F.desc("key")).offset(max(int(offset), 0)).limit(n)


def audit(spark: SparkSession, path: str, error: str | None = None) -> DataFrame:
    """One audit row for an export run: key, bytes written (from the file
    listing, contents not read), uploaded/failed, whole error text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("length")
    a = files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("size_bytes"),
                  F.count(F.lit(1)).alias("files"))
    status = "failed" if error else "uploaded"
    return a.select(F.lit(path).alias("key"), "size_bytes", "files", F.lit(status).alias("status"),
                    F.lit(error or None).cast("string").alias("error_message"))
