"""Uploaded import files → (row_number, row) with the original numbering.

* CSV: a header is required; records are numbered from 2 (the header is 1), blank
  lines are no records; a UTF-8 BOM is tolerated.
* JSON: the stripped file text is one JSON value — an array gives its
  elements numbered from 1, an object gives row 1, a scalar is an error —
  or else JSON Lines: one value per non-blank line, numbered by physical line
  of the stripped text; the first line that does not parse fails the whole
  batch, naming the line.

No file funnels through one task: arrays and quoted records are cut over byte splits
(``json_splits``, ``csv_splits``), and line numbers come from ``with_row_index``, which turns
per-(file, partition) counts into offsets (a row per file split).
"""

from __future__ import annotations

import functools
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.jsonx import strict_parse
from . import csv_splits, json_splits

#: the key of what a CSV record has beyond its header
REST = "null"
ROW_MASK = (1 << 33) - 1


class ImportError_(Exception):
    """Batch-level failure: ``code`` and ``message`` go to the batch record."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
        self.message = message


def detect_format(file_name: str) -> str:
    suffix = PurePath(file_name).suffix.lower()
    fmt = C.IMPORT_FORMATS.get(suffix)
    if not fmt:
        raise ImportError_("IMPORT_UNSUPPORTED_FILE", f"cannot import {suffix or 'a file without suffix'}: it must be one of {', '.join(C.IMPORT_FORMATS)}")
    return fmt


def with_row_index(df: DataFrame, name: str = "_idx") -> DataFrame:
    """0-based position of each row inside its source file, in file order."""
    base = df.select("*", F.col("_metadata.file_path").alias("_file"), F.spark_partition_id().alias("_pid"),
                     (F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))).alias("_rip"))
    stats = base.groupBy("_file", "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_rip").alias("_first"))
    w = Window.partitionBy("_file").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("_file", "_pid", "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    # one row per file split; AQE broadcasts it after measuring its size
    j = base.join(offsets, ["_file", "_pid"])
    return j.select(*df.columns, "_file", (F.col("_off") + F.col("_rip") - F.col("_first")).alias(name))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(_file, row_number, row: variant): every column of the header as text; of columns with the same name the
    last one counts. A record shorter than the header has null for what is missing; what a longer one has
    beyond it is a list under ``null``. Files of one folder must share their header.

    Records are cut over byte splits, quoted line ends included (`csv_splits`); a file is read twice."""
    splits = csv_splits.file_splits(spark, path)
    if not splits.agg(F.min((~F.col("blank_first")).cast("int"))).first()[0]:
        raise ImportError_("IMPORT_INVALID_CSV", "a CSV file starts with a header row")
    records = csv_splits.records(spark, path, splits)
    headers = records.where("number = 1").select("fields").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ImportError_("IMPORT_INVALID_CSV", "the files have different headers")
    names = headers[0]["fields"]
    fields, place = F.col("fields"), {n: i for i, n in enumerate(names)}
    plain = [F.get(fields, F.lit(i)).alias(n) for n, i in place.items()]
    rest = F.slice(fields, len(names) + 1, F.greatest(F.size(fields) - len(names), F.lit(0))).alias(REST)
    longer = F.struct(*[c for n, c in zip(place, plain) if n != REST], rest)
    row = F.when(F.size(fields) > len(names), F.to_variant_object(longer)).otherwise(F.to_variant_object(F.struct(*plain)))
    return records.where("number > 1").select(F.col("file").alias("_file"), (F.col("number")).alias("row_number"), row.alias("row"))


def _json_lines(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(_file, row_number, row) of every line that is not blank in ``files``; the numbers are those of
    the stripped text, which starts at the first such line."""
    idx = with_row_index(spark.read.text(path)).join(files, "_file", "left_semi")
    text = F.when(F.col("_idx") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    t = idx.select("_file", "_idx", text.alias("line"))
    nonblank = t.where(F.length(F.trim(F.regexp_replace("line", r"(?U)\s", " "))) > 0)
    first = nonblank.groupBy("_file").agg(F.min("_idx").alias("_first"))
    return nonblank.join(first, "_file").select("_file", (F.col("_idx") - F.col("_first") + 1).alias("row_number"), strict_parse("line").alias("row"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(_file, row_number, row: variant), written once. Raises ``ImportError_`` on a scalar document or a bad
    JSON line; of several the first by file and line is named.

    Whole arrays and objects are found and cut over byte splits (`json_splits`), all other files are lines."""
    splits = json_splits.file_splits(spark, path)
    kinds = {r["kind"] for r in splits.select("kind").distinct().collect()}
    found = []
    if kinds - {"other"}:
        values = json_splits.values(spark, path, splits)
        # text between the brackets that is no JSON fails the whole text, whose first line is none either
        found.append(values.select(F.col("file").alias("_file"), F.col("number").alias("row_number"), strict_parse("text").alias("row"), F.lit(1).cast("long").alias("line"), F.lit(True).alias("whole")))
    if "other" in kinds or not kinds:
        files = splits.where("kind = 'other'").select(F.col("file").alias("_file")).distinct()
        found.append(_json_lines(spark, path, files).select("_file", "row_number", "row", F.col("row_number").alias("line"), F.lit(False).alias("whole")))
    rows = json_splits.written(functools.reduce(DataFrame.unionByName, found), "json-rows")
    bad = rows.where("row IS NULL").agg(F.min(F.struct("_file", "line"))["line"]).first()[0]
    if bad is not None:
        raise ImportError_("IMPORT_INVALID_JSON", f"line {bad} is no JSON")
    # a text of one line that is neither array nor object
    if rows.where("NOT whole").groupBy("_file").count().where("count = 1").limit(1).count():
        raise ImportError_("IMPORT_INVALID_JSON", "a JSON file holds an object, an array of objects or one object per line")
    return rows.select("_file", "row_number", "row")


def read_import(spark: SparkSession, path: str, file_name: str | None = None) -> DataFrame:
    fmt = detect_format(file_name or path)
    return read_csv(spark, path) if fmt == "csv" else read_json(spark, path)


def detect_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Format of every uploaded file under ``folder`` from its extension
    (listing only; contents are not read): ``file_format`` is NULL and
    ``error_code`` set for unsupported files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    fmt = F.element_at(F.create_map(*[x for kv in C.IMPORT_FORMATS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                       ext)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        fmt.alias("file_format"),
        F.when(fmt.isNull(), F.lit("import_unsupported_file")).alias("error_code"),
    )
