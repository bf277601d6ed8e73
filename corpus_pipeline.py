"""The training-data pipeline: five stages from `documents` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm.common import bounded_batches, release, set_aside, stored, table
from basketflow.llm.decontaminate import contaminated
from basketflow.llm.language import held_out, predict, train
from basketflow.llm.near_dedup import near_duplicates
from basketflow.llm.packing import document_pieces, pack, tokenizer_path
from basketflow.llm.pii import redacted

#: documents whose best language is less sure than this are rejected
SURE = 0.5
#: documents that share so many percent of their shingles are near duplicates
SIMILAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letter, no text) and those whose best language is not
    even likely. A missing ``lang`` is filled in; a given one stays."""
    bounded_batches(spark)
    docs, names = set_aside(docs, "lang_pred", "score", "_text_for_language")
    model = train(docs.filter(~held_out()))
    got = predict(docs, model, docs.columns)
    # without a labelled document there is no model, and nothing is rejected for being unsure
    good = (F.col("lang_pred") != "und") & (F.col("score") >= SURE) if model else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    got = got.filter(good).withColumn("lang", F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred"))))
    return got.select(*docs.columns).withColumnsRenamed(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest doc_id) of each near-duplicate component, once."""
    bounded_batches(spark)
    docs, names = set_aside(docs, "_kept_id", "_text_key")
    kept = near_duplicates(docs.select("doc_id", "text"), SIMILAR).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    one = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    return one.withColumn("_text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns).withColumnsRenamed(names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    bounded_batches(spark)
    docs, names = set_aside(docs, "_bad_id", "_bad_key")
    bad = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("doc_key").alias("_bad_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_key")), "left_anti").select(*docs.columns).withColumnsRenamed(names)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind."""
    bounded_batches(spark)
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces with their sequence and offset."""
    bounded_batches(spark)
    return pack(document_pieces(docs, tokenizer_path()))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: the language model and the packing are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return docs
