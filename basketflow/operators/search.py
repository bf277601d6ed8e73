"""Substring search over keys through posting lists of n-grams.

A scan with ``contains`` reads every key for each page a user opens. The index holds, for each key, its
distinct grams of one, two and three characters (lower case). A text of three or more characters can only
lie in a key that has all of the text's trigrams; a shorter text is a gram itself. Keys that hold the
rarest grams are intersected and the survivors are verified, so the answer equals ``contains``.

Layout: postings are range-sorted by (gram, key), so one gram is a run of neighbouring Parquet row groups
and the pushed-down ``gram IN (…)`` skips the others by their statistics. The key is part of the range: a gram
that every key has (a common prefix) is cut over many files and never one task. A second table counts
each gram's keys; it has a row a gram and tells which lists are short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (1, 2, 3)


def folded(key):
    return F.lower(key)


def build(keys: DataFrame, key: str, path: str, partitions: int | None = None) -> str:
    """Writes the index of ``keys`` (null ones are left out, repeated ones count once) under ``path``."""
    spark = keys.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = folded(F.col("key"))
    starts = "transform(sequence(1, greatest(length(text) - {0} + 1, 1)), i -> substring(text, i, {0}))"
    grams = F.expr("array_distinct(concat(" + ", ".join(starts.format(s) for s in SIZES) + "))")
    rows = (keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().withColumn("text", text)
            .select(F.explode(grams).alias("gram"), "key").where("gram <> ''"))
    # a key shorter than a size repeats as its own gram of fewer characters
    rows.distinct().repartitionByRange(n, "gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("keys")) \
        .sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return path


def grams_of(text: str) -> list[str]:
    """The grams that a key must have to contain ``text`` (not empty)."""
    size = min(len(text), max(SIZES))
    return sorted({text[i:i + size] for i in range(len(text) - size + 1)})


def find(spark: SparkSession, path: str, text: str, lists: int = 3) -> DataFrame:
    """The keys that contain ``text`` in any case, as column ``key``; ``text`` is trimmed and not empty.

    The ``lists`` rarest grams are intersected by one count per key (partial before its exchange); the others
    are left to the verification, which reads no further list."""
    text = text.strip().lower()
    if not text:
        raise ValueError("a search needs a text")
    grams = grams_of(text)
    # a row a gram of the text: bounded by the text that a user typed
    known = {r["gram"]: r["keys"] for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(grams)).collect()}
    postings = spark.read.parquet(f"{path}/postings")
    if len(known) < len(grams):
        return postings.where("false").select("key")
    rarest = sorted(grams, key=lambda g: (known[g], g))[:lists]
    held = postings.where(F.col("gram").isin(rarest))
    if len(rarest) > 1:
        held = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest))
    return held.where(folded(F.col("key")).contains(text)).select("key")


def page(spark: SparkSession, path: str, rows: DataFrame, key: str, text: str, number: int = 1, size: int = 10) -> DataFrame:
    """Page ``number`` of the rows whose key contains ``text``, in key order, in pages of 10, 25 or 50. The
    page's keys come from the index; the rows of at most 50 keys are then joined."""
    if size not in (10, 25, 50) or int(number) < 1:
        raise ValueError("pages start at 1 and hold 10, 25 or 50 rows")
    wanted = find(spark, path, text).orderBy("key").offset((int(number) - 1) * size).limit(size)
    return rows.join(F.broadcast(wanted.withColumnRenamed("key", key)), key).orderBy(key)
