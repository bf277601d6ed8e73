"""Small helpers shared by the operators: reading a table's needed columns, written intermediate
tables in the shared checkpoint folder, and the word rule of the near-duplicate operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.session import scratch_path

#: white space between words: space and \x09-\x0D
WORD_BREAK = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: cuts the lineage, and
    the files survive the loss of any executor."""
    path = f"{folder or scratch_path(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes the written tables of a folder from `scratch_path`, once no later step reads them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text):
    """Lower-cases A-Z only and splits on white space; null or blank text has no words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, WORD_BREAK), lambda w: w != "")


def word_hashes(text):
    """The 64-bit hash of every word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes, k: int = 5):
    """One 64-bit hash for every run of ``k`` word hashes (array of longs, by position); empty when
    there are fewer words."""
    return F.when(
        F.size(hashes) >= k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k),
                    lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def with_array_bound(df: DataFrame, name: str, col) -> DataFrame:
    """Adds ``col`` once as a column that later expressions read instead of recomputing it (a
    one-element ``inline`` is a barrier for the optimizer's projection merging)."""
    keep = [df[c] for c in df.columns if c != name]
    return df.select(*keep, F.inline(F.array(F.struct(col.alias(name)))))


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these (lower-case) names under free ones, and the names to give back."""
    taken, back = {c.lower() for c in docs.columns} | set(names), {}
    for c in docs.columns:
        if c.lower() in names:
            free = f"_{c}"
            while free.lower() in taken:
                free = f"_{free}"
            taken.add(free.lower())
            back[free] = c
    return docs.withColumnsRenamed({c: free for free, c in back.items()}), back


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Rows travel to Python workers in batches of so many bytes (one row at least): a batch of whole texts is
    held several times on its way, and its rows alone are no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Marks ``df`` for broadcast only while its counted ``rows`` stay within ``limit``; beyond it
    the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def release(spark: SparkSession) -> None:
    """Between written phases: Spark deletes a finished phase's shuffle files only when the driver
    collects its garbage, which would else keep all phases' files on disk at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
