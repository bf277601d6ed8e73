"""Reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in key order (range partitions, sorted inside, plus each partition's
offset), the number goes through a keyed Feistel network over a domain barely larger than n, and
values outside 0..n-1 walk on along their cycle until they fall inside. Of the permuted number p,
``shard = p mod shards`` and ``slot = p div shards``: counts differ by one at most, slots have no gap,
and place and row number can be computed from each other without any table (`place_of`, `row_of`).
Native: only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table

ROUNDS = 6
SEED = 20240
#: steps of the cycle walk; fewer where the domain exceeds n by less (see `_walk`)
WALK = 64
#: the range partitions' offsets are one row for each shuffle partition
MAX_OFFSET_ROWS = 1 << 20


def _domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _keys(seed: int) -> Column:
    return F.array(*[F.lit(seed * 1_000_003 + i).cast("long") for i in range(ROUNDS)])


def _mix(x: Column, key: Column, m: int) -> Column:
    return F.pmod(F.xxhash64(x, key), F.lit(m).cast("long"))


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over the domain a x b: each half is shifted by a hash of the other."""
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(s, key):
        left = (s["l"] + _mix(s["r"], key, a)) % la
        return F.struct(left.alias("l"), ((s["r"] + _mix(left, key, b)) % lb).alias("r"))

    start = F.struct(F.floor(x / lb).cast("long").alias("l"), (x % lb).alias("r"))
    return F.aggregate(_keys(seed), start, step, lambda s: s["l"] * lb + s["r"])


def _unfeistel(y: Column, a: int, b: int, seed: int) -> Column:
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(s, key):
        right = F.pmod(s["r"] - _mix(s["l"], key, b), lb)
        return F.struct(F.pmod(s["l"] - _mix(right, key, a), la).alias("l"), right.alias("r"))

    start = F.struct(F.floor(y / lb).cast("long").alias("l"), (y % lb).alias("r"))
    return F.aggregate(F.reverse(_keys(seed)), start, step, lambda s: s["l"] * lb + s["r"])


def _walk(x: Column, n: int, seed: int, step) -> Column:
    """Applies ``step`` until the value is below n. A cycle can stay outside for at most
    ``a * b - n`` values, which is below 2 * sqrt(n): walked in full for small n; for n over 1,000 each
    step leaves with a probability above 0.93, so 64 steps fail with less than 1e-70."""
    a, b = _domain(n)
    more = min(WALK, a * b - n)
    first = step(x, a, b, seed)
    if not more:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(more)), first,
                       lambda acc, _: F.when(acc < n, acc).otherwise(step(acc, a, b, seed)))


def place_of(row: Column, n: int, shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """(shard, slot) of a global row number."""
    p = _walk(row.cast("long"), n, seed, _feistel)
    return (p % shards).cast("int"), F.floor(p / shards).cast("long")


def row_of(shard: Column, slot: Column, n: int, shards: int, seed: int = SEED) -> Column:
    """The global row number that sits at (shard, slot)."""
    return _walk(slot.cast("long") * shards + shard, n, seed, _unfeistel)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 by ``order`` in column ``row``, and n. No global window: rows are
    range-partitioned and sorted in parallel, written once (so a retried task cannot change a
    boundary), and only one count for each partition is summed up in order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = stored(placed, "numbered").withColumn("_pid", F.shiftright("_mid", 33))
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).orderBy("_pid").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_pid"], total))
        total += r["_n"]
    if not starts:
        return placed.withColumn("row", F.lit(0).cast("long")).drop("_mid", "_pid"), 0
    if len(starts) > MAX_OFFSET_ROWS:
        raise ValueError("more range partitions than offsets may be broadcast")
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_pid long, _start long"))
    row = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_pid").withColumn("row", row).drop("_mid", "_pid", "_start"), total


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """Adds ``row`` (global number), ``shard`` and ``slot`` to every row.

    Ties in ``order`` (repeated rows) get different numbers; which of two equal rows gets which does
    not show. Nulls sort first and are numbered like any value. An empty table gives no rows.
    Columns of the input named row, shard or slot are replaced."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    df = df.drop(*[c for c in ("row", "shard", "slot", "_mid", "_pid", "_start") if c not in order])
    numbered, n = number_rows(df, order)
    shard, slot = place_of(F.col("row"), max(n, 1), shards, seed)
    return numbered.withColumn("shard", shard).withColumn("slot", slot)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 16) and text_crc32."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )


def op10_feistel_shards(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 shards under the law ``rows``."""
    out = shard_rows(sized(table(spark, sf_dir, "documents")), ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
