"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and exact
similarity of weighted shingles. Native: only DataFrame functions.

A window and an item of the same number of words are near when their 64-bit SimHash values (over their
5-word shingles, repeated ones told apart) differ in at most `RADIUS` bits. The bits are split in `BLOCKS`
blocks: of any two values within the radius one block differs in at most RADIUS // BLOCKS = 1 bit, so
items are entered under every block value and all values one bit off, and windows look up their own: no
pair within the radius is missed. Pairs are verified by the Jaccard similarity of their 5-word shingles,
each weighted by how often it occurs.

The radius: sets with a Jaccard similarity of 0.8 or more have a cosine of 2 * 0.8 / 1.8 = 0.89 or more,
so a bit differs with a chance of 0.151 at most (9.7 of 64 bits on average), and more than 25 bits differ
with a chance below 1e-6. Over words there is no such bound: a changed end of one repeated word moves
far more bits. Of unrelated values 5% are within this radius too, so up to that share of the pairs of a
window and an item of its length is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.anchored import K, bag, grams, prepared, proposed_windows
from basketflow.llm.common import bounded_broadcast, stored, table, with_array_bound, word_hashes

BITS = 64
RADIUS = 25
BLOCKS = 13
#: similarity in percent
SIMILAR = 80
#: the items' block entries (77 for each item) are broadcast up to this count
MOST_ENTRIES = 1_000_000
#: block i holds the bits from EDGES[i] to EDGES[i + 1]
EDGES = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]


def simhash(hashes: Column) -> Column:
    """Bit b is set where more than half of the hashes have it. Two bits are counted at once,
    in the halves of a long."""
    lanes = F.lit(1 | 1 << 32).cast("long")
    low = F.lit((1 << 32) - 1).cast("long")

    def step(acc, g):
        count = F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftrightunsigned", x, g).bitwiseAND(lanes))
        more = lambda c: F.when(c * 2 > F.size(hashes), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        pair = more(count.bitwiseAND(low)).bitwiseOR(F.shiftleft(more(F.shiftrightunsigned(count, 32)), 32))
        return acc.bitwiseOR(F.call_function("shiftleft", pair, g))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), step)


def _block(value: Column, i: int) -> Column:
    return F.shiftrightunsigned(value, EDGES[i]).bitwiseAND(F.lit((1 << EDGES[i + 1] - EDGES[i]) - 1).cast("long"))


def _entries(items: DataFrame) -> DataFrame:
    """n, block, value: each item under every block's value and all values one bit off."""
    def around(i: int) -> Column:
        off = [F.lit(0).cast("long")] + [F.lit(1 << b).cast("long") for b in range(EDGES[i + 1] - EDGES[i])]
        return F.transform(F.array(*off), lambda x: F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).bitwiseXOR(x).alias("value")))

    return items.select("id", "n", "fp", F.explode(F.flatten(F.array(*[around(i) for i in range(BLOCKS)]))).alias("e")).select("id", "n", "fp", "e.block", "e.value")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, doc_key, item_id, start_word, n_words, common_shingles, union_shingles: the best window
    (of equals one with a shingle in line, the earliest) of every document and item that are similar enough.

    Windows at every offset count: sets with a similarity of `SIMILAR` have that share of the item's shingles in
    common, and windows with fewer in any item of their length are not looked at.

    Null and empty texts and items match nothing; items of fewer than five words match as a whole.
    Repeated items each match; repeated documents share their rows' result (by doc_id and text)."""
    items = prepared(items.select(F.col("item_id").cast("long").alias("id"), F.col("text")), word_hashes(F.col("text")))
    items = stored(items.withColumn("fp", simhash(F.col("bag"))), "items")
    windows = proposed_windows(docs, items, word_hashes, SIMILAR)
    windows = with_array_bound(windows, "bag", bag(F.col("window")))
    windows = stored(windows.withColumn("fp", simhash(F.col("bag"))), "windows")
    keys = windows.select("doc_id", "doc_key", "start", "n", "fp", "bag", "window", F.posexplode(F.array(*[_block(F.col("fp"), i) for i in range(BLOCKS)])).alias("block", "value"))
    entries = stored(_entries(items), "entries")
    entries = bounded_broadcast(entries.withColumnRenamed("fp", "item_fp"), entries.count(), MOST_ENTRIES)
    near = keys.join(entries, ["n", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a pair met in several blocks counts in the first of them
    first = None
    for i in reversed(range(BLOCKS)):
        x = _block(F.col("fp").bitwiseXOR(F.col("item_fp")), i)
        first = F.when(F.bit_count(x) <= RADIUS // BLOCKS, F.lit(i)).otherwise(first)
    near = near.filter(F.col("block") == first).select("doc_id", "doc_key", "start", "n", "bag", "window", "id")
    both = near.join(items.select("id", F.col("bag").alias("item_bag"), "h").distinct(), "id")
    common = F.size(F.array_intersect("bag", "item_bag"))
    union = F.size("bag") + F.size("item_bag") - F.col("common")
    scored = both.withColumn("common", common).withColumn("union", union).filter(100 * F.col("common") >= SIMILAR * F.col("union"))
    size = F.least(F.size("h"), F.lit(K))
    aligned = F.slice(grams(F.col("h"), size), F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("window"))
    line = F.exists(F.zip_with(grams(F.col("window"), size), aligned, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)
    scored = scored.withColumn("line", line)
    best = F.max_by(F.struct("start", "n", "common", "union"), F.struct((F.col("common") / F.col("union")).alias("s"), "line", -F.col("start"), -F.col("n")))
    got = scored.groupBy("doc_id", "doc_key", "id").agg(best.alias("b"))
    return got.select("doc_id", "doc_key", F.col("id").alias("item_id"), F.col("b.start").cast("long").alias("start_word"), F.col("b.n").cast("long").alias("n_words"),
                      F.col("b.common").cast("long").alias("common_shingles"), F.col("b.union").cast("long").alias("union_shingles"))


def op7_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("doc_key")


OP7_SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT kind, id, len(ws) AS n, k, unnest(range(0, len(ws) - k + 1)) AS p, ws FROM w CROSS JOIN k
      WHERE len(ws) >= k AND (kind = 0 AND k IN (SELECT least(len(ws), 5) FROM w WHERE kind = 1) OR kind = 1 AND k = least(len(ws), 5))),
s AS (SELECT kind, id, n, k, p, list_aggregate(ws[p + 1:p + k], 'string_agg', ' ') AS sh FROM g),
c AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.p - i.p AS start, i.n, i.k, d.n AS len FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.k = i.k AND d.sh = i.sh),
x AS (SELECT c.doc_id, c.item_id, c.start, c.n, c.k, s.sh, count(*) AS have FROM c JOIN s ON s.kind = 0 AND s.id = c.doc_id AND s.k = c.k AND s.p >= c.start AND s.p + c.k <= c.start + c.n GROUP BY ALL),
y AS (SELECT id AS item_id, sh, count(*) AS want FROM s WHERE kind = 1 GROUP BY ALL),
z AS (SELECT doc_id, item_id, start, n, sum(least(have, coalesce(want, 0)))::BIGINT AS common, sum(have)::BIGINT AS total FROM x LEFT JOIN y USING (item_id, sh) GROUP BY doc_id, item_id, start, n),
u AS (SELECT z.*, total + (SELECT sum(want) FROM y WHERE y.item_id = z.item_id)::BIGINT - common AS un FROM z)
SELECT doc_id, item_id, start::BIGINT AS start_word, n::BIGINT AS n_words, common AS common_shingles, un AS union_shingles
FROM u WHERE 100 * common >= 80 * un
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / un DESC, start) = 1
"""
