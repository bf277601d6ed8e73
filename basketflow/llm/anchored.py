"""Windows of documents that could match one of a set of short texts, found natively.

`proposed_windows` takes the windows that put a shared shingle of a document and a text in line, or, with a
least share, the windows at every offset: one that has less than that share of a text's shingles cannot
have them in common with it. Only DataFrame functions: words and shingles are arrays of hashes, the
texts' shingles are joined to the documents' (broadcast while few, else by a shuffle), and the windows are
cut from the documents that have any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import bounded_broadcast, shingle_hashes, stored, with_array_bound

K = 5
#: rows up to which the texts' shingles (24 bytes each) and the keys of proposed documents are broadcast
MOST_SHINGLES, MOST_KEYS = 500_000, 1_000_000


def grams(hashes: Column, size: Column | int) -> Column:
    """Hashes of the runs of ``size`` words (5, or the length of a shorter text)."""
    short = F.lit(None).cast("array<bigint>")
    for n in range(1, K):
        short = F.when(F.lit(size) == n, shingle_hashes(hashes, n)).otherwise(short)
    return F.when(F.lit(size) >= K, shingle_hashes(hashes, K)).otherwise(short)


def bag(hashes: Column) -> Column:
    """A window's or a text's shingles, repeated ones told apart by their number: 5-word runs, or the
    whole sequence when there are fewer words."""
    runs = grams(hashes, F.least(F.size(hashes), F.lit(K)))
    numbered = F.transform(runs, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(runs, 1, i), lambda y: y == x))))
    return F.coalesce(F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.transform(runs, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(numbered), F.array().cast("array<bigint>"))


def prepared(texts: DataFrame, hashes: Column) -> DataFrame:
    """``texts`` (id, text) with words ``h``, count ``n`` and ``bag``; texts without a word go."""
    texts = with_array_bound(texts.select("id", hashes.alias("h")), "h", F.col("h"))
    texts = texts.withColumn("n", F.size("h")).filter("n > 0 and id is not null")
    return stored(texts.withColumn("bag", bag(F.col("h"))), "texts")


def _starts(ats: Column, n: Column, least: int) -> Column:
    """Every start of a window of ``n`` words that holds ``least`` percent of a text's shingles at the positions
    ``ats`` (sorted, distinct): wherever so many positions in a row fit in, all windows round them."""
    shingles = n - F.least(n, F.lit(K)) + 1
    need = F.ceil(shingles * least / 100).cast("int")
    ahead = lambda x, j: F.get(ats, j + need - 1) - shingles + 1  # noqa: E731  the first window that reaches so far
    rounds = F.transform(ats, lambda x, j: F.when(ahead(x, j) <= x, F.sequence(ahead(x, j), x)).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(rounds))


def proposed_windows(docs: DataFrame, texts: DataFrame, hashes, least: int | None = None) -> DataFrame:
    """doc_id, doc_key, start, n, window: the windows of ``docs`` (doc_id, text) that share a shingle
    in line with a text of n words; with ``least``, the windows at every offset in which that percentage of
    the shingles of a text of n words can be found, in line or not. Windows end at the document's ends.
    ``hashes`` maps a text column to its array of word hashes."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text").filter("text is not null")
    lengths = [r["k"] for r in texts.select(F.least("n", F.lit(K)).alias("k")).distinct().orderBy("k").collect()]
    k = F.least("n", F.lit(K))
    wanted = texts.select("n", k.alias("k"), F.posexplode(grams(F.col("h"), k)).alias("item_at", "gram"))
    wanted = wanted.select("k", "gram", "n", F.col("item_at") if least is None else F.lit(0).alias("item_at")).distinct()
    wanted = stored(wanted, "wanted")
    wanted = bounded_broadcast(wanted, wanted.count(), MOST_SHINGLES)
    words = with_array_bound(keyed.select("doc_id", "doc_key", hashes(F.col("text")).alias("h")), "h", F.col("h"))
    hits = None
    for size in lengths:
        runs = words.select("doc_id", "doc_key", F.posexplode(shingle_hashes(F.col("h"), size)).alias("at", "gram"))
        got = runs.join(wanted.filter(F.col("k") == size).drop("k"), "gram").select("doc_id", "doc_key", (F.col("at") - F.col("item_at")).alias("start"), "n")
        hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        return words.select("doc_id", "doc_key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.col("h").alias("window")).limit(0)
    if least is None:
        hits = hits.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    else:
        hits = hits.groupBy("doc_id", "doc_key", "n").agg(F.sort_array(F.collect_set("start")).alias("ats"))
        hits = with_array_bound(hits, "starts", _starts(F.col("ats"), F.col("n"), least)).filter(F.size("starts") > 0)
        hits = hits.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("starts", "n")).alias("places"))
        hits = hits.withColumn("places", F.flatten(F.transform("places", lambda p: F.transform(p["starts"], lambda x: F.struct(x.alias("start"), p["n"].alias("n"))))))
    hits = stored(hits, "hits")
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), "places")
    texts_hit = keyed.join(bounded_broadcast(hits, hits.count(), MOST_KEYS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")))
    cut = with_array_bound(texts_hit.select("doc_id", "doc_key", "places", hashes(F.col("text")).alias("h")), "h", F.col("h"))
    cut = cut.select("doc_id", "doc_key", "h", F.explode("places").alias("p")).select("doc_id", "doc_key", "h", "p.start", "p.n")
    first = F.greatest("start", F.lit(0))
    window = F.slice("h", first + 1, F.least(F.col("start") + F.col("n"), F.size("h")) - first)
    return cut.select("doc_id", "doc_key", F.col("start"), "n", window.alias("window"))
