"""Exact top-k inner products by Fagin's threshold algorithm.

The candidates are dealt into blocks of bounded size by a hash of their id; a block keeps every
dimension as a list of its rows sorted by that component. For a query the lists are read from the end
that its component favours, some depths at a time; new rows are scored in full, and reading stops when
no unread row can beat the query's k-th score (the sum over dimensions of component times the value
at the depth reached is an upper bound). Queries travel in blocks too; each block pair gives at most k
rows for each query, and those are reduced to k by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table

K = 5
SCALE = 256
#: rows in a candidate block and in a query block, on average
BLOCK_ROWS, QUERY_ROWS = 1024, 512
FIRST_DEPTH = 8
HITS = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v`` (longs: floor(scale * x)) of the vectors without null or non-finite parts."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fixed = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.filter(e.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), fixed.alias("v"))


def threshold_top_k(rows: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of a block for one query, ties to the smaller id; ``order`` has
    the row numbers of each dimension by rising component. Rows with the query's own id do not count."""
    n, dims = rows.shape
    seen = ids == own
    best_s, best_i = np.empty(0, rows.dtype), np.empty(0, ids.dtype)
    dim = np.flatnonzero(query != 0)
    if not len(dim):
        at = np.sort(ids[~seen])[:k]
        return [(0, int(i)) for i in at]
    lists = np.where((query[dim] > 0)[:, None], order[dim, ::-1], order[dim])
    low, high = 0, min(FIRST_DEPTH, n)
    while True:
        fresh = np.zeros(n, dtype=bool)
        fresh[lists[:, low:high].ravel()] = True
        fresh &= ~seen
        at = np.flatnonzero(fresh)
        seen[at] = True
        best_s, best_i = np.concatenate([best_s, rows[at] @ query]), np.concatenate([best_i, ids[at]])
        if len(best_s) > k:
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
        if high >= n:
            break
        bound = (rows[lists[:, high - 1], dim] * query[dim]).sum()
        if len(best_s) >= k and bound < best_s[k - 1]:  # an equal score could still win by its id
            break
        low, high = high, min(n, high * 4)
    top = np.lexsort((best_i, -best_s))[:k]
    return [(int(best_s[i]), int(best_i[i])) for i in top]


def _matrix(rows: list) -> np.ndarray:
    """As floats while every product sum stays exact in them, else as 64-bit or Python integers."""
    m = np.array([np.asarray(r, dtype="int64") for r in rows], dtype="int64").reshape(len(rows), -1)
    return m


def _exact(m: np.ndarray, q: np.ndarray):
    top = float(np.abs(m.astype("float64")).max(initial=0)) * float(np.abs(q.astype("float64")).max(initial=0)) * max(1, m.shape[1])
    kind = "float64" if top < 2**52 else "int64" if top < 2**62 else object
    return m.astype(kind), q.astype(kind)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates (all, if fewer) for each query.

    Both sides are vec_id and v (`usable`). Vectors meet only those of the same length. Repeated ids
    among the candidates all count; those with the query's id never do. Scores beyond a long are
    held at its ends. No queries or no candidates give no rows."""
    candidates = stored(candidates.withColumn("dims", F.size("v")), "vectors")
    queries = stored(queries.withColumn("dims", F.size("v")), "queries")
    n, m = candidates.count(), queries.count()
    blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    spread = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    # every query block goes to every candidate block: a stated query set against all rows, in blocks
    left = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id", F.xxhash64("v")), F.lit(blocks)).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = queries.withColumn("q_block", spread(q_blocks, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(rows) and len(asked):
            matrix, wanted = _exact(_matrix(rows["v"].tolist()), _matrix(asked["v"].tolist()))
            ids = rows["vec_id"].to_numpy()
            order = np.argsort(matrix, axis=0, kind="stable").T.copy()
            for own, query in zip(asked["vec_id"].tolist(), wanted):
                out += [(own, i, min(max(s, -2**63), 2**63 - 1)) for s, i in threshold_top_k(matrix, ids, order, query, own, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["block", "q_block", "dims"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_fagin_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
