"""Hard-negative mining over exact integer scores from a residue-number-system matrix product.

Component matrices are reduced modulo several small primes (symmetric residues) and multiplied in
float32, in runs of the inner dimension so short that every sum is exact in a float; mixed-radix
(Chinese remainder) digits of the residues give the signed scores, exact because the primes' product exceeds
twice the largest possible score. Rows are dealt into slices of bounded size. A slice and then all anchors
that meet it stream through a task one after the other (sorted by slice and side), so a task holds one
slice and a batch of anchors. The first pass finds each anchor's positives, the second the best negatives
in the score window of each positive; Spark reduces what the slices found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: a negative's score is between these percentages of the positive's
LOW, HIGH = 30, 90
#: vector components in a slice and in a batch of anchors, on average (bounds a task's memory)
SLICE_COMPONENTS, BATCH_SCORES = 1 << 20, 1 << 20
#: the moduli; a sum of `run_length` products of residues stays below 2^24, where floats are exact
PRIMES = tuple(p for p in range(255, 2, -2) if all(p % q for q in range(3, 16, 2) if q < p))
LARGEST = PRIMES[0] // 2
RUN = (1 << 24) // (LARGEST * LARGEST) - 1

HIT = "anchor_id long, vec_id long, score long"
NEGATIVE_HIT = "anchor_id long, positive_id long, positive_rank int, positive_score long, negative_id long, negative_score long"


def _symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """float32 of the residues of exact values, between -p/2 and p/2."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(m: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """The matrix modulo each prime, symmetric, in float32."""
    got = []
    for p in primes:
        r = np.mod(m, p).astype("int64")
        got.append(np.where(r > p // 2, r - p, r).astype("float32"))
    return got


def moduli(bound: int) -> tuple[int, ...]:
    """As many primes as scores between ``-bound`` and ``bound`` need."""
    product, n = 1, 0
    while product <= 2 * bound + 1:
        if n == len(PRIMES):
            raise ValueError("scores beyond the product of all moduli")
        product *= PRIMES[n]
        n += 1
    return PRIMES[:max(n, 1)]


def largest(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> list[np.ndarray]:
    """The product of the residue matrices (rows by rows) modulo each prime, symmetric."""
    got = []
    for x, y, p in zip(a, b, primes):
        total = np.zeros((len(x), len(y)), "float32")
        for i in range(0, x.shape[1], RUN):
            total = _symmetric(total + _symmetric(x[:, i:i + RUN] @ y[:, i:i + RUN].T, p), p)
        got.append(total)
    return got


def reconstruct(parts: list[np.ndarray], primes: tuple[int, ...], bound: int) -> np.ndarray:
    """Signed scores from symmetric residues by mixed-radix digits: every step stays below p * p."""
    digits: list[np.ndarray] = []
    for j, p in enumerate(primes):
        d = parts[j]
        for i in range(j):
            d = _symmetric(_symmetric(d - digits[i], p) * np.float32(_half(pow(primes[i], -1, p), p)), p)
        digits.append(d)
    kind = "int64" if bound < 1 << 62 and math.prod(primes) < 1 << 63 else object
    total = np.zeros(parts[0].shape, kind)
    for d, p in zip(reversed(digits), reversed(primes)):
        total = total * p + d.astype("int64").astype(kind)
    return total


def _half(r: int, p: int) -> int:
    return r - p if r > p // 2 else r


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    bound = a.shape[1] * largest(a) * largest(b)
    primes = moduli(bound)
    return reconstruct(products(residues(a, primes), residues(b, primes), primes), primes, bound)


class Slice:
    """The rows of a slice in vec_id order, with residues kept for all anchors that come."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        self.ids, self.labels = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.matrix = _matrix(rows["v"])[order]
        self.largest, self.reduced = largest(self.matrix), []

    def scores(self, anchors: np.ndarray, at) -> np.ndarray:
        """Scores of the anchors with the rows ``at`` (an index or a slice of all)."""
        bound = anchors.shape[1] * largest(anchors) * self.largest
        primes = moduli(bound)
        self.reduced += residues(self.matrix, primes[len(self.reduced):])
        theirs = [r[at] for r in self.reduced[:len(primes)]]
        return reconstruct(products(residues(anchors, primes), theirs, primes), primes, bound)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("int64")
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def best(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` highest of ``found`` are (all, if fewer), in order, ties to the smaller id;
    ``ids`` ascend. Only what reaches the k-th highest is sorted."""
    at = np.arange(len(found))
    if len(found) > 4 * k:
        least = np.partition(found, len(found) - k)[len(found) - k]
        at = np.flatnonzero(found > least)
        at = np.sort(np.concatenate([at, np.flatnonzero(found == least)[:k - len(at)]]))
    return at[np.argsort(-found[at], kind="stable")][:k]


def _long(x) -> int:
    return min(max(int(x), -2**63), 2**63 - 1)


def _positives(rows: Slice, asked: pa.Table, k: int) -> list[tuple]:
    out, vectors = [], _matrix(asked["v"])
    ids, labels = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
    for label in np.unique(labels):
        at, own = np.flatnonzero(rows.labels == label), np.flatnonzero(labels == label)
        if not len(at):
            continue
        step = max(1, BATCH_SCORES // len(at))
        for i in range(0, len(own), step):
            some = own[i:i + step]
            for anchor, got in zip(ids[some], rows.scores(vectors[some], at)):
                others = np.flatnonzero(rows.ids[at] != anchor)
                for j in best(got[others], rows.ids[at][others], k):
                    out.append((int(anchor), int(rows.ids[at][others[j]]), _long(got[others[j]])))
    return out


def _negatives(rows: Slice, asked: pa.Table, k: int, low: int, high: int) -> list[tuple]:
    out, vectors = [], _matrix(asked["v"])
    wanted = asked["positives"].to_pylist()
    ids, labels = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
    step = max(1, BATCH_SCORES // max(1, len(rows.ids)))
    for i in range(0, len(ids), step):
        got = rows.scores(vectors[i:i + step], slice(None))
        for j, found in enumerate(got, i):
            bounds = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in wanted[j]]
            least, most = min(b[0] for b in bounds), max(b[1] for b in bounds)
            other = np.flatnonzero((rows.labels != labels[j]) & (found >= least) & (found <= most))
            held = found[other]
            for p, (least, most) in zip(wanted[j], bounds):
                inside = np.flatnonzero((held >= least) & (held <= most))
                for x in best(held[inside], rows.ids[other[inside]], k):
                    out.append((int(ids[j]), p["vec_id"], p["rank"], p["score"], int(rows.ids[other[inside[x]]]), _long(held[inside[x]])))
    return out


def _meet(rows: DataFrame, anchors: DataFrame, slices: int, find, schema: str, names: list[str]) -> DataFrame:
    """Runs ``find(Slice, anchors)`` for each slice of ``rows`` and all anchors of its vector length. Every
    anchor goes to each slice once, and every row to one slice only."""
    fields = ["slice", "side", "dims", "vec_id", "label", "v", "positives"]
    left = rows.withColumn("side", F.lit(0)).withColumn("positives", F.lit(None).cast(dict(anchors.dtypes)["positives"]))
    right = anchors.withColumn("side", F.lit(1)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    both = left.select(*fields).unionByName(right.select(*fields)).repartitionById(slices, "slice").sortWithinPartitions("slice", "dims", "side", "vec_id")

    def run(batches):
        key, held, now = None, [], None
        for batch in _by_key(batches):
            at = (batch["slice"][0].as_py(), batch["dims"][0].as_py())
            if at != key:
                key, held, now = at, [], None
            if batch["side"][0].as_py() == 0:
                held.append(batch)
            elif held or now:
                if now is None:
                    now, held = Slice(pa.concat_tables(held)), []
                out = find(now, batch)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "positive_rank" else pa.int64()) for n, c in zip(names, zip(*out) if out else [[]] * len(names))], names=names)

    return both.mapInArrow(run, schema)


def _by_key(batches) -> Iterator[pa.Table]:
    """The stream in pieces of one slice, length and side each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (0, 2, 1)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        whole = pa.Table.from_batches([batch])
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield whole.slice(a, b - a)


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``v`` (longs: floor(scale * x), held at a long's ends) of the rows whose id and
    label are not null and whose vector is neither null nor has a null or non-finite component."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fixed = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return rows.filter(there).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), fixed.alias("v"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, slice_components: int = SLICE_COMPONENTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label,
    v: `usable`) that ``is_anchor`` picks.

    Positives and negatives have the anchor's vector length. A row with the anchor's own vec_id is never its
    positive; with another label it may be a negative. An id that picks several rows is one anchor, with the
    least label and vector of them. Repeated rows else count as often as they occur: a repeated positive is
    ranked twice, and its negatives are listed for each. Anchors without a positive, and positives without a
    row in their window (any with a negative score), give no rows, and so does an empty table. Empty vectors
    score 0. Scores beyond a long are held at its ends."""
    rows = stored(rows.select("vec_id", "label", "v", F.size("v").alias("dims")), "mined")
    total = rows.agg(F.sum(F.greatest("dims", F.lit(1)))).first()[0] or 0
    slices = max(1, -(-int(total) // slice_components))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id", "label", F.monotonically_increasing_id()), F.lit(slices)).cast("int"))
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "dims")).alias("a")).select("vec_id", "a.*")
    none = F.lit(None).cast("array<struct<rank:int,vec_id:bigint,score:bigint>>")
    hits = _meet(dealt, anchors.withColumn("positives", none), slices, lambda s, a: _positives(s, a, positives), HIT, ["anchor_id", "vec_id", "score"])
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    chosen = hits.withColumn("rank", first).filter(F.col("rank") <= positives)
    chosen = stored(chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")), "positives")
    asked = anchors.join(chosen, anchors["vec_id"] == chosen["anchor_id"]).drop("anchor_id")
    names = [x.split()[0] for x in NEGATIVE_HIT.split(", ")]
    found = _meet(dealt, asked, slices, lambda s, a: _negatives(s, a, negatives, low, high), NEGATIVE_HIT, names)
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_residue_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    labelled = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(usable(labelled), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label,
             list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v r ON len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM s WHERE label = anchor_label AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
                   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
WHERE rank <= 10
"""
