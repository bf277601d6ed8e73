"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets,
star-shaped candidate edges, exact confirmation on full shingle sets, and connected components.

1. Each document's shingle set is hashed once; the hash's high part names one of the bins, whose
   smallest hash is the bin's value. Empty bins borrow from a filled bin found by universal hashing.
2. Documents with equal sets become one class; keys of `ROWS` bins each (24 at a similarity of 0.85, 35
   at 0.8) put classes into buckets. At the similarity all keys of two classes differ with a chance
   below 1e-6.
3. In each bucket the member that meets most others (its hub) is paired with every other member, so
   a bucket of m classes gives m - 1 pairs. Pairs are confirmed on full sets. A hub whose pairs are
   done leaves the bucket; buckets whose other members are not all in one component go a second
   round. Before it, members leave that cannot reach the similarity with anyone, because too
   many of their shingles are in no other open member; then a bucket finishes with the pairs of its
   members outside its largest component, as far as sizes, shared shingles and parity
   signatures (two sets differ in at least as many shingles as their signatures do in bits) allow a
   pair. Large buckets are compared in blocks, each in a task of its own. So no bucket is capped, none
   goes a third round, and no link between two components is missed by the star shape.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table
from basketflow.llm.components import components
from basketflow.llm.shingles import STEPS, mix, shingle_sets

ROWS = 5
#: op8's similarity in percent
SIMILAR = 85
#: the chance that two classes at the similarity meet in no bucket
MISSED = 1e-6
#: in the first round, a bucket with so few members is finished with all pairs between components
SMALL_BUCKET = 3
#: after the first round, a bucket with more comparisons (not pairs) is compared in blocks
COMPARISONS = 10_000
#: members outside the largest component, and members, that a block compares
BLOCK, ACROSS = 512, 2048
#: bits of the parity signature that rules out most unlike pairs before they are made
PARITY = 1024


def bands_for(similar: int) -> int:
    """How many keys a class needs at a similarity of ``similar`` percent."""
    return math.ceil(math.log(MISSED) / math.log1p(-((similar / 100) ** ROWS))) if similar < 100 else 1


def densified(sets: list[np.ndarray], n_bins: int) -> np.ndarray:
    """One row of ``n_bins`` values for each non-empty set."""
    values, filled = np.zeros((len(sets), n_bins), dtype="uint64"), np.zeros((len(sets), n_bins), dtype=bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(n_bins)) >> np.uint64(32)  # rises with s: the first is the smallest
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        at = bins[first].astype("int64")
        values[i, at], filled[i, at] = s[first], True
    row, col = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix(col.astype("uint64") * STEPS[0] + mix(np.array([attempt], dtype="uint64"))) % np.uint64(n_bins)).astype("int64")
        ok = filled[row, source]
        values[row[ok], col[ok]] = values[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    return values


def band_keys(sets: list[np.ndarray], n_bands: int) -> np.ndarray:
    v = densified(sets, n_bands * ROWS).reshape(len(sets), n_bands, ROWS)
    keys = np.arange(n_bands, dtype="uint64")[None, :] * STEPS[2]
    for j in range(ROWS):
        keys = mix(keys + v[:, :, j] * STEPS[j])
    return keys.view("int64")


def _texts(batch, column: int, most: int = 1_000_000):
    """Positions and UTF-8 bytes of a batch's texts, some megabytes at a time; null is empty."""
    at, got, size = [], [], 0
    for i, x in enumerate(batch.column(column)):
        at.append(i)
        got.append((x.as_py() or "").encode("utf-8", "replace"))
        size += len(got[-1])
        if size >= most:
            yield at, got
            at, got, size = [], [], 0
    if at:
        yield at, got


def sketches(docs: DataFrame, n_bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set) and the band keys (none if empty)."""

    def sketch(batches):
        for batch in batches:
            for at, texts in _texts(batch, 1):
                sets = shingle_sets(texts)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys([sets[i] for i in some], n_bands)
                bands: list = [None] * len(sets)
                for i, k in zip(some, keys.tolist()):
                    bands[i] = k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    def build(batches):
        for batch in batches:
            for at, texts in _texts(batch, 1):
                sets = shingle_sets(texts)
                values = pa.array(np.concatenate(sets).view("int64"))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("int32"))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(offsets, values)], names=["id", "shingles"])

    return docs.select("id", "text").mapInArrow(build, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.join(b, "v").join(a, "u")
    common = F.size(F.array_intersect("su", "sv"))
    return both.filter(100 * common >= similar * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _could(most, n: str, m, similar: int):
    """Sets of n and m shingles with ``most`` in common at most are not ruled out by that."""
    most = F.col(most) if isinstance(most, str) else most
    return 100 * most >= similar * (F.col(n) + m - most)


def lone_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, lone: how many shingles of each member no other member has."""
    asked = sets.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    held = asked.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    return held.filter("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))


def parities(members: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, parity: one bit for each of `PARITY` residues, whether an odd number of the member's shingles have it.
    The bits in which two members differ are at most as many as the shingles that only one of them has."""
    asked = sets.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "shingles")

    def fold(batches):
        for batch in batches:
            got = [np.packbits(np.bincount(x.values.to_numpy() & (PARITY - 1), minlength=PARITY) & 1 == 1).view("int64") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["rep", "parity"])

    return stored(asked.mapInArrow(fold, "rep long, parity array<long>"), "parity")


def _differ(a: str, b: str):
    """At least so many shingles are in one of two members only."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda n, x: n + x)


def _block_pairs(similar: int):
    """Compares the rows of a block that stand left with those that stand right, as `near_duplicates` does with the
    rows of a small bucket: other components, sizes, shared shingles, parities, and each pair in its first key."""

    def could(most, n, m):
        return 100 * most >= similar * (n + m - most)

    def compare(block):
        key, main = block["key"][0].as_py(), block["main"][0].as_py()
        rep, n, e, label = (block[c].to_numpy() for c in ("rep", "n", "e", "label"))
        parity = block["parity"].combine_chunks().flatten().to_numpy().view("uint64").reshape(len(rep), -1)
        keys, left = block["keys"].to_pylist(), block["left"].to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        met: dict[int, set] = {}
        keys_of = lambda i: met.get(i) or met.setdefault(i, set(keys[i]))
        us, vs = [], []
        for i in a.tolist():
            j = b[(label[b] != label[i]) & ((label[b] == main) | (rep[i] < rep[b])) & could(np.minimum(e[i], e[b]), n[i], n[b])]
            differ = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype="int64")
            j = j[could((n[i] + n[j] - differ) // 2, n[i], n[j])]
            for k in j.tolist():
                if min(keys_of(i) & keys_of(k)) == key:
                    us.append(rep[i])
                    vs.append(rep[k])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return compare


def block_pairs(rows: DataFrame, similar: int) -> DataFrame:
    """u, v: the pairs of large buckets. Members outside the largest component are dealt into blocks, all members into
    others; every block of the first meets every block of the second in one task."""
    counts = rows.groupBy("key").agg(
        F.ceil(F.count(F.when(F.col("label") != F.col("main"), 1)) / BLOCK).cast("int").alias("lefts"), F.ceil(F.count(F.lit(1)) / ACROSS).cast("int").alias("rights"))
    rows = rows.join(counts.filter("lefts > 0"), "key")
    part = lambda side: F.pmod(F.xxhash64("rep"), F.col(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    columns = ["key", "rep", "n", "e", "label", "main", "keys", "parity"]
    left = rows.filter("label != main").select(*columns, F.lit(True).alias("left"), part("lefts").alias("i"), every("rights").alias("j"))
    right = rows.select(*columns, F.lit(False).alias("left"), every("lefts").alias("i"), part("rights").alias("j"))
    return left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_block_pairs(similar), "u long, v long")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Links: 100 * intersection >= ``similar`` * union of the shingle sets. Null, empty and blank texts have no
    shingles and are alone. Rows that repeat a doc_id get that document's component. A null doc_id
    is alone unless its text has copies. No documents give no rows."""
    sk = stored(sketches(docs, bands_for(similar)), "sketches")
    filled = sk.filter("n_shingles > 0")
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.filter("rep is not null"), "classes")
    entries = classes.select("rep", "n", F.explode("bands").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(entries.join(sizes, "key"), "buckets")
    central = buckets.groupBy("rep").agg(F.sum("size").alias("central"))
    buckets = stored(buckets.join(central, "rep").select("key", "rep", "n", "central"), "central")
    docs_in = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = stored(full_sets(docs_in.join(central.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])), "sets")

    # `e`: the shingles that some other document still in question has too; no pair has more in common
    buckets = buckets.withColumn("e", F.col("n"))
    edges = labels = done = parity = None
    while True:
        # members with their present component; a bucket goes on while it holds more than one
        now = buckets.withColumn("label", F.col("rep"))
        if labels is not None:
            now = buckets.join(labels, buckets["rep"] == labels["node"], "left").select(*buckets.columns, F.coalesce("label", "rep").alias("label"))
        state = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max(F.struct("central", (-F.col("rep")).alias("first"), "n", "e", "label")).alias("hub"))
        state = state.groupBy("key").agg(
            F.sum("size").alias("members"), F.max(F.struct("size", "label")).alias("main"), F.min("least").alias("least"), F.max("hub").alias("hub"))
        # outside the largest component there are `members - main.size`: only they can still link two
        few = F.col("members") <= SMALL_BUCKET if done is None else F.lit(True)
        large = F.lit(False) if done is None else (F.col("members") - F.col("main.size")) * F.col("members") > COMPARISONS
        state = state.filter("main.size < members").withColumn("few", few).withColumn("large", large).withColumn("main", F.col("main.label"))
        now = now.join(state.select("key", "main", "least", "hub", "few", "large"), "key")
        now = stored(now.filter(_could("e", "n", F.greatest("least", "e"), similar)), "open")
        if not now.take(1):
            break
        star = now.filter(~F.col("few") & (F.col("rep") != -F.col("hub.first")) & (F.col("label") != F.col("hub.label")))
        star = star.filter(_could(F.least("e", "hub.e"), "n", F.col("hub.n"), similar)).select((-F.col("hub.first")).alias("u"), F.col("rep").alias("v"))
        ending = now.filter("few").select("key", "rep", "n", "e", "label", "main", "large")
        # two members meet in several buckets: the first one counts
        met = ending.groupBy("rep").agg(F.collect_set("key").alias("keys"))
        ending = ending.join(met, "rep")
        if done is not None:
            ending = ending.join(parity, "rep")
        blocks, ending = ending.filter("large"), ending.filter(~F.col("large"))
        other = ending.select(F.col("key"), *[F.col(c).alias(c + "2") for c in ending.columns if c not in ("key", "main", "large")])
        once = (F.col("label2") == F.col("main")) | (F.col("rep") < F.col("rep2"))
        able = (F.col("label") != F.col("label2")) & _could(F.least("e", "e2"), "n", F.col("n2"), similar)
        if done is not None:
            able &= _could(F.floor((F.col("n") + F.col("n2") - _differ("parity", "parity2")) / 2), "n", F.col("n2"), similar)
        first = F.array_min(F.array_intersect("keys", "keys2")) == F.col("key")
        rest = ending.filter("label != main").join(other, "key").filter(once & able & first)
        pairs = star.unionByName(rest.select(F.col("rep").alias("u"), F.col("rep2").alias("v")))
        if done is not None:
            pairs = pairs.unionByName(block_pairs(blocks, similar))
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = confirmed(pairs, sets, similar)
        edges = found if labels is None else labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(found)
        labels = components(edges)
        buckets = now.filter(~F.col("few") & (F.col("rep") != -F.col("hub.first"))).select("key", "rep", "n", "central", "e")
        if done is None:
            alone, parity = lone_shingles(buckets, sets), parities(buckets, sets)
            buckets = stored(buckets.drop("e").join(alone, "rep", "left").select("key", "rep", "n", "central", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("e")), "left")
        done = pairs if done is None else done.unionByName(pairs)

    if labels is None:
        labels = classes.select(F.col("rep").alias("node"), F.col("rep").alias("label")).limit(0)
    members = classes.select("set_key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(
        "set_key", F.coalesce("label", "rep").alias("component"))
    out = sk.select("doc_id", "n_shingles", "set_key").join(members, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
"""

OP8_SQL = "WITH RECURSIVE " + _SHINGLES.strip() + """
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, b.v FROM r JOIN b ON b.u = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
