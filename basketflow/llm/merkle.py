"""Merkle dataset manifest by a butterfly exchange.

Rows are numbered in order within their tree, and every run of `FANOUT` to the power of `BLOCK_LEVELS`
consecutive leaves is a block: it hashes its own part of the tree alone. From then on the blocks of one tree
exchange subtree roots round by round. In round r, groups of `FANOUT` neighbouring subgroups of
``FANOUT ** r`` blocks swap: each block sends the root that it holds to its counterpart in each
sibling subgroup (a short last subgroup serves several), and every block hashes the group's root itself. So
after the last round each block holds the tree's root and all siblings on its upper path, and no proof ever
travels down. The trees' roots are the leaves of one more tree, built the same way, whose root covers
the dataset.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketflow.llm.common import stored, table

FANOUT = 3
#: levels that a block hashes alone: it has up to 3 ** 7 = 2,187 leaves
BLOCK_LEVELS = 7
LEVELS = "array<struct<pos:int,siblings:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(value: Column) -> Column:
    """A string that is never null and sorts nulls first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


# ---- one tree's part in a block ---------------------------------------------------------------------------

def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(nodes: list[str], levels: int) -> tuple[str, list[list[tuple[int, str]]]]:
    """The root of ``levels`` levels over the nodes and, for each node, its position in its run and the
    run's other digests, level by level."""
    proofs: list[list[tuple[int, str]]] = [[] for _ in nodes]
    width = 1
    for _ in range(levels):
        above = []
        for i in range(0, len(nodes), FANOUT):
            run = nodes[i:i + FANOUT]
            for j in range(len(run)):
                step = (j, "".join(run[:j] + run[j + 1:]))
                for leaf in range((i + j) * width, min((i + j + 1) * width, len(proofs))):
                    proofs[leaf].append(step)
            above.append(hashed(run))
        nodes, width = above, width * FANOUT
    return nodes[0], proofs


# ---- numbering --------------------------------------------------------------------------------------------

def numbered(leaves: DataFrame, order: list[str], block_levels: int) -> DataFrame:
    """``leaves`` (tree, digest, others) with ``pos`` (0.. within the tree, by ``order``, then digest), the
    tree's ``size``, its ``block`` and number of ``blocks`` and the ``own`` levels of a block. Range partitions are sorted in parallel, so a tree
    with a third of all rows is many tasks; a tree's first position in a partition comes from one
    count for each partition and tree."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order, "digest"]
    salted = leaves.withColumn("_salt", F.monotonically_increasing_id())
    placed = salted.repartitionByRange(parts, *by, "_salt").sortWithinPartitions(*by, "_salt")
    placed = stored(placed.drop("_salt").withColumn("_mid", F.monotonically_increasing_id()), "leaves").withColumn("_part", F.shiftright("_mid", 33))
    sizes = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_n").over(Window.partitionBy("tree"))
    sizes = stored(sizes.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), whole.alias("size")), "sizes")
    pos = (F.col("_mid") - F.col("_first") + F.col("_before")).alias("pos")
    span = F.lit(FANOUT**block_levels)
    own = sum(((F.col("size") > FANOUT**i).cast("int") for i in range(block_levels)), F.lit(0))
    got = placed.join(sizes, ["tree", "_part"]).select(*leaves.columns, pos, "size")
    return got.withColumn("block", F.floor(F.col("pos") / span).cast("long")).withColumn("blocks", F.ceil(F.col("size") / span).cast("long")).withColumn("own", own)


def block_roots(leaves: DataFrame) -> DataFrame:
    """tree, block, blocks and the root of every block of a numbered table."""

    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        top, _ = climb(rows["digest"].to_pylist(), rows["own"][0].as_py())
        return pa.table({"tree": rows["tree"].slice(0, 1), "block": rows["block"].slice(0, 1), "blocks": rows["blocks"].slice(0, 1), "root": [top]})

    return leaves.select("tree", "block", "blocks", "own", "pos", "digest").groupBy("tree", "block").applyInArrow(root, "tree string, block long, blocks long, root string")


# ---- the exchange -----------------------------------------------------------------------------------------

def exchange(state: DataFrame, span: int) -> DataFrame:
    """One round: subgroups of ``span`` blocks meet in groups of `FANOUT`. Each block sends its root to itself
    and to its counterparts, and gets one root from every subgroup of its group."""
    block, blocks = F.col("block"), F.col("blocks")
    slot = F.pmod(F.floor(block / span), F.lit(FANOUT)).cast("int")
    first = block - F.pmod(block, F.lit(span * FANOUT))
    offset = F.pmod(block, F.lit(span))

    def size(s):
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(span).cast("long"), blocks - first - s * span))

    def targets(s):
        # a subgroup shorter than its sibling serves the sibling's further blocks too
        theirs = F.transform(F.sequence(offset, size(s) - 1, size(slot)), lambda o: first + s * span + o)
        return F.when(s == slot, F.array(block)).when(size(s) > offset, theirs).otherwise(F.array().cast("array<bigint>"))

    everyone = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), targets))
    target = F.when(blocks > span, everyone).otherwise(F.array(block))
    sent = state.select("tree", "blocks", "block", "root", "levels", slot.alias("slot"), F.explode(target).alias("target"))
    own = F.when(F.col("target") == F.col("block"), F.struct("slot", "levels", "root"))
    met = sent.groupBy("tree", "target").agg(F.max("blocks").alias("blocks"), F.first(own, ignorenulls=True).alias("own"),
                                             F.sort_array(F.collect_list(F.struct("slot", "root"))).alias("run"))
    others = F.array_join(F.transform(F.filter("run", lambda x: x["slot"] != F.col("own.slot")), lambda x: x["root"]), "")
    step = F.array(F.struct(F.col("own.slot").alias("pos"), others.alias("siblings")))
    goes_on = F.col("blocks") > span
    return met.select(
        "tree", F.col("target").alias("block"), "blocks",
        F.when(goes_on, digest(F.array_join(F.transform("run", lambda x: x["root"]), ""))).otherwise(F.col("own.root")).alias("root"),
        F.when(goes_on, F.concat("own.levels", step.cast(LEVELS))).otherwise(F.col("own.levels")).alias("levels"),
    )


def butterfly(roots: DataFrame) -> DataFrame:
    """tree, block, blocks, root (the whole tree's, in every block) and levels (position and siblings
    on the block's path above it). As many rounds as the largest tree needs; a round is written to the
    shared folder, so a lost executor costs one round."""
    state = stored(roots.withColumn("levels", F.array().cast(LEVELS)), "blocks")
    most = state.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        state = stored(exchange(state, span), "exchanged")
        span *= FANOUT
    return state


def proofs(leaves: DataFrame, states: DataFrame, roots: list[str]) -> DataFrame:
    """All columns of the numbered ``leaves`` with the state's ``roots`` and ``levels`` from the leaf upwards."""
    keyed = states.select("tree", "block", *roots, "levels")
    schema = StructType([*leaves.schema.fields, *keyed.schema.fields[2:]])
    names = [f.name for f in schema]

    def prove(rows: pa.Table, state: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        _, paths = climb(rows["digest"].to_pylist(), rows["own"][0].as_py())
        above = [(x["pos"], x["siblings"]) for x in state["levels"][0].as_py()]
        level = pa.struct([("pos", pa.int32()), ("siblings", pa.string())])
        levels = pa.array([[{"pos": p, "siblings": s} for p, s in [*path, *above]] for path in paths], pa.list_(level))
        for root in roots:
            rows = rows.append_column(root, pa.array([state[root][0].as_py()] * len(rows), pa.string()))
        return rows.append_column("levels", levels).select(names)

    return leaves.groupBy("tree", "block").cogroup(keyed.groupBy("tree", "block")).applyInArrow(prove, schema)


def fold(leaf: Column, levels: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(h, x):
        at = x["pos"] * 64
        return digest(F.substring(x["siblings"], F.lit(1), at), h, F.substring(x["siblings"], at + 1, F.length(x["siblings"])))

    return F.aggregate(levels, leaf, up)


def manifest(leaves: DataFrame, order: list[str], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``leaves`` (columns tree, digest and others) with ``subroot`` (of its tree), ``root`` (of all trees, in
    the order of ``tree``) and ``levels``: position and siblings of every level from the leaf to the root.

    ``tree`` must not be null (`tree_key`). Leaves of a tree ascend by ``order``, nulls first, ties by digest;
    equal rows are leaves of their own. A tree of one leaf is that leaf. An empty table gives no rows."""
    taken = {"pos", "size", "block", "blocks", "own", "root", "levels", "subroot"} & {c.lower() for c in leaves.columns}
    if taken:
        raise ValueError(f"columns of the manifest's own: {sorted(taken)}")
    inner = numbered(leaves, order, block_levels)
    states = butterfly(block_roots(inner))
    trees = states.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    outer = numbered(trees, ["name"], block_levels)
    tops = proofs(outer, butterfly(block_roots(outer)), ["root"])
    tops = tops.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("levels").alias("upper"))
    whole = states.drop("root").join(tops, "tree").withColumn("levels", F.concat("levels", "upper"))
    return proofs(inner, whole, ["subroot", "root"]).select(*leaves.columns, "subroot", "root", "levels")


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and ``tampered`` (the leaf after the text lost its line feeds where 2 divides the
    doc_id's crc32; a null doc_id or text is not tampered with) of every row; other columns are ignored."""
    def leaf(text):
        return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))

    text = F.col("text")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    got = docs.select(tree_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("digest"),
                      F.when(hit, leaf(F.translate(text, "\n", ""))).alias("_other"))
    return got.select("tree", "doc_id", "digest", F.coalesce("_other", "digest").alias("tampered"))


def op13_butterfly_manifest(spark, sf_dir: str) -> DataFrame:
    got = manifest(document_leaves(table(spark, sf_dir, "documents")), ["doc_id"])
    siblings = F.array_join(F.transform("levels", lambda x: x["siblings"]), "")
    folded = fold(F.col("tampered"), F.col("levels"))
    got = got.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


_SQL_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _SQL_FIELD + ")"


def _sql_steps(nodes: str) -> str:
    """Each node's siblings: those before and those behind it in its run."""
    return f"""SELECT a.name, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') || '|' ||
                      coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS step
               FROM {nodes} a JOIN {nodes} b ON a.name = b.name AND a.level = b.level AND a.pos // 3 = b.pos // 3
               WHERE a.n > 1 GROUP BY a.name, a.level, a.pos"""


def _sql_nodes(leaves: str, nodes: str) -> str:
    return f"""SELECT name, 0 AS level, pos, digest, n FROM {leaves}
               UNION ALL
               SELECT name, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 2) // 3)
               FROM {nodes} WHERE n > 1 GROUP BY name, level, pos // 3"""


OP13_SQL = f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
                        UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT d.*, coalesce('=' || source, '-') AS name, {_SQL_LEAF.format("text")} AS digest, {_SQL_LEAF.format("replace(text, chr(10), '')")} AS other,
                xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                                            lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]))) AS check
         FROM documents d, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY name) AS n FROM docs),
nodes AS ({_sql_nodes("leaves", "nodes")}),
tops AS (SELECT '' AS name, name AS source_name, digest, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS ({_sql_nodes("tops", "upper_nodes")}),
steps AS ({_sql_steps("nodes")}),
upper_steps AS ({_sql_steps("upper_nodes")}),
path AS (SELECT l.name, l.pos, s.level, s.step FROM leaves l JOIN steps s ON s.name = l.name AND s.pos = l.pos // (3 ** s.level)::BIGINT
         UNION ALL
         SELECT l.name, l.pos, 1000 + s.level, s.step FROM leaves l JOIN tops t ON t.source_name = l.name JOIN upper_steps s ON s.pos = t.pos // (3 ** s.level)::BIGINT),
paths AS (SELECT name, pos, list(step ORDER BY level) AS steps FROM path GROUP BY name, pos),
folded AS (SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, coalesce(p.steps, []) AS steps,
                  CASE WHEN l.check % 2 = 0 AND l.text IS NOT NULL THEN l.other ELSE l.digest END AS start
           FROM leaves l JOIN tops t ON t.source_name = l.name LEFT JOIN paths p ON p.name = l.name AND p.pos = l.pos)
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
       list_reduce([start] || steps, lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root,
       folded_root = r.digest AS verified
FROM folded, (SELECT digest FROM upper_nodes WHERE n = 1) r
"""
