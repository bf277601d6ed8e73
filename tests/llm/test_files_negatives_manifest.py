"""Token files, hard negatives and the Merkle manifest against brute-force versions."""
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pytest

from basketflow.llm import merkle, negatives, packing, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "d", "épsilon", "zeta\n"]) for _ in range(n))


# ---- token files ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    codes = (rng.integers(0, 2**32, n, dtype="uint64") >> rng.integers(0, 32, n, dtype="uint64")).astype("<u4")
    control, data = token_files.encode(codes)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(c).bit_length() // 8)) for c in codes)
    assert (token_files.decode(control, data, n) == codes).all()
    if n:
        with pytest.raises(ValueError):
            token_files.decode(control, data + b"x", n)


def test_file_has_random_access_and_refuses_a_cut_file():
    class Kept(io.BytesIO):
        def close(self):
            self.whole = self.getvalue()

        def size(self):
            return len(self.getvalue())

    rng, out = np.random.default_rng(1), Kept()
    codes, writer = rng.integers(0, 70_000, 200_000).astype("<u4"), token_files.Writer(out)
    lengths = [0, 1, 150_000, 49_999]
    at = 0
    for doc_id, n in zip([None, 5, -7, 2**40], lengths):
        writer.add([doc_id], np.array([n]), codes[at:at + n])
        at += n
    writer.close()
    ids = np.arange(70_000, dtype="<u4")[::-1].copy()
    reader = token_files.Reader(Kept(out.whole), ids)
    assert (reader.ids_between(65_530, 70_000) == ids[codes[65_530:135_530]]).all() and not len(reader.ids_between(200_000, 5))
    got = [(d, n, b) for docs, ns, bs in reader.documents(1000) for d, n, b in zip(docs, ns.tolist(), bs)]
    assert [(d, n) for d, n, _ in got] == list(zip([None, 5, -7, 2**40], lengths))
    assert b"".join(b for _, _, b in got) == ids[codes].tobytes()
    with pytest.raises(ValueError):
        token_files.Reader(Kept(out.whole[:-40] + out.whole[-36:]), ids)


def expected_tokens(rows):
    from tokenizers import Tokenizer
    tok, start, out = Tokenizer.from_file(packing.tokenizer_path()), 0, []
    got = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    for doc_id, ids in sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]))):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op11_round_trip(spark, folder):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "Don't STOP. naïve Ünïcode — 日本語 👍 İx \x1c\x85 <|endoftext|>", "same", "same", "z" * 50_000, prose(rng, 30_000), *[prose(rng, rng.randint(1, 300)) for _ in range(80)]]
    rows = [(i * 3 - 20, t, "en", "s", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = token_files.op11_ranked_token_files(spark, folder(documents=(rows, DOCS))).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected_tokens(rows))


def test_token_files_with_null_repeated_and_clashing(spark):
    rows = [(None, "a b", 1), (None, None, 2), (7, "a b c", 3), (7, "a", 4), (7, "a", 5), (1, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int").withColumnRenamed("ids", "start")
    manifest = token_files.write_token_files(docs, packing.tokenizer_path())
    got = token_files.read_token_files(manifest).collect()
    assert sorted([(str(r.doc_id), r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got]) == sorted((str(a), *b) for a, *b in expected_tokens(rows))
    assert sum(r.n_docs for r in manifest.collect()) == 6
    first = manifest.orderBy("part").first()
    assert token_files.open_file(first.path, first.vocabulary).n_tokens == first.n_tokens
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), packing.tokenizer_path())).count() == 0


def test_ranks_follow_counts(spark):
    tokens = spark.createDataFrame([(np.array(x, "<u4").tobytes(),) for x in ([5, 5, 9], [9, 300000], [], [9, 5, 1])], "ids binary")
    assert token_files.ranked_vocabulary(tokens, "<u4").tolist() == [5, 9, 1, 300000]


# ---- hard negatives ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("size,dims", [(3, 1), (256, 64), (40_000, 3000), (2**62, 5)])
def test_residue_products_are_exact(size, dims):
    rng = random.Random(size)
    a = np.array([[rng.randint(-size, size) for _ in range(dims)] for _ in range(4)], "int64")
    b = np.array([[rng.randint(-size, size) for _ in range(dims)] for _ in range(6)] + [[-size] * dims, [size] * dims], "int64")
    exact = a.astype(object) @ b.T.astype(object)
    assert (negatives.scores(a, b) == exact).all() and (negatives.scores(b, b) == b.astype(object) @ b.T.astype(object)).all()
    assert len(negatives.moduli(size * size * dims)) > 1 or size < 4


def brute_negatives(rows):
    use = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, anchors = [], {}
    for i, lab, v in use:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    for i, (lab, v) in anchors.items():
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in use if len(w) == len(v)]
        for ps, pj, _ in sorted([s for s in scored if s[2] == lab and s[1] != i], key=lambda s: (-s[0], s[1]))[:5]:
            inside = sorted([s for s in scored if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps], key=lambda s: (-s[0], s[1]))[:10]
            out += [(i, pj, r + 1, j, ps, s) for r, (s, j, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("components", [1 << 20, 100])
def test_op12(spark, folder, components):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0.1, 0.4))) for _ in range(8)], rng.randint(0, 2)) for i in range(420)]
    rows += [(500 + i, [0.5] * 8, i % 3) for i in range(40)]  # ties
    rows += [(600, [0.5] * 8, 1), (600, [0.5] * 8, 1), (600, [0.25] * 8, 0), (601, None, 1), (602, [None] * 8, 1), (603, [float("nan")] * 8, 1),
             (604, [float("inf")] * 8, 2), (605, [0.5] * 8, None), (None, [0.5] * 8, 1), (700, [0.1, 0.2], 1), (701, [0.3, 0.2], 1), (702, [0.2, 0.1], 2),
             (800, [], 1), (801, [], 1), (802, [], 2), (900, [-0.5] * 8, 1)]
    d = folder(embeddings=(rows, VECTORS))
    from pyspark.sql import functions as F
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("label", label).withColumn("side", F.lit("x"))
    got = negatives.mine(negatives.usable(vectors), F.col("vec_id") % 100 == 0, slice_components=components)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    if components > 100:
        assert sorted(map(tuple, negatives.op12_residue_hard_negatives(spark, d).collect())) == brute_negatives(rows)
        assert negatives.mine(negatives.usable(vectors.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


# ---- Merkle manifest --------------------------------------------------------------------------------------

def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def whole_tree(nodes):
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i:i + 3]
            for j in range(len(run)):
                for leaf in below[i + j]:
                    paths[leaf].append((j, run[:j] + run[j + 1:]))
            above.append(H(run))
            held.append(sum(below[i:i + 3], []))
        nodes, below = above, held
    return nodes[0], paths


def brute_manifest(rows):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    by = {}
    for doc_id, text, lang, source, n in rows:
        leaf = H(map(value, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        by.setdefault(source, []).append((doc_id, leaf, H(map(value, (doc_id, source, lang, n, text.replace("\n", "")))) if hit else leaf))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = whole_tree([x[1] for x in by[s]])
    root, tops = whole_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (doc_id, leaf, other), path in zip(by[s], trees[s][1]):
            h = other
            for j, run in [*path, *top]:
                h = H([*run[:j], h, *run[j:]])
            out.append((doc_id, leaf, trees[s][0], root, H(sum((run for _, run in [*path, *top]), [])), h, h == root))
    return sorted(out, key=str)


def manifest_rows(n, rng):
    rows = [(i, "line\nline " * (i % 3), rng.choice([None, "en"]), rng.choice(["hot"] * 5 + ["b", "é", "", None, "z%d" % (i % 9)]), i) for i in range(n)]
    rows += [(None, "x", "en", "hot", 1), (None, None, None, None, None), (3, "again", "en", "hot", 2), (3, "again", "en", "hot", 2), (n + 5, "long\n" * 40_000, "de", "alone", 0)]
    rng.shuffle(rows)
    return rows


def test_op13(spark, folder):
    rows = manifest_rows(300, random.Random(2))
    got = merkle.op13_butterfly_manifest(spark, folder(documents=(rows, DOCS))).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(rows)


@pytest.mark.parametrize("block_levels,n", [(1, 250), (2, 130)])
def test_exchange_gives_every_block_its_upper_proof(spark, block_levels, n):
    """Many rounds, short last subgroups, trees of every size up to 30 and one of ``n``."""
    rows = [(t, i, H([f"{t}/{i}"])) for t, size in [*((f"t{k:02}", k) for k in range(1, 31)), ("u", n)] for i in range(size)]
    leaves = spark.createDataFrame(rows, "tree string, item long, digest string").repartition(5)
    from pyspark.sql import functions as F
    got = merkle.manifest(leaves, ["item"], block_levels).withColumn("folded", merkle.fold(F.col("digest"), F.col("levels"))).collect()
    names = sorted({t for t, _, _ in rows})
    trees = {t: whole_tree([d for u, _, d in rows if u == t]) for t in names}
    root, tops = whole_tree([trees[t][0] for t in names])
    assert len(got) == len(rows)
    for r in got:
        path = [*trees[r.tree][1][r["item"]], *tops[names.index(r.tree)]]
        assert (r.subroot, r.root, r.folded) == (trees[r.tree][0], root, root)
        assert [(x.pos, x.siblings) for x in r.levels] == [(j, "".join(run)) for j, run in path]


def test_manifest_empty_and_clashing(spark):
    none = spark.createDataFrame([], "tree string, item long, digest string")
    assert merkle.manifest(none, ["item"]).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(none.withColumnRenamed("item", "pos"), ["pos"])
    docs = spark.createDataFrame([(1, "a\nb", "en", "s", 3, "mine")], "doc_id int, text string, lang string, source string, n_chars int, root string")
    one = merkle.manifest(merkle.document_leaves(docs), ["doc_id"]).first()
    assert one.subroot == one.digest == one.root and one.levels == []
