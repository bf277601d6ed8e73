"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns."""
import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketflow.llm import decontaminate, language, licences, main_text, near_dedup, packing, pii, repeats, sharding, vectors
from basketflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(400)]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables for a query and returns their folder."""
    def write(**tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


# ---- sharding -------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 39, 41, 1000])
def test_feistel_is_a_bijection_with_inverse(spark, n):
    from pyspark.sql import functions as F
    shard, slot = sharding.place_of(F.col("id"), max(n, 1), 7)
    got = spark.range(n).select("id", shard.alias("shard"), slot.alias("slot"))
    got = got.withColumn("back", sharding.row_of(F.col("shard"), F.col("slot"), max(n, 1), 7)).collect()
    assert all(r["id"] == r["back"] for r in got)
    assert len({(r["shard"], r["slot"]) for r in got}) == n
    counts = Counter(r["shard"] for r in got)
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(c)) for s, c in counts.items())


def test_op10(spark, folder):
    texts = [None, "", "é" * 10, "same", "same", "x" * 200_000, *[prose(5) for _ in range(95)]]
    d = folder(documents=(rows(texts), DOCS))
    got = {r["doc_id"]: r for r in sharding.op10_feistel_shards(spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    counts = Counter(r["shard"] for r in got.values())
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op10_feistel_shards(spark, d).repartition(3).collect()}
    assert again == {i: (r["shard"], r["slot"]) for i, r in got.items()}


def test_sharding_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 9), (None, None, 8), (1, "a", 9)], "doc_id long, text string, shard int")
    got = sharding.shard_rows(df, ["doc_id", "text"], 2).collect()
    assert len(got) == 3 and sorted(r["row"] for r in got) == [0, 1, 2]
    assert sharding.shard_rows(df.limit(0), ["doc_id"], 2).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(df, ["doc_id"], 0)


# ---- near duplicates: pairs of unlike members of one bucket -----------------------------------------

def test_parity_never_exceeds_the_difference(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, 300)
    sets = [base, np.concatenate([base[:250], rng.integers(-2**62, 2**62, 60)]), base[:1], rng.integers(-2**62, 2**62, 5000), np.empty(0, "int64")]
    df = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "id long, shingles array<long>")
    got = near_dedup.parities(df.select(F.col("id").alias("rep")), df)
    pairs = got.alias("a").crossJoin(got.alias("b")).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y"), near_dedup._differ("a.parity", "b.parity").alias("d")).collect()
    for r in pairs:
        true = len(set(sets[r.x].tolist()) ^ set(sets[r.y].tolist()))
        assert 0.8 * min(true, 150) <= r.d <= true or true > 1000


def test_templated_documents_make_few_pairs(spark, monkeypatch):
    """Documents of one template with lines from a shared pool are alike, but none is a near duplicate."""
    rng = random.Random(11)
    pool = [prose(9, rng) for _ in range(60)]
    common = [prose(40, rng) for _ in range(7)]
    texts = ["\n".join(common + rng.sample(pool, 6)) for _ in range(250)]
    seen = []
    confirmed = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *a: (seen.append(pairs.count()), confirmed(pairs, *a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 85).collect()}
    shingled = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [(i, j) for i in range(250) for j in range(i) if 100 * len(shingled[i] & shingled[j]) >= 85 * len(shingled[i] | shingled[j])]
    assert all(got[i] == got[j] for i, j in alike) and len(set(got.values())) >= 250 - len(alike)
    assert sum(seen) <= 20 * len(texts)


# ---- packing ---------------------------------------------------------------------------------------

def test_differencing_is_balanced():
    rng = random.Random(1)
    for n in (1, 2, 7, 60):
        lengths = [rng.randint(1, 256) for _ in range(n)]
        got = packing.windows(lengths, 2048)
        assert sorted(i for w in got for i in w) == list(range(n))
        assert max(sum(lengths[i] for i in w) for w in got) <= 2048
    assert packing.difference([8, 7, 6, 5, 4], 2) and packing.windows([], 10) == []
    # 8+6 against 7+5+4: the known result of differencing on this set
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_window_count_rises():
    assert len(packing.windows([60, 60, 60], 100)) == 3


def test_op3_round_trip(spark, folder):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = [None, "", "  \n", "Don't STOP. naïve Ünïcode — 日本語 👍 İx", prose(9000), "same text", "same text", "a" * 5000, *[prose(RNG.randint(1, 900)) for _ in range(60)]]
    got = packing.op3_karmarkar_karp_packing(spark, folder(documents=(rows(texts), DOCS))).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    total = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
    assert total / (2048 * len(by_seq)) > 0.9


def test_words_used_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(packing, "WORD_CACHE", 40)
    ids, asked = packing.WordIds(packing.tokenizer_path()), []
    merge = ids.merge
    ids.merge = lambda word: asked.append(word) or merge(word)
    for i in range(0, 300, 10):  # ten new words and an old one each time: more than are kept
        text = " ".join(["internationally", *(chr(97 + j // 26) + "q" + chr(97 + j % 26) for j in range(i, i + 10))])
        assert ids.texts(pa.array([text])) == [ids._whole(text)]
    assert asked.count("internationally") == 1 and len(ids.known) + len(ids.older) < 80


def test_word_ids_are_those_of_the_whole_text():
    texts = ["", " \t", " a\x0bb\x0cc\td\re\nf ", "a\x1cb\x1fc\x85d\xa0e\u3000f", "Straße, NAÏVE. ªº µm ÿ Ÿ 中文 字。 don't x.y ,", "\x00 a. . a,"]
    ids = packing.WordIds(packing.tokenizer_path())
    assert ids.texts(pa.array(texts)) == [ids._whole(t) for t in texts]
    assert ids.texts(pa.array(texts)[2:4]) == [ids._whole(t) for t in texts[2:4]]
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4], "text": ["ab", None, "abcdef", "ü"]})
    assert [(d, t.to_pylist()) for d, t in packing.some(batch, 4)] == [([1, 2], ["ab", ""]), ([3], ["abcdef"]), ([4], ["ü"])]


def test_pack_edges(spark):
    empty = spark.createDataFrame([], packing.PIECES)
    assert packing.pack(empty).count() == 0
    twice = spark.createDataFrame([(1, 0, 5, 9, 5)] * 2, packing.PIECES)
    assert sorted(r["offset"] for r in packing.pack(twice).collect()) == [0, 5]
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 5000, 9, 5000)], packing.PIECES))


# ---- near duplicates -------------------------------------------------------------------------------

def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(5)
    texts = [None, "", " \t ", "One two", "one  TWO", "one two three four", "É É", "é é", "x" * 100_000]
    for size in (12, 40, 150):
        base = prose(size, rng).split()
        for _ in range(45):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 12])):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts.append(" ".join(t))
    texts += [prose(rng.randint(1, 60), rng) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def test_op8_against_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "COMPARISONS", 40)
    texts = near_texts()
    got = {r["doc_id"]: r for r in near_dedup.op8_minhash_near_dedup(spark, folder(documents=(rows(texts), DOCS))).collect()}
    sizes, comp = brute_components(texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(sizes[i], comp[i], comp[i] == i) for i in range(len(texts))]


def test_large_buckets_finish_in_the_second_round(spark, monkeypatch):
    """Buckets with many members outside their largest component are compared in blocks, not one hub a round."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "COMPARISONS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 4, raising=False)
    monkeypatch.setattr(near_dedup, "ACROSS", 8, raising=False)
    confirmed, rounds = near_dedup.confirmed, []

    def counted(*a):
        rounds.append(1)
        assert len(rounds) <= 2
        return confirmed(*a)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    rng = random.Random(8)
    pool, common = [prose(9, rng) for _ in range(12)], [prose(40, rng) for _ in range(5)]
    texts = ["\n".join(common + rng.sample(pool, 6)) for _ in range(60)]
    texts += [" ".join(w for w in rng.choice(texts).split() if rng.random() > 0.01) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[1]


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "q r s t u v", 2), (9, "A b c d e f", 3)], "doc_id long, text string, rep int")
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got[1:] == [(5, 5, True), (5, 5, True), (9, 5, False)] and got[0][0] == -1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- repeated strings ------------------------------------------------------------------------------

def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, d in enumerate(data):
        for p in range(len(d) - 49):
            first.setdefault(d[p:p + 50], i)
    out = []
    for i, d in enumerate(data):
        cut = np.zeros(len(d) + 1, dtype=bool)
        for p in range(len(d) - 49):
            if first[d[p:p + 50]] < i:
                cut[p:p + 50] = True
        kept = bytes(b for b, c in zip(d, cut) if not c)
        runs = int((cut[:-1] & ~np.concatenate([[False], cut[:-1]])[:len(d)]).sum()) if len(d) else 0
        out.append((len(d), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_op4_against_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    monkeypatch.setattr(repeats, "RUN_BYTES", 9000)
    monkeypatch.setattr(repeats, "COLLECTION", 20)
    rng = random.Random(2)
    shared = [prose(30, rng) for _ in range(6)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "é" * 60, "é" * 25, "\0" * 70, "\0" * 90]
    for _ in range(70):
        t = prose(rng.randint(1, 80), rng)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 60)
            t += rng.choice([" ", "", "É"]) + p[a:a + rng.randint(30, 150)] + prose(3, rng)
        texts.append(t)
    texts += texts[20:26] + [texts[40][:300] + "é" + texts[41][:300]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op4_column_bwt_repeats(spark, folder(documents=(rows(texts), DOCS))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_op4_empty_and_repeated_rows(spark, folder):
    t = prose(40)
    d = folder(documents=([(3, t, "en", "s", 1), (3, t, "en", "s", 1), (8, t + " tail", "en", "s", 1), (None, t, "en", "s", 1)], DOCS))
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in repeats.op4_column_bwt_repeats(spark, d).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (8, len(t))]


def test_op4_work_tables_go_and_numbers_are_packed(spark, monkeypatch):
    made, write = {}, repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name, *folder: made.setdefault(name, write(df, name, *folder)))
    t = prose(60)
    _, ranges = repeats.repeated_ranges(spark.createDataFrame([(1, t), (2, "x " + t), (3, None)], "doc_id long, text string"))
    assert [r["doc_id"] for r in ranges.collect()] == [2]
    files = {name: pathlib.Path(re.sub("^file:/*", "/", df.inputFiles()[0])) for name, df in made.items()}
    assert files["ranges"].exists() and files["base"].exists()
    assert not files["hits"].parent.exists() and not files["segments"].parent.exists()
    for kind, values in (("<i8", np.arange(-5, 10**6, 1999)), ("<u4", np.arange(500)[::-1] * 7), ("u1", np.arange(50, 81).repeat(40)), ("<i8", np.array([], "int64"))):
        data = repeats._numbers(values, kind)
        assert repeats._unnumbers(data, kind).tolist() == values.tolist() and len(data) < 20 + values.astype(kind).nbytes / 2


def test_column_bwt_uses_all_byte_values():
    data = bytes(range(256)) * 2
    segs = [data[i:i + 60] for i in range(200)]
    low = np.arange(200)
    for i, m in enumerate(repeats.window_minima(segs, low)):
        assert m.tolist() == [max(0, i + o - 10) for o in range(11)]


# ---- vectors ---------------------------------------------------------------------------------------

def test_op5_against_brute_force(spark, folder, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(230, 12))]
    vecs[3], vecs[50], vecs[120], vecs[130] = None, [None] * 12, [float("nan")] * 12, [float("inf")] * 12
    vecs[60:90] = [vecs[7]] * 30  # ties
    vecs[200] = [0.0] * 12
    d = folder(embeddings=([(i, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int"))
    got = {}
    for r in vectors.op5_fagin_top_k(spark, d).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ok = {i: np.floor(256 * np.array(v)).astype("int64") for i, v in enumerate(vecs) if i not in (3, 50, 120, 130)}
    for q in (i for i in ok if i % 50 == 0):
        want = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(c, -s) for s, c in want]
    assert set(got) == {i for i in ok if i % 50 == 0}


def test_threshold_stops_early_and_big_numbers(spark):
    m = np.arange(4000, dtype="float64")[:, None] * np.ones(3)
    order = np.argsort(m, axis=0, kind="stable").T.copy()
    assert vectors.threshold_top_k(m, np.arange(4000), order, np.ones(3), 5, 2) == [(11997, 3999), (11994, 3998)]
    big = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 3]), (2, [1, 1])], "vec_id long, v array<long>")
    got = vectors.top_k(big.filter("vec_id = 0"), big, 1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1)]
    assert vectors.top_k(big.limit(0), big).count() == 0


# ---- personal data ---------------------------------------------------------------------------------

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    got = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    got += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m.group().split("."))]
    got += [("card", *m.span()) for m in re.finditer(CARD, t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    got += [("phone", *m.span()) for m in re.finditer(PHONE, t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(got, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_rules_against_plain_expressions():
    rng = random.Random(9)
    bits = ["a.b@c-d.ef", "@x.y", "a@b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.8.9.10", "4539 1488 0343 6467", "4539-1488-0343-6467", "49927398716",
            "+1 (988) 555-2485", "+12", "+1 2 3", "5", " ", ".", "-", "é", "@", "+", "0" * 30, "..", "a", "4337166598464399", "\n", "("]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == brute_base(t), t


def test_base_rules_are_linear():
    assert pii.base_spans("a" * 300_000) == pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("1." * 150_000)


def test_op1_learns_contexts(spark, folder):
    texts = [None, "", *[f"{prose(4)} write to me at user{i}@mail.example.com {prose(3)}" for i in range(8)],
             "x write to me at someone [at] mail [dot] example now", "the value 2.0 at 12:30 of 1234567 things", "y write to me at plain words"]
    got = {r["doc_id"]: r for r in pii.op1_bootstrapped_pii(spark, folder(documents=(rows(texts), DOCS))).collect()}
    hidden = texts[10].index("someone")
    assert got[10]["spans"] == f"email:{hidden}:{texts[10].index(' now')}" and got[10]["n_email"] == 0
    assert got[11]["spans"] == got[12]["spans"] == got[0]["spans"] == got[1]["spans"] == ""
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        if i < 10:
            assert got[i]["spans"] == base


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 (988) 555-2485 é", "en", "s", 9), (2, None, "en", "s", None), (None, "1.2.3.4", None, None, 7)], DOCS)
    got = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [PHONE] é" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[None]["text"] == "[IP]"
    assert pii.redacted(docs.limit(0)).count() == 0


# ---- pages -----------------------------------------------------------------------------------------

def page(body, ad, extra=""):
    return (f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></ul></nav>"
            f"<div class=\"ad\">{ad}</div><article><h1>Head &amp; {ad}</h1>{body}{extra}</article><div class='comments'><article class='comment'><p>me too</article></div>"
            f"<form><p>Name</p></form><footer>&copy; us</footer></body></html>")


def test_op2(spark, folder):
    pages = [(1, "http://h.x/a/1", page("<p>One  <b>bo</b>ld&nbsp;x<br>y<p>Two", "A")), (2, "http://h.x/a/2?q=1", page("<p>Mirror text</p>", "B", "<div>Read more</div>")),
             (3, "http://h.x/a/3", page("<p>Mirror text</p>", "C", "<div>Read more</div>")), (4, None, None), (5, "bad url", ""), (6, "http://k.y/", "<p>shared</p><p>own six"),
             (7, "http://k.y/z", "<p>shared</p><div class=sidebar>side</div><p>own seven &lt;b&gt;"), (7, "http://k.y/z", "plain")]
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.op2_nearest_url_main_text(spark, folder(pages=(pages, "page_id long, url string, html string"))).coalesce(1).collect()]
    text = {i: t for i, _, t, _ in got if i != 7}
    assert all(n == len(t) for _, _, t, n in got) and len(got) == len(pages)
    assert text[1] == "Head & A\n\nOne bold x y\n\nTwo"
    assert text[3].startswith("Head & C\n\nMirror text") and "me too" not in text[3] and "Name" not in text[3]
    assert text[4] == text[5] == ""


def test_common_subsequence_is_longest():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = main_text.common_subsequence(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and all(any(x == y for y in it) for x in (a[i] for i in sorted(got)))


def test_differencing_deletes_shared_lines_of_bare_pages():
    a, b = main_text.lines("<p>menu</p><p>mine</p><p>end</p>"), main_text.lines("<p>menu</p><p>other</p><p>end</p>")
    assert main_text.main_text(a, b) == "mine" and main_text.main_text(a, None) == "menu\n\nmine\n\nend"
    assert main_text.main_text([], a) == ""


@pytest.mark.parametrize("opens", ["<article class='post tag-search'>", "<main class='with-sidebar'>", "<div class='content no-comments'>", "<article id='social-policy'>",
                                   "<article class='post with-header'>", "<main id='search'>", "<div class='layout no-sidebar'>", "<div class='post share'>"])
def test_names_do_not_empty_an_article(opens):
    close = opens[1:].split()[0]
    html = f"<nav>menu</nav>{opens}<p>whole text</p><div class='site-footer'>foot</div><div class='main-nav'>nav</div><div id='cookie-consent-2'>c</div></{close}>"
    assert main_text.main_text(main_text.lines(html), None) == "whole text"


@pytest.mark.parametrize("opens", ["<div class='comments-area'>", "<div class='related-posts x'>", "<article role='complementary'>", "<div class='post-share'>", "<article hidden>", "<div class='masthead'>"])
def test_names_still_drop(opens):
    close = opens[1:].split()[0].rstrip(">")
    assert main_text.main_text(main_text.lines(f"<p>text</p>{opens}<p>other</p></{close}>"), None) == "text"


# ---- language --------------------------------------------------------------------------------------

def test_op6_held_out_accuracy(spark, folder):
    rng = random.Random(8)
    parts = {"en": "the ing tion er ou and", "de": "sch ein ung ich heit und", "fr": "eau que oi les é è"}
    data = []
    for i in range(240):
        lang = rng.choice(list(parts))
        data.append((i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(60)), lang, "s", 1))
    data += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "123 !?", None, "s", 0), (1003, "the ing and", None, "s", 0), (1004, "ung " * 50_000, "de", "s", 0)]
    got = {r["doc_id"]: r for r in language.op6_ftrl_language(spark, folder(documents=(data, DOCS))).collect()}
    held = [r for r in data[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in data)
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.95
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1003]["lang_pred"] == "en" and got[1004]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert language.train(docs) is None
    assert [r["lang_pred"] for r in language.predict(docs, None, ["doc_id"]).collect()] == ["und", "und"]


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = prose(300) + " É ß " + prose(20)
    whole = language.features(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    part = language.features(text)
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()


# ---- decontamination and licences -----------------------------------------------------------------

def bag(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def test_op7_against_brute_force(spark, folder):
    rng = random.Random(6)
    items = [prose(n, rng) for n in (8, 15, 30, 60)] + ["one two", None, "", "q q q q q q q q q"]
    texts = [None, "", "Q q q q q q q q q q", "say one two now", items[1].upper()]
    for _ in range(60):
        t = prose(rng.randint(0, 30), rng).split()
        w = rng.choice(items[:4]).split()
        for _ in range(rng.choice([0, 0, 1, 1, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join([*t, *w, *prose(rng.randint(0, 20), rng).split()]))
    d = folder(documents=(rows(texts), DOCS), benchmark=([(i, t) for i, t in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op7_simhash_decontamination(spark, d).collect()}
    want = set()
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for j, item in enumerate(items):
            v = (item or "").lower().split()
            for s in range(len(w) - len(v) + 1):
                a, b = bag(w[s:s + len(v)]), bag(v)
                if v and 100 * sum((a & b).values()) >= 80 * sum((a | b).values()):
                    want.add((i, j))
    assert want <= got and all(t in {x for x, _ in want} for t, _ in got)


def test_op7_changed_ends_of_one_word_in_ten(spark):
    rng = random.Random(9)
    items, texts, want = [], [], set()
    for i in range(120):
        n = rng.choice([13, 22, 40, 60, 100])
        w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        m = (n - 4) // 9  # as many as similarity 0.8 allows: (n - 4 - m) / (n - 4 + m)
        end = rng.choice([["-"] * m, [f"x{rng.randrange(10**9)}" for _ in range(m)]])
        items.append((i, " ".join(w)))
        texts.append((i, " ".join(rng.choice([[*w[:n - m], *end], [*end, *w[m:]]]))))
        want.add((i, i))
    docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, known).collect()} == want


def test_op7_windows_at_every_offset(spark):
    """Windows without a shingle in line with the item: halves that changed places, parts moved about."""
    rng = random.Random(21)
    items, texts = [], []
    for i in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([50, 64, 90]))]
        if i % 3 == 2:
            w[20:30] = w[:10]  # repeated shingles count as often as they occur
        cut = rng.choice([len(w) // 3, len(w) // 2 + 1])
        moved = [*w[cut:], *w[:cut]] if i % 2 else [*w[cut:2 * cut], *w[:cut], *w[2 * cut:]]
        texts.append([f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))] + moved + [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))])
        items.append(w)
    best = {}
    for i, w in enumerate(texts):
        for j, v in enumerate(items):
            for s in range(1 - len(v), len(w)):
                a, b = bag(w[max(0, s):s + len(v)]), bag(v)
                common, union = sum((a & b).values()), sum((a | b).values())
                if 100 * common >= 80 * union:
                    best[i, j] = max(best.get((i, j), (0,)), (common / union, common, union))
    assert len(best) >= 8
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["common_shingles"], r["union_shingles"]) for r in decontaminate.contaminated(docs, known).collect()}
    assert got == {k: v[1:] for k, v in best.items()}


def test_multi_index_blocks_miss_nothing(spark):
    from pyspark.sql import functions as F
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        pairs.append((i, 9, signed(a), signed(b)))
    df = spark.createDataFrame(pairs, "id long, n int, fp long, other long")
    entries = decontaminate._entries(df.select("id", "n", "fp")).select("id", "block", "value")
    keys = df.select("id", F.posexplode(F.array(*[decontaminate._block(F.col("other"), i) for i in range(decontaminate.BLOCKS)])).alias("block", "value"))
    assert keys.join(entries, ["id", "block", "value"]).select("id").distinct().count() == 300


def test_op7_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items).count() == 0


def test_op9(spark, folder):
    texts = [None, "", f"{prose(9)} Licensed under the Apache License, Version 2.0. {prose(3)}", f"This work is LICENSED under the GNU General Public License,\nversion 3. {prose(4)}",
             "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "the licence of the work", "Released under the MIT License", prose(3000)]
    got = licences.op9_minhash_licences(spark, folder(documents=(rows(texts), DOCS))).collect()
    names = Counter((r["doc_id"], r["licence"]) for r in got)
    assert names == {(2, "Apache-2.0"): 1, (3, "GPL-3.0"): 1, (4, "CC-BY-NC-4.0"): 2, (6, "MIT"): 1}
    assert all(r["found"] == r["total"] for r in got)
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string"), licences.templates(spark)).count() == 0


@pytest.mark.parametrize("text,names", [
    ("SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE", {"MIT"}),
    ("Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.", {"Apache-2.0"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", {"BSD"}),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", {"GPL-3.0"}), ("// SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
    ("Licensed under the MIT License", {"MIT"}),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
     "either version 2 of the License, or (at your option) any later version.", {"GPL", "GPL-2.0"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", {"GPL"})])
def test_op9_texts_of_licences(spark, text, names):
    known = licences.templates(spark)
    held = f"{prose(20)} {text} {prose(7)}"
    docs = spark.createDataFrame([(1, held), (2, prose(50)), (2, None), (1, held), (None, text)], "doc_id long, text string")
    got = licences.scan_licences(docs, known.select("template_id", "text")).join(known, "template_id").collect()
    assert {r["licence"] for r in got} == names and {r["doc_id"] for r in got} == {1, None}
    assert Counter((r["doc_id"], r["licence"]) for r in got) == {(i, n): 1 for i in (1, None) for n in names}


def test_op9_short_notice(spark, folder):
    long = "All rights reserved. No part of this publication may be reproduced"
    texts = [f"{prose(30)} All rights reserved.", "ALL RIGHTS\nRESERVED", "all the rights reserved", "rights reserved", f"{prose(5)} {long} in any form", f"all rights reserved {prose(4)} All rights reserved."]
    got = licences.op9_minhash_licences(spark, folder(documents=(rows(texts), DOCS))).collect()
    assert {r["licence"] for r in got} == {"Proprietary"} and all(r["found"] == r["total"] for r in got)
    assert Counter((r["doc_id"], r["start_word"], r["n_words"]) for r in got) == {(0, 30, 3): 1, (1, 0, 3): 1, (4, 5, 3): 1, (4, 5, 11): 1, (5, 0, 3): 1, (5, 7, 3): 1}
