"""The pipeline's stages on a small corpus: what goes, what stays, and that the columns stay."""
import random

import corpus_pipeline as pipeline
from basketflow.llm.packing import CAPACITY

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"
PARTS = {"en": "the ing tion er ou and on th".split(), "de": "sch ein ung ich heit und ver keit".split()}


def words(rng, lang, n):
    return ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus():
    rng = random.Random(11)
    texts = {i: (" ".join(words(rng, lang, 60)), lang) for i, lang in ((i, rng.choice(["en", "de"])) for i in range(80))}
    item = " ".join(words(rng, "en", 25))
    texts[100] = (None, "en")
    texts[101] = ("12 34 !!", "en")
    near = texts[5][0].split()
    near[-1] = "changed"
    texts[102] = (" ".join(near * 1), texts[5][1])
    texts[103] = (texts[7][0], texts[7][1])
    texts[104] = (f"{texts[8][0]} tail {item} {texts[9][0]}", "en")
    texts[105] = (" ".join(words(rng, "en", 40)) + " mail a.b@c-d.org now", None)
    rows = [(i, t, lang, "s", None if t is None else len(t), "x") for i, (t, lang) in texts.items()]
    return rows + [rows[3]], item


def test_stages(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    everything = sorted(r[0] for r in rows)
    assert kept["language"] == [i for i in everything if i not in (100, 101)]
    assert kept["near_duplicates"] == [i for i in sorted(set(kept["language"])) if i not in (102, 103)]
    assert kept["decontamination"] == [i for i in kept["near_duplicates"] if i != 104]
    assert kept["personal_data"] == kept["decontamination"] == sorted(set(kept["packing"]))
    clean = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert clean[105]["text"].endswith("mail [EMAIL] now") and clean[105]["n_chars"] == len(clean[105]["text"]) and clean[105]["lang"] == "en"
    assert all(clean[r[0]]["text"] == r[1] for r in rows if r[0] in clean and r[0] != 105)
    per = {}
    for r in docs.collect():
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + r["length"]
    assert max(per.values()) <= CAPACITY


def test_near_duplicates_from_eighty_percent(spark):
    rng = random.Random(12)
    rows = []
    for i in range(0, 60, 3):
        base = [f"w{rng.randrange(10**9)}" for _ in range(64)]
        # of 60 shingles 6 differ (54 / 66 = 0.818), and 7 (53 / 67 = 0.791)
        ends = [[f"x{rng.randrange(10**9)}" for _ in range(m)] for m in (6, 7)]
        rows += [(i, " ".join(base)), (i + 1, " ".join([*base[:58], *ends[0]])), (i + 2, " ".join([*ends[1], *base[7:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [i for i, _ in rows if i % 3 != 1]


def test_columns_named_as_the_operators_results(spark, tmp_path):
    rows, item = corpus()
    names = ["lang_pred", "score", "spans", "Score_", "_key", "_id", "_text_key", "_bad_id"]
    rows = [(*r, *(f"{n} of {r[0]}" for n in names)) for r in rows]
    docs = spark.createDataFrame(rows, f"{DOCS}, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.collect()
    assert len(got) == 81 and all(r[n] == f"{n} of {r['doc_id']}" for r in got for n in names)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
