"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Features are hashed 1-, 2- and 3-grams of the lower-cased letters of the whole text (every run of
other characters counts as one space). Document frequencies are counted over all training documents.
The weights are fitted by follow-the-regularised-leader (proximal, per-coordinate rates, elastic net)
on a bounded, balanced, reproducible sample of the training documents; a second such sample sets the
softmax temperature. The model is a matrix of `BUCKETS` x languages and applied to every document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table

BUCKETS = 1 << 15
#: documents of a language in the fitting sample, on average (the documented bound of the fit)
SAMPLE_PER_LANG = 1000
#: and in the sample that sets the temperature
CALIBRATE_PER_LANG = 250
EPOCHS = 3
#: follow-the-regularised-leader: rate, its offset, and the elastic net's two penalties
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
TEMPERATURES = tuple(0.05 * 1.25**i for i in range(24))
#: characters handled at once inside a task
CHUNK = 1_000_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype="uint64")


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def _letters() -> np.ndarray:
    """For each code point up to U+FFFF its lower-case letter, or 0 for anything else."""
    got = np.zeros(0x10000, dtype="uint32")
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            got[i] = ord(low) if len(low) == 1 else i
    return got


LETTERS = _letters()


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, one space (32) for each run of others, and a space at
    either end. Code points above U+FFFF are letters where Unicode says so."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    low = LETTERS[np.minimum(raw, 0xFFFF)]
    for i in np.flatnonzero(raw > 0xFFFF):
        low[i] = raw[i] if chr(raw[i]).isalpha() else 0
    gap = low == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[:1] = True
    out = np.where(gap, np.uint32(32), low)[keep]
    return np.concatenate([out if len(out) and out[0] == 32 else np.concatenate([[np.uint32(32)], out]), [np.uint32(32)]]).astype("uint64")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text and how often each occurs; empty without a letter."""
    counts = np.zeros(BUCKETS, dtype="int64")
    points = folded(text)
    if not (points != 32).any():
        return np.empty(0, "int64"), np.empty(0, "int64")
    for at in range(0, len(points), CHUNK):
        part = points[at:at + CHUNK + 2]
        own = min(CHUNK, len(points) - at)
        h = np.zeros(len(part), dtype="uint64")
        for n in range(3):
            size = len(part) - n
            if size <= 0:
                break
            h = h[:size] + part[n:] * MULTIPLIERS[n]
            mixed = ((h ^ (h >> np.uint64(29))) * MULTIPLIERS[1]) >> np.uint64(64 - 15)
            counts += np.bincount(mixed[:own].astype("int64"), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _batched(batch, text_at: int) -> Iterator[tuple[int, str]]:
    for i, x in enumerate(batch.column(text_at)):
        yield i, x.as_py() or ""


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The documents with letters, and for each bucket how many of them have it: one partial vector
    per task, summed by Spark, so at most `BUCKETS` + 1 rows come back."""

    def count(batches):
        df, n = np.zeros(BUCKETS, dtype="int64"), 0
        for batch in batches:
            for _, text in _batched(batch, 0):
                at, _ = features(text)
                df[at] += 1
                n += len(at) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS, dtype="int64"), 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return total, df


def _scaled(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def sample(docs: DataFrame, per_lang: int, salt: int) -> DataFrame | None:
    """About ``per_lang`` documents of each language, picked by a hash of the document id, as features (never
    texts): salt, lang, roll, at, tf. None without documents."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))]), F.col("lang"))
    roll = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def extract(batches):
        for batch in batches:
            got = [features(text) for _, text in _batched(batch, 1)]
            lists = [pa.array([x[i].astype("int32") for x in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([salt] * len(got), pa.int32()), batch.column(0), batch.column(2), *lists], names=["salt", "lang", "roll", "at", "tf"])

    picked = docs.withColumn("roll", roll).filter(F.col("roll") < share).select("lang", "text", "roll")
    return picked.mapInArrow(extract, "salt int, lang string, roll double, at array<int>, tf array<int>").filter(F.size("at") > 0)


def fit_ftrl(rows: list, langs: list[str], idf: np.ndarray) -> np.ndarray:
    """Weights of the multinomial model; exactly zero where the first penalty outweighs the gradient."""
    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    index = {x: i for i, x in enumerate(langs)}
    for _ in range(EPOCHS):
        for lang, at, tf in rows:
            x, w = _scaled(at, tf, idf), weights(at)
            g = x[:, None] * (_softmax(x @ w) - np.eye(len(langs))[index[lang]])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame) -> Model | None:
    """Fits on the rows of ``docs`` (doc_id, text, lang) with a language and a letter; None if there
    are none. One language gives a model that always answers it."""
    docs = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total, df = document_frequencies(docs)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    picked = stored(sample(docs, SAMPLE_PER_LANG, 1).unionByName(sample(docs, CALIBRATE_PER_LANG, 2)), "language-sample")

    def fit(batches):
        rows = {1: [], 2: []}
        for batch in batches:
            salts, langs, rolls = (batch.column(i).to_pylist() for i in range(3))
            for salt, lang, roll, at, tf in zip(salts, langs, rolls, batch.column(3), batch.column(4)):
                rows[salt].append((roll, lang, at.values.to_numpy(), tf.values.to_numpy()))
        fitted, held = ([x[1:] for x in sorted(rows[salt], key=lambda x: x[:2])] for salt in (1, 2))
        langs = sorted({x for x, _, _ in fitted})
        if langs:
            w = fit_ftrl(fitted, langs, idf)
            model = Model(langs, idf, w, temperature(fitted, held, langs, idf, w))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task fits on the bounded sample; the driver gets the model only
    fitted = picked.coalesce(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(bytes(fitted[0]["model"])) if fitted else None


def temperature(fitted: list, held: list, langs: list[str], idf: np.ndarray, w: np.ndarray) -> float:
    """The softmax temperature with the least loss on the held rows (on the fitted ones, if there are none)."""
    scored = [(x, _scaled(at, tf, idf) @ w[at]) for x, at, tf in held if x in langs]
    scored = scored or [(x, _scaled(at, tf, idf) @ w[at]) for x, at, tf in fitted]
    scores, truth = np.array([s for _, s in scored]), np.array([langs.index(x) for x, _ in scored])
    loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in TEMPERATURES]
    return TEMPERATURES[int(np.argmin(loss))]


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with lang_pred and score for every row: calibrated probability of the
    best language (ties: the first in order); ``und`` and 0 for a null text or one without a letter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text_at = keep.index("text") if "text" in keep else len(keep)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def classify(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, text in _batched(batch, text_at):
                at, tf = features(text) if m else (np.empty(0, "int64"), None)
                if not len(at):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = _softmax(_scaled(at, tf, m.idf) @ m.weights[at] / m.temperature)
                langs.append(m.langs[int(p.argmax())])
                scores.append(float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    asked = [*keep] if "text" in keep else [*keep, F.col("text").alias("_text_for_language")]
    return docs.select(*asked).mapInArrow(classify, schema)


def held_out() -> Column:
    """True for the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_ftrl_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(docs, train(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])
