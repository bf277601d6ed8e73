"""Removal of repeated 50-byte strings across documents by a column-wise collection BWT.

The column-wise construction inserts one symbol of every string in each round, so it needs as many
rounds as the longest string has symbols. Whole documents would need 100,000 rounds and more over the
whole collection; here the strings are short segments that together hold every 50-byte window once:

1. Every window belongs to its anchor, the 20-byte string inside it with the smallest hash. Consecutive
   windows with the same anchor form a segment (50 to 80 bytes). Equal windows have equal anchors.
2. Anchors are reduced in buckets of a hash; only those that lie in several documents go on. Tasks
   reduce a run of documents before they send, so an anchor that lies in a third of all documents is
   sent once for each run, not once for each document.
3. The segments of shared anchors are dealt into buckets by anchor, distinct ones once for each run. A
   bucket's collection BWT is built column by column (one symbol per segment each round); suffixes
   that share 50 symbols are then neighbours, and the smallest document of each such class decides.
4. Answers go back to the run that asked, as ranges of windows; those become byte ranges by document.

Exact copies are found first, by digest: all but the smallest are covered whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import discard, release, stored, table
from basketflow.llm.shingles import BASE, INVERSES, POWERS, mix
from basketflow.session import scratch_path

LENGTH = 50
ANCHOR = 20
SPAN = LENGTH - ANCHOR + 1
#: bytes of text handled at once in a task, and anchors of one run
CHUNK = 2_000_000
RUN_ANCHORS = 500_000
RUN_BYTES = 8_000_000
#: text bytes for each bucket
BUCKET_BYTES = 24_000_000
LEAST_BUCKETS = 64
#: segments of one collection: whole anchors are added up to this size, which keeps its columns in cache
COLLECTION = 2000


def _packed(data: bytes) -> bytes:
    """For the shuffle: Spark's own codec leaves segments and small numbers much larger."""
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(values, kind: str) -> bytes:
    """Numbers packed by the place of their bytes: high bytes are often alike, low ones seldom."""
    return _packed(np.ascontiguousarray(np.asarray(values).astype(kind)).view("u1").reshape(-1, np.dtype(kind).itemsize).T.tobytes())


def _unnumbers(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(_unpacked(data), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _grams(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    sums = np.zeros(n + 1, dtype="uint64")
    np.cumsum((raw.astype("uint64") + np.uint64(1)) * POWERS.upto(n), out=sums[1:])
    return mix((sums[ANCHOR:] - sums[:-ANCHOR]) * INVERSES.upto(n)[:n - ANCHOR + 1])


def _owners(h: np.ndarray) -> np.ndarray:
    """For each run of `SPAN` hashes the place of the smallest, the first one of equals."""
    at, low, size = np.arange(len(h)), h, 1
    while size * 2 <= SPAN:
        left = low[:-size] <= low[size:]
        at, low = np.where(left, at[:-size], at[size:]), np.minimum(low[:-size], low[size:])
        size *= 2
    rest = SPAN - size
    if not rest:
        return at
    return np.where(low[:-rest] <= low[rest:], at[:-rest], at[rest:])


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (document, first byte, bytes); a long text comes in slices that overlap by
    `LENGTH` - 1 bytes, so that every window lies in one slice exactly."""
    group, size = [], 0
    for i, data in enumerate(texts):
        for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
            part = data[at:at + CHUNK + LENGTH - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def segments(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In groups: the group's bytes; and of each segment its first byte there, its number of windows,
    its document, its first byte in that document, and its anchor's hash."""
    for group in _slices(texts):
        data = b"".join(x for _, _, x in group)
        raw = np.frombuffer(data, dtype="uint8")
        h = _grams(raw)
        own = _owners(h)
        sizes = np.array([len(x) for _, _, x in group])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        valid = np.zeros(len(own) + 1, dtype="int8")
        valid[begins] += 1
        valid[begins + sizes - LENGTH + 1] -= 1
        inside = np.cumsum(valid[:-1]).astype(bool)
        first = np.ones(len(own), dtype=bool)
        first[1:] = own[1:] != own[:-1]
        first[begins] = True
        cut = np.flatnonzero((first & inside))
        ends = np.append(np.flatnonzero(first | ~inside), len(own))
        windows = ends[np.searchsorted(ends, cut, "right")] - cut
        part = np.searchsorted(begins, cut, "right") - 1
        docs = np.array([i for i, _, _ in group])[part]
        yield data, cut, windows, docs, cut - begins[part] + np.array([a for _, a, _ in group])[part], h[own[cut]] >> np.uint64(16)


def _runs(batches, most_bytes: int) -> Iterator[tuple[np.ndarray, list[bytes], list]]:
    """Documents of a task, some megabytes at a time: ids, texts and the third column."""
    ids, texts, extra, size = [], [], [], 0
    for batch in batches:
        other = batch.column(2) if batch.num_columns > 2 else None
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            ids.append(doc)
            texts.append((text.as_py() or "").encode("utf-8", "replace"))
            extra.append(other[i].as_py() if other is not None else None)
            size += len(texts[-1])
            if size >= most_bytes:
                yield np.array(ids, "int64"), texts, extra
                ids, texts, extra, size = [], [], [], 0
    if ids:
        yield np.array(ids, "int64"), texts, extra


ANCHOR_ROWS = "bucket int, doc_id long, hashes binary, owners binary, docs binary"


def _anchors(buckets: int):
    """Anchors by bucket, one document for each run; where several documents of the run have an
    anchor they are told so at once (doc_id not null)."""

    def send(batches):
        for ids, texts, _ in _runs(batches, RUN_BYTES):
            got = [(docs, hashes) for _, _, _, docs, _, hashes in segments(texts)]
            if not got:
                continue
            owner = ids[np.concatenate([d for d, _ in got])]
            h = np.concatenate([x for _, x in got])
            order = np.lexsort((owner, h))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            owner, h = owner[new], h[new]
            head = np.ones(len(h), dtype=bool)
            head[1:] = h[1:] != h[:-1]
            group = np.cumsum(head) - 1
            several = np.bincount(group)[group] > 1
            out = [_told(owner[several], h[several])]
            owner, h = owner[head], h[head]
            names, at = np.unique(owner, return_inverse=True)
            bucket = (mix(h) % np.uint64(buckets)).astype("int32")
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                own = by[cuts[b]:cuts[b + 1]]
                if len(own):
                    used, where = np.unique(at[own], return_inverse=True)
                    packed = h[own].astype("<u8").view("uint8").reshape(-1, 8)[:, :6].tobytes()
                    out.append([(b, None, packed, _packed(where.astype("<u4").tobytes()), names[used].astype("<i8").tobytes())])
            rows = [r for part in out for r in part]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "doc_id", "hashes", "owners", "docs"])

    def _told(owner, h):
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
        docs, start = np.unique(owner, return_index=True)
        return [(int(d % buckets), int(d), x.astype("<u8").tobytes(), None, None) for d, x in zip(docs.tolist(), np.split(h, start[1:]))]

    return send


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a bucket that lie in several documents, by document."""
    told = rows[rows["doc_id"].notna()]
    docs_out, hashes_out = told["doc_id"].astype("int64").tolist(), told["hashes"].tolist()
    sent = rows[rows["doc_id"].isna()]
    h, owner = [], []
    for hashes, owners, docs in zip(sent["hashes"], sent["owners"], sent["docs"]):
        wide = np.zeros((len(hashes) // 6, 8), dtype="uint8")
        wide[:, :6] = np.frombuffer(hashes, "uint8").reshape(-1, 6)
        h.append(wide.view("<u8").ravel())
        owner.append(np.frombuffer(docs, "<i8")[np.frombuffer(_unpacked(owners), "<u4")])
    if h:
        h, owner = np.concatenate(h), np.concatenate(owner)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        first = owner[np.flatnonzero(head)][group]
        several = np.bincount(group, weights=(owner != first))[group] > 0
        h, owner = h[several], owner[several]
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
        docs, start = np.unique(owner, return_index=True)
        docs_out += docs.tolist()
        hashes_out += [x.astype("<u8").tobytes() for x in np.split(h, start[1:])] if len(docs) else []
    return pd.DataFrame({"doc_id": np.array(docs_out, "int64"), "hashes": hashes_out})


SEGMENT_ROWS = "run string, bucket int, segs binary, windows binary, ids binary, low binary, above binary, anchors binary, docs binary, starts binary"
SEGMENT_NAMES = [x.split()[0] for x in SEGMENT_ROWS.split(", ")]


def _segments(buckets: int):
    """For each run its distinct segments of shared anchors by bucket (numbered ``ids``), and in one
    row with bucket -1 where each of them lies (segment number, document, first byte)."""

    def send(batches):
        for ids, texts, hits in _runs(batches, RUN_BYTES):
            shared = [np.sort(np.frombuffer(b"".join(x or []), "<u8")) for x in hits]
            # one sorted key for each (document, anchor) asked for
            known: dict[tuple[bytes, int], int] = {}
            number, docs, starts = [], [], []
            for data, cut, windows, doc, start, h in segments(texts):
                take = np.zeros(len(h), dtype=bool)
                for d in np.unique(doc).tolist():
                    a, b = np.searchsorted(doc, [d, d + 1])
                    want = shared[d]
                    if len(want):
                        take[a:b] = want[np.minimum(np.searchsorted(want, h[a:b]), len(want) - 1)] == h[a:b]
                for c, w, x in zip(cut[take].tolist(), windows[take].tolist(), h[take].tolist()):
                    number.append(known.setdefault((data[c:c + w + LENGTH - 1], x), len(known)))
                docs.append(ids[doc[take]])
                starts.append(start[take])
            if not known:
                continue
            number, docs, starts = np.array(number), np.concatenate(docs), np.concatenate(starts)
            low, high = np.full(len(known), np.iinfo("int64").max), np.full(len(known), np.iinfo("int64").min)
            np.minimum.at(low, number, docs)
            np.maximum.at(high, number, docs)
            anchors = np.array([x for _, x in known], dtype="uint64")
            bucket = (mix(anchors + np.uint64(1)) % np.uint64(buckets)).astype("int64")
            run, segs = uuid.uuid4().hex, [s for s, _ in known]
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(run, -1, None, None, _numbers(number, "<u4"), None, None, None, _numbers(docs, "<i8"), _numbers(starts, "<i8"))]
            for b in range(buckets):
                own = order[cuts[b]:cuts[b + 1]]
                if len(own):
                    mine = [segs[i] for i in own.tolist()]
                    rows.append((run, b, _packed(b"".join(mine)), _numbers([len(s) for s in mine], "u1"), _numbers(own, "<u4"),
                                 _numbers(low[own], "<i8"), _numbers(high[own] - low[own], "<i8"), _numbers(anchors[own], "<u8"), None, None))
            kinds = [pa.string(), pa.int32(), *[pa.binary()] * 8]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=SEGMENT_NAMES)

    return send


def collection_order(flat: np.ndarray, n: int, width: int) -> np.ndarray:
    """Column-wise construction for ``n`` strings that stand at the right of a matrix of symbols above 0
    (``flat``, 0 before each string): all suffixes in sorted order, each as the place before it.

    Round 0 holds every string's empty suffix; the BWT symbol of a suffix is the one before it, 0 where
    the string begins. Round j puts one more symbol of every string in: sorting the list stably by
    BWT symbol (sequential passes over it) moves each suffix to where its longer one belongs, behind
    the empty ones; whole strings have no longer one, and come out again in every round."""
    none = (np.arange(n, dtype="int32") + 1) * width - 1
    before = none
    for _ in range(width - 1):
        bwt = flat[before]
        by = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0):]
        before = np.concatenate([none, before[by] - np.int32(1)])
    return before


def window_minima(segs: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each distinct segment the smallest document of each of its windows."""
    sizes = np.array([len(s) for s in segs])
    width = int(sizes.max()) + 1
    raw = np.frombuffer(b"".join(segs), "uint8")
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, dtype="uint8" if len(used) < 256 else "uint16")
    code[used] = np.arange(1, len(used) + 1)
    matrix = np.zeros((len(segs), width), dtype=code.dtype)
    matrix[np.arange(width)[None, :] >= (width - sizes)[:, None]] = code[raw]
    flat = matrix.ravel()
    begin = collection_order(flat, len(segs), width).astype("int64") + 1
    string = (begin - 1) // width
    whole = (string + 1) * width - begin >= LENGTH
    begin, string = begin[whole], string[whole]
    same = np.ones(len(string) - 1, dtype=bool)
    for j in range(LENGTH):  # neighbours that share their first symbols
        column = flat[begin + j]
        same &= column[1:] == column[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(low[string], np.flatnonzero(np.concatenate([[True], ~same])))
    offsets = np.concatenate([[0], np.cumsum(sizes - LENGTH + 1)])
    minima = np.empty(offsets[-1], dtype="int64")
    minima[offsets[string] + begin - string * width - (width - sizes[string])] = least[group]
    return np.split(minima, offsets[1:-1])


def _minima(rows: pd.DataFrame) -> pd.DataFrame:
    """For every run that sent segments to this bucket: ranges of windows with a smaller document."""
    low: dict[bytes, int] = {}
    variants: dict[int, set] = {}
    sent = []
    for run, segs, sizes, ids, lo, hi, anchors in zip(*[rows[c] for c in ("run", "segs", "windows", "ids", "low", "above", "anchors")]):
        sizes, lo, anchors = _unnumbers(sizes, "u1"), _unnumbers(lo, "<i8"), _unnumbers(anchors, "<u8")
        ends, segs = np.cumsum(sizes.astype("int64")), _unpacked(segs)
        mine = [segs[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        for s, d, x in zip(mine, lo.tolist(), anchors.tolist()):
            if d < low.get(s, d + 1):
                low[s] = d
            variants.setdefault(x, set()).add(s)
        sent.append((run, mine, _unnumbers(ids, "<u4"), lo + _unnumbers(hi, "<i8")))
    # segments that are the only ones of their anchor need no order: all their windows have one minimum
    minima: dict[bytes, np.ndarray] = {}
    mixed: list[bytes] = []
    groups = [group for group in variants.values() if len(group) > 1]
    for i, group in enumerate(groups):
        mixed += group
        if len(mixed) >= COLLECTION or i == len(groups) - 1:
            minima.update(zip(mixed, window_minima(mixed, np.array([low[s] for s in mixed]))))
            mixed = []
    runs, numbers, firsts, counts, leasts = [], [], [], [], []
    for run, mine, ids, hi in sent:
        got: tuple[list, list, list, list] = ([], [], [], [])
        for s, number, h in zip(mine, ids.tolist(), hi.tolist()):
            m = minima.get(s)
            if m is None:
                spans = [(0, len(s) - LENGTH + 1, low[s])]
            else:
                cut = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]
                spans = [(a, b - a, int(m[a])) for a, b in zip(cut, cut[1:])]
            for first, count, least in spans:
                if least < h:
                    for x, v in zip(got, (number, first, count, least)):
                        x.append(v)
        if got[0]:
            runs.append(run)
            for x, v, t in zip((numbers, firsts, counts, leasts), got, ("<u4", "u1", "u1", "<i8")):
                x.append(_numbers(v, t))
    return pd.DataFrame({"run": pd.Series(runs, dtype=object), "numbers": numbers, "firsts": firsts, "counts": counts, "leasts": leasts})


def _ranges(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The merged removed byte ranges of each document of a run."""
    docs_out, n_removed, n_spans, out = [], [], [], []
    if len(own) and len(answers):
        number, first, count, least = [np.concatenate([_unnumbers(x, t) for x in answers[c]]).astype("int64") for c, t in (("numbers", "<u4"), ("firsts", "u1"), ("counts", "u1"), ("leasts", "<i8"))]
        order = np.argsort(number, kind="stable")
        number, first, count, least = number[order], first[order], count[order], least[order]
        seg = _unnumbers(own["ids"].iloc[0], "<u4").astype("int64")
        docs, starts = _unnumbers(own["docs"].iloc[0], "<i8"), _unnumbers(own["starts"].iloc[0], "<i8")
        a, b = np.searchsorted(number, seg), np.searchsorted(number, seg, "right")
        times = b - a
        use = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        doc, base = np.repeat(docs, times), np.repeat(starts, times)
        keep = least[use] < doc
        use, doc, base = use[keep], doc[keep], base[keep]
        begin = base + first[use]
        end = begin + count[use] - 1 + LENGTH
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        for d, x, y in zip(*_by_document(doc, begin, end)):
            reach = np.maximum.accumulate(y)
            new = np.ones(len(x), dtype=bool)
            new[1:] = x[1:] > reach[:-1]
            head = np.flatnonzero(new)
            x, y = x[head], reach[np.append(head[1:] - 1, len(y) - 1)]
            docs_out.append(d)
            n_removed.append(int((y - x).sum()))
            n_spans.append(len(x))
            out.append(np.stack([x, y], 1).astype("<i8").tobytes())
    return pd.DataFrame({"doc_id": np.array(docs_out, "int64"), "n_removed": np.array(n_removed, "int64"), "n_spans": np.array(n_spans, "int64"), "ranges": out})


def _by_document(doc, *columns):
    docs, start = np.unique(doc, return_index=True)
    return docs.tolist(), *[np.split(c, start[1:]) if len(docs) else [] for c in columns]


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (doc_id, text): every row's digest and size with the smallest document of equal
    text (``rep``), and for those smallest ones the removed byte ranges (begin and end, 64-bit pairs).

    A doc_id names one text; its rows may repeat. Rows with a null doc_id take no part and keep all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = stored(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha")), "digests")
    # only texts that occur more than once are joined back; a plain join, whose hot texts AQE can split
    copies = digests.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    base = digests.join(stored(copies.drop("n"), "copies"), "sha", "left")
    base = stored(base.select("doc_id", "n_bytes", "sha", F.coalesce("first", "doc_id").alias("rep")), "base")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))

    long_enough = docs.filter((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())
    sent = long_enough.mapInArrow(_anchors(buckets), ANCHOR_ROWS)
    hit_folder, segment_folder = (scratch_path(docs.sparkSession, "llm") for _ in range(2))
    hits = stored(sent.groupBy("bucket").applyInPandas(_shared, "doc_id long, hashes binary"), "hits", hit_folder)
    release(docs.sparkSession)
    reps = base.filter(F.col("rep") == F.col("doc_id")).select("doc_id").distinct()
    hits = hits.join(reps, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))
    asked = long_enough.join(hits, "doc_id").select("doc_id", "text", "hashes")
    segs = stored(asked.mapInArrow(_segments(buckets), SEGMENT_ROWS), "segments", segment_folder)
    discard(docs.sparkSession, hit_folder)
    release(docs.sparkSession)
    answers = segs.filter("bucket >= 0").groupBy("bucket").applyInPandas(_minima, "run string, numbers binary, firsts binary, counts binary, leasts binary")
    places = segs.filter("bucket < 0").select("run", "ids", "docs", "starts")
    ranges = places.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(_ranges, "doc_id long, n_removed long, n_spans long, ranges binary")
    ranges = stored(ranges.dropDuplicates(["doc_id"]), "ranges")
    discard(docs.sparkSession, segment_folder)
    release(docs.sparkSession)
    return base, ranges


def _kept(batches):
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            data, digest, at = text.as_py().encode("utf-8", "replace"), hashlib.sha256(), 0
            for a, b in np.frombuffer(ranges.as_py(), "<i8").reshape(-1, 2).tolist():
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "kept"])


def op4_column_bwt_repeats(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base, ranges = repeated_ranges(docs)
    texts = docs.join(ranges.select("doc_id", "ranges"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")
    kept = stored(texts.mapInArrow(_kept, "doc_id long, kept string").dropDuplicates(["doc_id"]), "kept")
    part = ranges.select("doc_id", "n_removed", "n_spans").join(kept, "doc_id")
    copy = (F.col("rep") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH)
    return base.join(part, "doc_id", "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


OP4_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, h, (len(h) // 2)::BIGINT AS n FROM t),
w AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 100] AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM l WHERE n >= 50)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY md5(s)) AS least FROM w),
f AS (SELECT doc_id, p, max(p) FILTER (least < doc_id) OVER (PARTITION BY doc_id ORDER BY p) AS hit FROM m),
b AS (SELECT doc_id, h, n, unnest(range(0, n)) AS p FROM l),
c AS (SELECT b.doc_id, b.p, b.h[2 * b.p + 1:2 * b.p + 2] AS x, coalesce(b.p - f.hit < 50, false) AS cut
      FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.p = least(b.p, b.n - 50)),
g AS (SELECT doc_id, p, x, cut, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM c),
r AS (SELECT doc_id, count(*) FILTER (cut) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT cut), '') AS kept FROM g GROUP BY doc_id)
SELECT l.doc_id, l.n AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM l LEFT JOIN r USING (doc_id)
"""
