"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

Every document is tokenized once, ids are counted over all documents, and an id's code is its rank by
falling count, so the 256 most frequent ids take one byte and the next 65,280 two. Documents are
range-partitioned and sorted by doc_id; each partition is one file, written as a stream of blocks of at
most `BLOCK` ids. A block is its control bytes (two bits an id: how many bytes the id has, less one) and
then the data bytes; a directory of documents and blocks follows, then a footer of fixed size. Blocks
are decoded without a loop over ids: a table gives the four lengths of each control byte, running sums of
them the places of the bytes, and the rank table the ids.

Files lie in the shared checkpoint folder. A task writes to a name of its own, and only names that the
finished job's manifest lists are ever read, so lost, repeated or speculative attempts leave no trace in
the result.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table
from basketflow.llm.packing import _byte_spelling, tokenizer_path
from basketflow.session import scratch_path

END_ID = 2
#: ids in a block
BLOCK = 1 << 16
#: bytes of text that a task tokenizes at once, on average
TEXT_BYTES = 8 << 20
#: the rank table travels to the tasks; a larger vocabulary is an error
MAX_VOCABULARY = 1 << 22
MAGIC = b"BFTOKEN1"
FOOTER = struct.Struct("<QQQQI8s")

#: the four byte lengths that a control byte states, lowest bits first
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype="uint8")

MANIFEST = "part int, path string, vocabulary string, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids binary"


# ---- coding ---------------------------------------------------------------------------------------------

def encode(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit codes."""
    codes = np.ascontiguousarray(codes, dtype="<u4")
    extra = (codes > 0xFF).astype("uint8") + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype="uint8")
    padded[:len(codes)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.astype("uint8").tobytes(), codes.view("uint8").reshape(-1, 4)[used].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` codes of a block."""
    lengths = LENGTHS[np.frombuffer(control, "uint8")].ravel()[:n]
    raw = np.frombuffer(data, "uint8")
    ends = np.cumsum(lengths, dtype="int64")
    if len(raw) != (ends[-1] if n else 0):
        raise ValueError("a block's data bytes do not match its control bytes")
    starts = ends - lengths
    codes = raw[starts].astype("uint32") if n else np.empty(0, "uint32")
    for more in range(1, 4):
        at = np.flatnonzero(lengths > more)
        if not len(at):
            break
        codes[at] |= raw[starts[at] + more].astype("uint32") << np.uint32(8 * more)
    return codes


class Writer:
    """One file: documents are added in order, blocks go out as they fill."""

    def __init__(self, stream):
        self.stream, self.at, self.held, self.n_held = stream, 0, [], 0
        self.docs, self.nulls, self.lengths, self.blocks = [], [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, lengths: np.ndarray, codes: np.ndarray) -> None:
        self.docs.append(np.array([0 if x is None else x for x in doc_ids], "<i8"))
        self.nulls.append(np.array([x is None for x in doc_ids], "u1"))
        self.lengths.append(np.asarray(lengths, "<u8"))
        self.held.append(codes)
        self.n_held += len(codes)
        if self.n_held >= BLOCK:
            ready = np.concatenate(self.held)
            whole = len(ready) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ready[i:i + BLOCK])
            self.held, self.n_held = [ready[whole:].copy()], len(ready) - whole

    def _block(self, codes: np.ndarray) -> None:
        control, data = encode(codes)
        self.blocks.append((self.at, len(codes), len(control), len(data)))
        self._put(control)
        self._put(data)

    def close(self) -> tuple[int, int, int]:
        """Writes what is left, the directory and the footer; (documents, ids, bytes)."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs, lengths = np.concatenate(self.docs), np.concatenate(self.lengths)
        directory = docs.tobytes() + np.concatenate(self.nulls).tobytes() + lengths.tobytes() + np.array(self.blocks, "<u8").tobytes()
        start, total = self.at, int(lengths.sum())
        self._put(directory)
        self._put(FOOTER.pack(len(docs), total, len(self.blocks), start, zlib.crc32(directory), MAGIC))
        self.stream.close()
        return len(docs), total, self.at


class Reader:
    """Random access to one file; ``ids`` is the vocabulary in rank order."""

    def __init__(self, stream, ids: np.ndarray):
        self.stream, self.ids = stream, ids
        size = stream.size()
        n_docs, self.n_tokens, n_blocks, at, check, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        directory = self._get(at, size - FOOTER.size - at)
        if magic != MAGIC or zlib.crc32(directory) != check or len(directory) != 17 * n_docs + 32 * n_blocks:
            raise ValueError("not a whole token file")
        self.docs = np.frombuffer(directory, "<i8", n_docs)
        self.nulls = np.frombuffer(directory, "u1", n_docs, 8 * n_docs)
        self.lengths = np.frombuffer(directory, "<u8", n_docs, 9 * n_docs).astype("int64")
        self.blocks = np.frombuffer(directory, "<u8", 4 * n_blocks, 17 * n_docs).astype("int64").reshape(-1, 4)

    def _get(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def block(self, i: int) -> np.ndarray:
        at, n, control, data = self.blocks[i].tolist()
        raw = self._get(at, control + data)
        return self.ids[decode(raw[:control], raw[control:], n)]

    def ids_between(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the file's id number ``first`` on; only the blocks that hold them are read."""
        end = min(first + count, self.n_tokens)
        if first >= end:
            return np.empty(0, "<u4")
        low, high = first // BLOCK, (end - 1) // BLOCK
        got = np.concatenate([self.block(i) for i in range(low, high + 1)])
        return got[first - low * BLOCK:end - low * BLOCK]

    def documents(self, most_ids: int = 1 << 20) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
        """(doc_ids, lengths, ids as bytes) of some documents at a time, in order."""
        ends = np.cumsum(self.lengths)
        low, done = 0, 0
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, done + most_ids, "right")))
            ids = self.ids_between(done, int(ends[high - 1]) - done).astype("<u4")
            cuts = np.concatenate([[0], ends[low:high] - done])
            doc_ids = [None if null else int(x) for x, null in zip(self.docs[low:high], self.nulls[low:high])]
            yield doc_ids, self.lengths[low:high], [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            low, done = high, int(ends[high - 1])


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_file(path: str, vocabulary: str) -> Reader:
    """A file of a manifest, for reading outside Spark."""
    files, at = _place(vocabulary)
    with files.open_input_stream(at) as f:
        ids = np.frombuffer(f.read(), "<u4")
    files, at = _place(path)
    return Reader(files.open_input_file(at), ids)


# ---- tokenizing -----------------------------------------------------------------------------------------

#: letters of Latin-1, perhaps with one sign behind them: units of the tokenizer's own splitting
PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,!?;:]?$"
SIGNS = ".,!?;:"
#: words whose ids a Python worker keeps
WORDS_KEPT = 600_000


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``places`` of ``flat``, one after the other, and the end of each."""
    counts = sizes[places]
    ends = np.cumsum(counts)
    at = np.repeat(first[places] - (ends - counts), counts)
    at += np.arange(len(at))
    return flat[at], ends


class WordTable:
    """The ids of words (no white space in them) in flat arrays, learned as they come. No token of this
    tokenizer crosses ASCII white space, it lower-cases, and a plain word's letters are one unit that goes to
    its merge model directly (in its spelling of bytes), like the sign behind them; any other word goes
    through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spelling = _byte_spelling()
        self._clear()

    def _clear(self) -> None:
        #: entries of whole words, and of the lower-cased letters of plain words
        self.whole: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.flat, self.first, self.sizes = np.empty(0, "<u4"), np.empty(0, "int64"), np.empty(0, "int64")
        self._learn(["", *SIGNS], [])

    def _learn(self, other: list[str], plain: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)] if other else []
        merge, spelling = self.tokenizer.model.tokenize, self.spelling
        ids += [[t.id for t in merge(x if x.isascii() else x.encode().decode("latin-1").translate(spelling))] for x in plain]
        sizes = np.fromiter(map(len, ids), "int64", len(ids))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        at = len(self.sizes)
        self.whole.update(zip(other, range(at, at + len(other))))
        self.plain.update(zip(plain, range(at + len(other), at + len(ids))))
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes.sum()))])
        self.first, self.sizes = np.concatenate([self.first, starts]), np.concatenate([self.sizes, sizes])

    def _places(self, other: list[str], plain: list[str]) -> tuple[list, list]:
        """The entries of these words."""
        new = [w for w in other if w not in self.whole], [w for w in plain if w not in self.plain]
        if any(new):
            if len(self.sizes) + len(new[0]) + len(new[1]) > WORDS_KEPT:
                self._clear()
                new = [w for w in other if w not in self.whole], plain
            self._learn(*new)
        return list(map(self.whole.__getitem__, other)), list(map(self.plain.__getitem__, plain))

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words in a row, ids in each)."""
        plain = pc.match_substring_regex(words, PLAIN)
        letters = pc.utf8_rtrim(words.filter(plain), SIGNS)
        ends = pc.utf8_slice_codeunits(words.filter(plain), -1)
        cores = pc.utf8_lower(letters).dictionary_encode()
        whole, known = self._places(words.filter(pc.invert(plain)).to_pylist(), cores.dictionary.to_pylist())
        signed = np.array([self.whole[c] if c in SIGNS else 0 for c in ends.dictionary_encode().dictionary.to_pylist()] or [0])
        entries = np.zeros((len(words), 2), "int64")
        mask = plain.to_numpy(zero_copy_only=False)
        entries[~mask, 0] = whole
        entries[mask, 0] = np.array(known, "int64")[cores.indices.to_numpy()] if len(cores) else []
        entries[mask, 1] = signed[ends.dictionary_encode().indices.to_numpy()] if len(ends) else []
        flat, ends_at = _gather(self.flat, self.first, self.sizes, entries.ravel())
        return flat, np.diff(ends_at[1::2], prepend=0)


@functools.cache
def word_table(path: str) -> WordTable:
    """One for each Python worker: its words serve all its tasks."""
    return WordTable(path)


def tokenize(texts: pa.Array, tokenizer: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, each with the end id; ids in each text): each distinct word of the batch is
    looked up once, and its ids are put in every place of the word. Null texts are empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    flat, sizes = word_table(tokenizer).ids(coded.dictionary)
    flat, sizes = np.append(flat, np.uint32(end_id)), np.append(sizes, 1)
    offsets = split.offsets.to_numpy()
    places = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:] - offsets[0], len(sizes) - 1)
    ids, ends = _gather(flat, np.cumsum(sizes) - sizes, sizes, places)
    return ids, np.diff(ends[offsets[1:] - offsets[0] + np.arange(len(texts))], prepend=0)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of a batch with about `TEXT_BYTES` of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + TEXT_BYTES, "right")))
        yield batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)
        low = high


def _binary(parts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of consecutive runs of ``parts``."""
    cuts = np.concatenate([[0], np.cumsum(lengths)]) * parts.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts.astype("int64")), pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())


def id_width(tokenizer: str, end_id: int) -> str:
    """The smallest unsigned type for all ids of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, width: str) -> DataFrame:
    """doc_id and ids (unsigned little-endian of this width, with the end id) of every row."""

    def run(batches):
        for batch in batches:
            for doc_ids, texts in _batches(batch):
                ids, lengths = tokenize(texts, tokenizer, end_id)
                yield pa.RecordBatch.from_arrays([doc_ids, _binary(ids.astype(width), lengths)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _flat(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the ids in each row."""
    size = np.dtype(width).itemsize
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype("int64") // size
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, width, (offsets[-1] - offsets[0]) // size, offsets[0]) if data is not None and len(column) else np.empty(0, width)
    return flat, lengths


def ranked_vocabulary(tokens: DataFrame, width: str) -> np.ndarray:
    """The ids met, by falling count over all documents, ties by id: one partial count vector a task,
    summed by Spark, so the driver gets a row for each id of the vocabulary."""

    def count(batches):
        total = np.zeros(0, "int64")
        for batch in batches:
            got = np.bincount(_flat(batch.column(0), width)[0])
            if len(got) > len(total):
                total, got = got.astype("int64"), total
            total[:len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError("the vocabulary is larger than the rank table may be")
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], "<u4")


# ---- files ----------------------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes all rows of ``docs`` (doc_id, text; other columns are ignored) and returns the manifest:
    one row for each file, whose numbers ascend with doc_id.

    Null texts are empty and have the end id alone. Null doc_ids come first. Rows with one doc_id follow each
    other by id count and content, and a hot doc_id is spread over files like any others, because the
    order goes on to a row number. An empty table writes no file."""
    spark: SparkSession = docs.sparkSession
    width = id_width(tokenizer, end_id)
    path = scratch_path(spark, "tokens")
    tokens = token_ids(docs, tokenizer, end_id, width)
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    ids = ranked_vocabulary(tokens, width)
    folder = scratch_path(spark, "token-files")
    vocabulary = f"{folder}/vocabulary.u32"
    files, at = _place(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/vocabulary.u32") as f:
        f.write(ids.tobytes())
    rank = np.zeros(int(ids.max(initial=0)) + 1, "<u4")
    rank[ids] = np.arange(len(ids), dtype="<u4")
    shared = spark.sparkContext.broadcast(rank)

    def write(batches):
        from pyspark import TaskContext

        writer, codes = None, shared.value
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, at = _place(folder)
                files.create_dir(at, recursive=True)
                writer = Writer(files.open_output_stream(f"{at}/{name}"))
            flat, lengths = _flat(batch.column(1), width)
            writer.add(batch.column(0).to_pylist(), lengths, codes[flat])
        if writer:
            n_docs, n_tokens, n_bytes = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "vocabulary": vocabulary, "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": n_bytes}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("vocabulary", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_size", "_hash", "_mid"]
    keyed = tokens.select("doc_id", "ids", F.octet_length("ids").alias("_size"), F.xxhash64("ids").alias("_hash"), F.monotonically_increasing_id().alias("_mid"))
    return stored(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document, from the
    files; one task a file."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", "vocabulary", F.coalesce(before, F.lit(0)).cast("long").alias("start"))

    def read(batches):
        for batch in batches:
            for path, vocabulary, start in zip(*(c.to_pylist() for c in batch.columns)):
                reader = open_file(path, vocabulary)
                for doc_ids, lengths, ids in reader.documents():
                    starts = start + np.cumsum(lengths) - lengths
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    start += int(lengths.sum())
                reader.stream.close()

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, READ)


def op11_ranked_token_files(spark, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
