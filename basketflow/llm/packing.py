"""Token packing into windows of at most 2048 ids by Karmarkar-Karp multiway differencing.

Each document is tokenized once where it lies and cut into full windows and a tail of short pieces
(`PIECE` ids at most, so that several meet in a window); only lengths and checksums travel on. Tail
pieces are dealt into blocks of bounded size by a hash of document and start. In a block, differencing
starts from one partial partition per piece, and again and again merges the two with the largest spread,
the heaviest windows of one onto the lightest of the other. The window count starts at the least that
can hold the block and rises while the heaviest window exceeds the capacity.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import stored, table

CAPACITY = 2048
#: tails are cut into pieces of this many ids at most
PIECE = 256
#: tail pieces in a block, on average (the bound of one differencing run)
BLOCK_PIECES = 2048
END_ID = 1
#: words whose ids a Python worker keeps, about, the ones used last
WORD_CACHE = 400_000
SIGNS = ".,!?;:"
LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
#: bytes of text whose distinct words are looked up at once
GROUP_BYTES = 16_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """The ids of a text as little-endian unsigned 32-bit bytes. This tokenizer lower-cases, composes
    characters and splits at white space before it merges, so no token crosses ASCII white space: each
    distinct word of a group of texts is looked up once, and its ids are dealt to all its places. Most
    words are Latin-1 letters and perhaps one sign behind them: the letters are exactly one unit of the
    tokenizer's own splitting and go to its merge model directly, in lower case and its spelling of
    bytes; all other words go through the whole tokenizer. The ids of letters and other words are kept
    in two generations: a full one becomes the older, and the older one's are lost unless used again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.merge = self.tokenizer.model.tokenize
        self.signs = pa.array([self._whole(c) for c in SIGNS] + [b""], pa.large_binary())
        self.spelling = _byte_spelling()

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text, none of them null."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids = self._words(coded.dictionary).take(coded.indices)
        ends = np.cumsum(np.concatenate([[0], pc.binary_length(ids).to_numpy()]), dtype="int64")
        cuts = ends[np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]), dtype="int64")].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _words(self, words: pa.Array) -> pa.Array:
        sign = pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(list(SIGNS), words.type))
        letters = pc.if_else(pc.is_valid(sign), pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.match_substring_regex(letters, LETTERS)
        names = pc.if_else(plain, pc.utf8_lower(letters), words).dictionary_encode()
        got = pa.array(self._ids(names.dictionary.to_pylist()), pa.large_binary()).take(names.indices)
        behind = self.signs.take(pc.fill_null(pc.if_else(plain, sign, None), len(SIGNS)))
        return pc.binary_join_element_wise(got, behind, pa.scalar(b"", pa.large_binary()))

    def _ids(self, names: list[str]) -> list[bytes]:
        if len(self.known) > WORD_CACHE // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        got = list(map(known.get, names))
        lost = [i for i, x in enumerate(got) if x is None]
        other = []
        for i in lost:
            w = names[i]
            x = older.get(w)
            if x is None:
                if not w.isalpha() or max(w) >= "\u0100":
                    other.append(w)
                    continue
                spelled = w if w.isascii() else w.encode().decode("latin-1").translate(self.spelling)
                x = array("I", [t.id for t in self.merge(spelled)]).tobytes()
            known[w] = got[i] = x
        for w, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        return [known[w] if x is None else x for w, x in zip(names, got)] if other else got


def _byte_spelling() -> dict[int, str]:
    """How byte-level models spell bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker: its words serve all its tasks. The tasks are as many as the cores, so
    the tokenizer runs in one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def some(batch: pa.RecordBatch, most_bytes: int = GROUP_BYTES):
    """A batch's documents, about ``most_bytes`` of text at a time; null texts are empty."""
    doc_ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype="int64")
    first, done = 0, 0
    while first < len(doc_ids):
        last = max(first + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield doc_ids[first:last], texts[first:last]
        first, done = last, int(ends[last - 1])


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """One row per piece: its document, first id, length, checksum and the document's id count."""

    def cut(batches):
        ids, end_id = word_ids(tokenizer), array("I", [END_ID]).tobytes()
        for batch in batches:
            for doc_ids, texts in some(batch):
                rows = []
                for doc_id, data in zip(doc_ids, ids.texts(texts)):
                    data += end_id
                    total = len(data) // 4
                    full = total // capacity * capacity
                    starts = [*range(0, full, capacity), *range(full, total, piece)]
                    for start, end in zip(starts, [*starts[1:], total]):
                        rows.append((doc_id, start, end - start, zlib.crc32(data[4 * start:4 * end]), total))
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for ``k`` windows: the indexes of the lengths in each window, heaviest first.
    A partial partition is its k sums in falling order, kept sparse: all windows beyond those listed
    are empty."""
    heap: list = []
    for i, n in enumerate(lengths):
        heap.append((-n, i, [n], [[i]]))
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        _, _, sa, wa = heapq.heappop(heap)
        _, _, sb, wb = heapq.heappop(heap)
        if len(sa) + len(sb) <= k:  # heavy windows meet only empty ones
            sums, members = sa + sb, wa + wb
        else:
            free = k - len(sa)
            sums, members = sa + sb[:free], wa + wb[:free]
            # the lightest windows of one take the heaviest left of the other
            for j, (s, w) in enumerate(zip(reversed(sb[free:]), reversed(wb[free:]))):
                at = len(sb) - free - 1 - j
                sums[len(sa) - 1 - at] += s
                members[len(sa) - 1 - at] = members[len(sa) - 1 - at] + w
        order = sorted(range(len(sums)), key=lambda j: -sums[j])
        sums, members = [sums[j] for j in order], [members[j] for j in order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tie, sums, members))
        tie += 1
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity: the count rises until the heaviest fits."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        got = difference(lengths, k)
        if max((sum(lengths[i] for i in w) for w in got), default=0) <= capacity:
            return got
        k += 1


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Gives each piece its sequence and its offset there.

    Pieces of full length are a sequence each. A piece longer than the capacity is an error. Repeated
    rows (same document and start) are packed as often as they occur; no pieces give no rows."""
    pieces = stored(pieces, "pieces")
    size = pieces.agg(F.sum((F.col("length") < capacity).cast("long")), F.max("length")).first()
    if (size[1] or 0) > capacity:
        raise ValueError("a piece is longer than the capacity")
    blocks = max(1, -(-int(size[0] or 0) // block_pieces))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start"], ignore_index=True)
        lengths = frame["length"].tolist()
        seq, off = np.zeros(len(frame), "int64"), np.zeros(len(frame), "int64")
        first = int(frame["block"].iloc[0]) << 24
        small = [i for i, n in enumerate(lengths) if n < capacity]
        n = 0
        for w in windows([lengths[i] for i in small], capacity):
            at = 0
            for i in sorted(small[j] for j in w):
                seq[i], off[i] = first + n, at
                at += lengths[i]
            n += 1
        for i, length in enumerate(lengths):
            if length == capacity:
                seq[i] = first + n
                n += 1
        frame["sequence_id"], frame["offset"] = seq, off
        return frame.drop(columns="block")

    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks))
    return pieces.withColumn("block", block).groupBy("block").applyInPandas(deal, PACKED)


def op3_karmarkar_karp_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(document_pieces(docs, tokenizer_path()))
