"""Top-level elements of huge JSON arrays, found in parallel over byte splits.

A JSON file may be one line, so it is not read by lines but as pieces between commas, which Spark's text
reader deals out by byte splits; a split's pieces, with the commas put back, are a stretch of the file.

1. Every stretch is scanned once without knowing what it begins in: under both assumptions (outside or
   inside a string) it reports whether it changes that state, by how much it changes the nesting depth, and
   at which relative depths its commas and its other characters lie (small histograms).
2. A prefix scan over the splits of a file (one row a split) settles the state and the depth that each split
   begins with, hence whether the file is one whole array, one whole object or neither, and how many
   elements begin before the split.
3. Splits of whole arrays and objects are read again and cut at the commas between elements. Elements inside a
   split are ready; those at its ends are fragments, joined by their number.

No row holds more than one element, and nothing is gathered by file but one row for each split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

COMMA, QUOTE, BACKSLASH = ord(","), ord('"'), ord("\\")
#: change of the nesting depth by byte
STEP = np.zeros(256, "int8")
STEP[[ord("["), ord("{")]], STEP[[ord("]"), ord("}")]] = 1, -1
BLANK = np.zeros(256, "bool")
BLANK[[9, 10, 13, 32]] = True
BOM = b"\xef\xbb\xbf"

#: one level of a stretch: relative depth, commas there, other characters that leave the depth there
LEVELS = "array<struct<depth:long,commas:long,others:long>>"
SCANNED = f"file string, start long, bytes long, first_byte int, turns boolean, depth_out long, depth_in long, levels_out {LEVELS}, levels_in {LEVELS}"
FRAGMENT = "file string, number long, start long, edge boolean, text string"


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The bytes between separators, with their file, the first byte of their split and the file's size; rows of
    a split follow each other in file order."""
    m = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("value").cast("binary").alias("piece"), m["file_path"].alias("file"), m["file_block_start"].alias("start"), m["file_size"].alias("file_size"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs(batch: pa.RecordBatch):
    """(file, start, first row, end row) of each split's rows in a batch of piece, file, start, ..."""
    if not batch.num_rows:
        return
    files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(starts)]):
        yield files.dictionary[int(codes[a])].as_py(), int(starts[a]), int(a), int(b)


def stretches(batches, separator: bytes):
    """(batch, first row, file, start, bytes, size) of each split's rows in each batch: with the separators put
    back, the bytes of all stretches are the file's, less a byte order mark and a separator at its end."""
    key = None
    for batch in batches:
        for file, start, a, b in runs(batch):
            data = separator.join(batch.column(0).slice(a, b - a).to_pylist())
            if (file, start) != key and start == 0:
                size, data = len(data), data.removeprefix(BOM)
            else:
                data = separator + data
                size = len(data)
            key = (file, start)
            yield batch, a, file, start, data, size


# ---- structure ------------------------------------------------------------------------------------------

def _quotes(data: np.ndarray) -> np.ndarray:
    """Where quotes are that no odd run of backslashes precedes."""
    at = np.flatnonzero(data == QUOTE)
    if not (data == BACKSLASH).any():
        return at
    other = np.flatnonzero(data != BACKSLASH)
    before = np.searchsorted(other, at) - 1
    run = at - 1 - np.where(before >= 0, other[np.maximum(before, 0)], -1)
    return at[run % 2 == 0]


class Scan:
    """Strings, depth and commas of a stretch, relative to its start. A comma after a backslash is no JSON, so a
    stretch never begins inside an escape."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, "uint8")
        self.quotes = _quotes(self.bytes)
        self.turns = len(self.quotes) % 2 == 1
        odd = np.zeros(len(self.bytes), "int8")
        odd[self.quotes] = 1
        # a character is in a string if an odd number of quotes precede it; quotes count as outside
        self.odd = np.cumsum(odd, dtype="int8") & 1 ^ odd

    def view(self, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a character is outside strings, depth after it, where the commas are)."""
        out = self.odd == inside
        out[self.quotes] = True
        depth = np.cumsum(np.where(out, STEP[self.bytes], 0), dtype="int32")
        return out, depth, np.flatnonzero(out & (self.bytes == COMMA))


class Levels:
    """Numbers of commas and of other characters by relative depth. Depths change in steps of one, so the counts are
    an array; text scanned under the wrong assumption may drift by a level an element."""

    def __init__(self):
        self.low, self.counts = 0, np.zeros((2, 1), "int64")

    def add(self, kind: int, depths: np.ndarray) -> None:
        """Counts characters of a ``kind`` (0 commas, 1 others) at these depths."""
        if not len(depths):
            return
        low = int(depths.min())
        got = np.bincount(depths - low)
        n = self.counts.shape[1]
        left, right = max(0, self.low - low), max(0, low + len(got) - self.low - n)
        if left or right:  # at least half as much again, so that a drift is not copied at every step
            wide = [max(x, n // 2) if x else 0 for x in (left, right)]
            self.counts, self.low = np.pad(self.counts, ((0, 0), wide)), self.low - wide[0]
        self.counts[kind, low - self.low:low - self.low + len(got)] += got

    def listed(self) -> pa.Array:
        """One list of (depth, commas, others), by depth."""
        held = np.flatnonzero(self.counts.any(axis=0))
        rows = pa.StructArray.from_arrays([pa.array(held + self.low, pa.int64()), *[pa.array(c[held]) for c in self.counts]], names=["depth", "commas", "others"])
        return pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), rows)


def _count(scan: Scan, out: np.ndarray, depth: np.ndarray, commas: np.ndarray, base: int, into: Levels) -> None:
    others = ~out | ~BLANK[scan.bytes]
    others[commas] = False
    for kind, at in ((0, depth[commas]), (1, depth[others])):
        into.add(kind, at + base)


def scan_batches(batches):
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCANNED.replace(LEVELS, "levels").split(", ")]
    key, size, first, inside, depth, levels = None, 0, None, [False, True], [0, 0], [Levels(), Levels()]

    def report():
        plain = [pa.array([x], t) for x, t in zip((*key, size, first, inside[0], *depth), types)]
        return pa.RecordBatch.from_arrays([*plain, *[x.listed() for x in levels]], names=names)

    for _, _, file, start, data, n in stretches(batches, b","):
        if (file, start) != key:
            if key:
                yield report()
            key, size, first, inside, depth, levels = (file, start), 0, None, [False, True], [0, 0], [Levels(), Levels()]
        size += n
        if first is None and (text := data.lstrip(b" \t\r\n")):
            first = text[0]
        scan = Scan(data)
        for i in (0, 1):
            out, at, commas = scan.view(inside[i])
            _count(scan, out, at, commas, depth[i], levels[i])
            depth[i] += int(at[-1]) if len(at) else 0
            inside[i] ^= scan.turns
    if key:
        yield report()


def scan_splits(rows: DataFrame) -> DataFrame:
    """One row for each split: what it does to state and depth under both assumptions."""

    return rows.select("piece", "file", "start").mapInArrow(scan_batches, SCANNED)


def lost_separator(whole) -> Column:
    """Whether a separator at the file's end is missing from its stretches. The reader itself may have left out a
    byte order mark (three bytes)."""
    return (F.col("file_size") - F.sum("bytes").over(whole)).isin(1, 4)


def _at(depth: Column, field: str) -> Column:
    """The count of a level, 0 if there is none."""
    return F.aggregate(F.filter("levels", lambda x: x["depth"] == depth), F.lit(0).cast("long"), lambda n, x: n + x[field])


def settle(scanned: DataFrame) -> DataFrame:
    """Each split with its true beginning (``inside`` a string, ``depth``), the ``number`` of the array element that it
    begins in (from 1), the depth ``level`` of the commas between elements, and the ``kind`` of its file: array,
    object, or other if the file is neither whole."""
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("turns").cast("int")
    s = scanned.withColumn("inside", F.coalesce(F.sum(turns).over(before), F.lit(0)) % 2 == 1)
    s = s.withColumn("change", F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out")))
    s = s.withColumn("levels", F.when(F.col("inside"), F.col("levels_in")).otherwise(F.col("levels_out")))
    s = s.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    outermost = _at(-F.col("depth"), "others") + _at(-F.col("depth"), "commas")
    s = s.withColumns({"commas": _at(1 - F.col("depth"), "commas"), "outermost": outermost, "below": F.exists("levels", lambda x: x["depth"] + F.col("depth") < 0)})
    first = F.min(F.when(F.col("first_byte").isNotNull(), F.struct("start", "first_byte"))).over(whole)["first_byte"]
    # of a whole value only the last bracket leaves the depth at 0; no comma was lost at the file's end
    one = (F.sum("outermost").over(whole) == 1) & ~F.max("below").over(whole) & (F.sum("change").over(whole) == 0) \
        & (F.sum(turns).over(whole) % 2 == 0) & ~lost_separator(whole)
    kind = F.when(one & (first == ord("[")), "array").when(one & (first == ord("{")), "object").otherwise("other")
    number = F.coalesce(F.sum("commas").over(before), F.lit(0)) + 1
    s = s.select("file", "start", "inside", "depth", number.alias("number"), kind.alias("kind"))
    return s.withColumn("number", F.when(F.col("kind") == "object", 1).otherwise(F.col("number"))).withColumn("level", (F.col("kind") == "array").cast("int"))


def file_splits(spark: SparkSession, path: str) -> DataFrame:
    """The settled splits of every file under ``path`` that is not empty, written once."""
    rows = pieces(spark, path, ",")
    sizes = rows.groupBy("file").agg(F.max("file_size").alias("file_size"))
    return written(settle(written(scan_splits(rows), "json-splits").join(sizes, "file")), "json-begins")


# ---- elements -------------------------------------------------------------------------------------------

def cut_batches(batches):
    key, ready = None, []
    for batch, a, file, start, data, _ in stretches(batches, b","):
        if (file, start) != key:
            if key:
                ready.append((key[0], number, key[1], True, held))
            key, held, edge = (file, start), b"", True
            inside, depth, number, level = (batch.column(i)[a].as_py() for i in (3, 4, 5, 6))
        scan = Scan(data)
        _, at, commas = scan.view(inside)
        low = 0
        for cut in commas[at[commas] == level - depth].tolist():
            ready.append((file, number, start, edge, held + data[low:cut]))
            held, edge, low, number = b"", False, cut + 1, number + 1
        held += data[low:]
        inside, depth = inside ^ scan.turns, depth + (int(at[-1]) if len(at) else 0)
        if ready:
            yield _fragments(ready)
            ready = []
    if key:
        yield _fragments([*ready, (key[0], number, key[1], True, held)])


def fragments(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """The texts between the commas of whole files. ``splits`` has one row for each split, a table like the list
    of splits that the driver plans the scan with, and is broadcast."""
    known = rows.join(F.broadcast(splits), ["file", "start"]).select("piece", "file", "start", "inside", "depth", "number", "level")

    return known.mapInArrow(cut_batches, FRAGMENT)


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    files, numbers, starts, edges, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(files), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(edges),
                                       pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[x.split()[0] for x in FRAGMENT.split(", ")])


def values(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """(file, number, text) of every element of whole arrays, numbered from 1, and of whole objects (number 1).
    An array of blanks has no element; whatever stands between two commas comes out, JSON or not.

    A fragment that is split inside a character of several bytes does not occur: splits end at commas."""
    whole = splits.filter("kind <> 'other'")
    got = fragments(pieces(spark, path, ","), whole.drop("kind"))
    ends = got.filter("edge").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    ends = ends.select("file", "number", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    # the brackets of an array are at the ends of its first and last fragments, which are edges
    last = whole.groupBy("file").agg(F.max("number").alias("_least"), F.max("kind").alias("_kind"))
    top = ends.groupBy("file").agg(F.max("number").alias("_last"))
    text, array = F.col("text"), F.col("_kind") == "array"
    text = F.when(array & (F.col("number") == 1), F.regexp_replace(text, r"^[ \t\r\n]*\[", "")).otherwise(text)
    text = F.when(array & (F.col("number") == F.col("_last")), F.regexp_replace(text, r"\][ \t\r\n]*\z", "")).otherwise(text)
    ends = ends.join(top, "file").join(last, "file").withColumn("text", text)
    ends = ends.filter(~(array & (F.col("_last") == 1) & F.col("text").rlike(r"\A[ \t\r\n]*\z")))
    return got.filter("NOT edge").select("file", "number", "text").unionByName(ends.select("file", "number", "text"))
