"""CSV records over byte splits, quoted line ends included.

Lines are dealt out by byte splits. Whether a line lies inside a quoted field depends on everything before
it, so each split is first run through under both assumptions: it begins between records, or inside a
quoted field. A line without quotes keeps either state, so only lines with quotes are looked at. A prefix scan
over the splits of a file (one row a split) then settles where each one begins and how many records begin
before it; in a second pass whole records inside a split are parsed where they lie, and those that cross a
split's end are joined by their number.

Records follow the rules of the csv module's default dialect: a quote opens a field only at its
beginning, a doubled quote inside stands for one, what follows a closing quote is taken as it is, a record
ends at a line feed, a carriage return or both, blank lines are no records, and a quoted field that is
still open at the end of the file ends there.
"""

from __future__ import annotations

import csv
import io
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .json_splits import lost_separator, pieces, stretches, written

#: what a line is made of between its separators; quantifiers never give back what they took
_FIELD = rb'(?:"(?:[^"]++|"")*+"(?!")[^,\r]*+|[^",\r][^,\r]*+|)'
CLOSED = re.compile(rb"%s(?:[,\r]%s)*+" % (_FIELD, _FIELD))
#: the same for a line that begins inside a quoted field
CLOSING = re.compile(rb'(?:[^"]++|"")*+"(?!")[^,\r]*+(?:[,\r]%s)*+' % _FIELD)

SCANNED = "file string, start long, bytes long, blank_first boolean, closed_open boolean, closed_records long, open_open boolean, open_records long"
RECORD = "file string, number long, start long, edge boolean, raw binary, fields array<string>"


def runs_on(line: bytes, inside: bool) -> bool:
    """Whether the line's end lies inside a quoted field."""
    return not (CLOSING if inside else CLOSED).fullmatch(line)


def records_of(line: bytes, inside: bool) -> list[bytes]:
    """A line cut at the carriage returns outside quoted fields, each of which ends a record."""
    if b"\r" not in line[:-1]:
        return [line]
    parts, low, quoted, opens = [], 0, inside, True
    i = 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == 34:
                if line[i + 1:i + 2] == b'"':
                    i += 1
                else:
                    quoted, opens = False, False
        elif c == 13:
            parts.append(line[low:i])
            low, opens = i + 1, True
        else:
            quoted, opens = opens and c == 34, c == 44
        i += 1
    return [*parts, line[low:]]


def ended(part: bytes, inside: bool, after: bool) -> int:
    """Whether a record ends with the part; a blank one is none."""
    return int(not after and (inside or part not in (b"", b"\r")))


def scan_batches(batches):
    key, size, blank, inside, records = None, 0, False, [False, True], [0, 0]
    names = [x.split()[0] for x in SCANNED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]

    def report():
        values = (*key, size, blank, inside[0], records[0], inside[1], records[1])
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], names=names)

    for _, _, file, start, data, n in stretches(batches, b"\n"):
        fresh = (file, start) != key
        if fresh:
            if key:
                yield report()
            key, size, inside, records = (file, start), 0, [False, True], [0, 0]
        # the line feed that leads a stretch belongs to the line before
        first = fresh and start == 0
        lines = (data if first else data[1:]).split(b"\n")
        blank = first and lines[0][:1] in (b"", b"\r") or blank and not fresh
        size += n
        odd = [i for i, line in enumerate(lines) if b'"' in line or b"\r" in line]
        filled = np.fromiter((len(line) > 0 for line in lines), "int64", len(lines))
        upto = np.concatenate([[0], np.cumsum(filled)])
        for state in (0, 1):
            at = 0
            for i in odd:
                if not inside[state]:
                    records[state] += int(upto[i] - upto[at])
                for part in records_of(lines[i], inside[state]):
                    after = runs_on(part, inside[state]) if b'"' in part else inside[state]
                    records[state] += ended(part, inside[state], after)
                    inside[state] = after
                at = i + 1
            if not inside[state]:
                records[state] += int(upto[len(lines)] - upto[at])
    if key:
        yield report()


def scan_splits(rows: DataFrame) -> DataFrame:
    """One row for each split: whether a quoted field is open at its end and how many records end in it, if it
    begins between records and if it begins inside a quoted field."""

    return rows.select("piece", "file", "start").mapInArrow(scan_batches, SCANNED)


def settle(scanned: DataFrame) -> DataFrame:
    """Each split with its true beginning (``inside`` a quoted field), the ``number`` of the record that ends first in
    it (from 1), whether it is the file's last and whether the file ends with a line feed (``fed``). A split keeps the
    state that it begins with, turns it, or sets it; the last setting split and the turns since tell a split's beginning."""
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.col("closed_open") == F.col("open_open"), F.lit("sets")).when(F.col("closed_open"), F.lit("turns")).otherwise(F.lit("keeps"))
    s = scanned.withColumn("kind", kind)
    s = s.withColumn("turned", F.coalesce(F.sum((F.col("kind") == "turns").cast("int")).over(before), F.lit(0)))
    # the state that the last setting split left, and how often it has been turned since (its own count included)
    set_at = F.when(F.col("kind") == "sets", F.struct("start", "closed_open", "turned"))
    s = s.withColumn("set", F.max(set_at).over(before))
    since = F.col("turned") - F.coalesce(F.col("set.turned"), F.lit(0))
    s = s.withColumn("inside", F.coalesce(F.col("set.closed_open"), F.lit(False)) != (since % 2 == 1))
    s = s.withColumn("records", F.when(F.col("inside"), F.col("open_records")).otherwise(F.col("closed_records")))
    number = F.coalesce(F.sum("records").over(before), F.lit(0)) + 1
    return s.select("file", "start", "inside", "blank_first", number.alias("number"), lost_separator(whole).alias("fed"),
                    (F.max("start").over(whole) == F.col("start")).alias("last"))


def parsed(raw: bytes) -> list[list[str]]:
    """The records of whole lines, without blank ones; bytes that are no UTF-8 become U+FFFD."""
    csv.field_size_limit(sys.maxsize)
    return [row for row in csv.reader(io.StringIO(raw.decode("utf-8", "replace"), newline="")) if row]


def cut_batches(batches):
    key, ready = None, []

    def close():
        if held:
            ready.append((key[0], number, key[1], True, b"\n".join(held) + b"\n" * (last and fed), None))

    for batch, a, file, start, data, _ in stretches(batches, b"\n"):
        if (file, start) != key:
            if key:
                close()
            key = (file, start)
            inside, number, fed, last = (batch.column(i)[a].as_py() for i in (3, 4, 5, 6))
            held, edge = [], inside
            lines = (data if start == 0 else data[1:]).split(b"\n")
        else:
            lines = data[1:].split(b"\n")
        whole: list[bytes] = []
        for line in lines:
            for part in records_of(line, inside):
                after = runs_on(part, inside) if b'"' in part else inside
                if not (inside or after):
                    whole.append(part)
                else:
                    held.append(part)
                    if not after and edge:  # it began in an earlier split
                        ready.append((file, number, start, True, b"\n".join(held), None))
                        number, edge, held = number + 1, False, []
                    elif not after:
                        whole.append(b"\n".join(held))
                        held = []
                inside = after
        for fields in parsed(b"".join(x + b"\n" for x in whole)):
            ready.append((file, number, start, False, None, fields))
            number += 1
        if ready:
            yield _records(ready)
            ready.clear()
    if key:
        close()
    if ready:
        yield _records(ready)


def cut(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """file, number and fields of every record inside a split, and the raw lines of those that cross its ends
    (``edge``). ``splits`` has one row for each split, a table like the list of splits that the driver plans the scan with,
    and is broadcast."""
    known = rows.join(F.broadcast(splits), ["file", "start"]).select("piece", "file", "start", "inside", "number", "fed", "last")

    return known.mapInArrow(cut_batches, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in RECORD.split(", ")])


def file_splits(spark: SparkSession, path: str) -> DataFrame:
    """The settled splits of every file under ``path`` that is not empty, written once."""
    lines = pieces(spark, path, "\n")
    sizes = lines.groupBy("file").agg(F.max("file_size").alias("file_size"))
    return written(settle(written(scan_splits(lines), "csv-splits").join(sizes, "file")), "csv-begins")


def records(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """(file, number, fields) of every record of the files, numbered from 1 by file without blank lines; written
    once."""
    got = written(cut(pieces(spark, path, "\n"), splits.drop("blank_first")), "csv-fragments")
    ends = got.filter("edge").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "raw"))).alias("parts"))

    def join(batches):
        for batch in batches:
            out = []
            for file, number, parts in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(file, number, fields) for fields in parsed(b"\n".join(p["raw"] for p in parts))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.string())))], names=["file", "number", "fields"])

    joined = ends.select("file", "number", "parts").mapInArrow(join, "file string, number long, fields array<string>")
    return written(got.filter("NOT edge").select("file", "number", "fields").unionByName(joined), "csv-records")
