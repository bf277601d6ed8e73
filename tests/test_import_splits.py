"""JSON arrays and CSV files cut over byte splits of any size, against Python's own readers."""
import contextlib
import csv
import io
import json
import os
import random

import pytest

from basketflow.sources import imports as src


@contextlib.contextmanager
def splits_of(spark, size):
    """Files are dealt out in splits of ``size`` bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        yield
    finally:
        for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def rows(df):
    return sorted((r["row_number"], json.loads(r["j"])) for r in df.selectExpr("row_number", "to_json(row) AS j").collect())


def value(rng, depth=0):
    kind = rng.randint(0, 9 if depth < 3 else 6)
    if kind < 4:
        return "".join(rng.choice(['a', '"', "\\", ",", "[", "]", "{", "}", "é", "\n", "日", ":", " "]) for _ in range(rng.randint(0, 12)))
    if kind < 7:
        return rng.choice([None, True, False, rng.randint(-10**6, 10**6), 0.5])
    if kind == 7:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_json_arrays_are_cut_in_parallel(spark, tmpdir_path, size):
    rng = random.Random(size)
    doc = [value(rng) for _ in range(25)]
    texts = [json.dumps(doc, ensure_ascii=False), "﻿ \n" + json.dumps(doc, indent=rng.choice([1, None])) + "\n \n"]
    with splits_of(spark, size):
        for i, text in enumerate(texts):
            got = src.read_json(spark, put(tmpdir_path, f"a{size}-{i}.json", text))
            assert rows(got) == sorted(enumerate(doc, 1), key=lambda x: x[0])


def test_a_large_array_uses_as_many_tasks_as_splits(spark, tmpdir_path):
    from basketflow.sources import json_splits
    doc = [{"id": i, "t": "x" * (i % 50)} for i in range(4000)]
    path = put(tmpdir_path, "big.json", json.dumps(doc))
    with splits_of(spark, 8192):
        splits = json_splits.file_splits(spark, path)
        n = os.path.getsize(path) // 8192
        assert splits.count() >= n and splits.select("kind").distinct().collect()[0][0] == "array"
        got = json_splits.fragments(json_splits.pieces(spark, path, ","), splits.drop("kind"))
        assert got.rdd.getNumPartitions() >= n
        assert rows(src.read_json(spark, path)) == list(enumerate(doc, 1))


@pytest.mark.parametrize("text,expected", [
    ("[]", []), (" [ \n ] ", []), ("", []), (" \n ", []), ("[[]]", [(1, [])]), ('{"a": [1, 2]}', [(1, {"a": [1, 2]})]), ('{\n"a": 1,\n"b": "x,y"}', [(1, {"a": 1, "b": "x,y"})]),
    ('{"a": 1}\n{"b": 2}', [(1, {"a": 1}), (2, {"b": 2})]), ("[1, 2]\n[3]\n", [(1, [1, 2]), (2, [3])]), ("\n\n[1]\n\n2", [(1, [1]), (3, 2)]), ("1\n2", [(1, 1), (2, 2)]), ('["a]", "[b"]', [(1, "a]"), (2, "[b")]),
])
@pytest.mark.parametrize("size", [7])
def test_json_shapes(spark, tmpdir_path, text, expected, size):
    with splits_of(spark, size):
        assert rows(src.read_json(spark, put(tmpdir_path, "x.json", text))) == expected


@pytest.mark.parametrize("text,line", [
    ("[1, 2,]", 1), ("[1,, 2]", 1), ("[1, 2", 1), ("[1] x", 1), ("[1],", 1), ('[{"a": 1]}', 1), ("[1, \n 2 3]", 1), ('{"a": 1}\n{"a": \n', 2), ('{"a" 1}', 1), ("[1]]", 1), ("]", 1), ('["a]', 1), ("[,]", 1), ("[1]\n[2],", 2),
])
def test_bad_json_fails_naming_the_line(spark, tmpdir_path, text, line):
    with splits_of(spark, 7), pytest.raises(src.ImportError_) as e:
        src.read_json(spark, put(tmpdir_path, "x.json", text))
    assert e.value.code == "IMPORT_INVALID_JSON" and f"line {line} " in e.value.message


@pytest.mark.parametrize("text", ["42", '"a,b"', " null ", "true"])
def test_a_scalar_file_is_refused(spark, tmpdir_path, text):
    with pytest.raises(src.ImportError_) as e:
        src.read_json(spark, put(tmpdir_path, "x.json", text))
    assert e.value.code == "IMPORT_INVALID_JSON" and "line" not in e.value.message.split("holds")[0]


def dealt(pieces, size, more):
    """The pieces as batches of three rows, in splits at every ``size`` bytes; ``more``: columns by split."""
    import pyarrow as pa
    rows, at = [], 0
    for piece in pieces:
        rows.append((piece, "f", max(0, at - 1) // size * size))
        at += len(piece) + 1
    for i in range(0, len(rows), 3):
        some = rows[i:i + 3]
        extra = {name: [by[start] for _, _, start in some] for name, by in more.items()}
        yield pa.RecordBatch.from_pydict({"piece": [r[0] for r in some], "file": [r[1] for r in some], "start": [r[2] for r in some], **extra})


def test_json_cuts_of_random_documents():
    from basketflow.sources import json_splits as J
    for seed in range(600):
        rng = random.Random(seed)
        doc, size = [value(rng) for _ in range(rng.randint(1, 12))], rng.randint(1, 60)
        data = json.dumps(doc, ensure_ascii=seed % 2 == 0, indent=seed % 3 or None).encode()
        scanned = sorted((r for b in J.scan_batches(dealt(data.split(b","), size, {})) for r in b.to_pylist()), key=lambda r: r["start"])
        assert sum(r["bytes"] for r in scanned) == len(data)
        begins, inside, depth, number = {"inside": {}, "depth": {}, "number": {}, "level": {}}, False, 0, 1
        for r in scanned:
            for name, x in zip(begins, (inside, depth, number, 1)):
                begins[name][r["start"]] = x
            levels = r["levels_in"] if inside else r["levels_out"]
            number += sum(x["commas"] for x in levels if x["depth"] + depth == 1)
            depth, inside = depth + (r["depth_in"] if inside else r["depth_out"]), inside ^ r["turns"]
        assert (inside, depth) == (False, 0)
        got = {}
        for b in J.cut_batches(dealt(data.split(b","), size, begins)):
            for r in b.to_pylist():
                got.setdefault(r["number"], []).append((r["start"], r["text"]))
        texts = ["".join(t for _, t in sorted(got[n])) for n in sorted(got)]
        assert json.loads(",".join(texts)) == doc and len(texts) == len(doc) and sorted(got) == list(range(1, len(doc) + 1)), seed


def test_json_folder_of_every_kind(spark, tmpdir_path):
    put(tmpdir_path, "a.json", "[1, 2]")
    put(tmpdir_path, "b.json", '{"x": 1}')
    put(tmpdir_path, "c.json", '{"x": 2}\n{"x": 3}\n')
    put(tmpdir_path, "d.json", "")
    got = src.read_json(spark, tmpdir_path)
    assert sorted((r["_file"][-6:], r["row_number"], r["j"]) for r in got.selectExpr("_file", "row_number", "to_json(row) j").collect()) == \
        [("a.json", 1, "1"), ("a.json", 2, "2"), ("b.json", 1, '{"x":1}'), ("c.json", 1, '{"x":2}'), ("c.json", 2, '{"x":3}')]


# ---- CSV --------------------------------------------------------------------------------------------------

def dict_reader(text):
    out = []
    for n, row in enumerate(csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline="")), start=2):
        row = dict(row)
        if None in row:
            row["null"] = row.pop(None)
        out.append((n, row))
    return out


def field(rng):
    plain = "".join(rng.choice("ab c'é") for _ in range(rng.randint(0, 5)))
    kind = rng.randint(0, 9)
    if kind < 4:
        return plain
    if kind < 8:
        return '"' + "".join(rng.choice(['x', '""', ",", "\n", "\r\n", "\r", "é", " "]) for _ in range(rng.randint(0, 6))) + '"'
    if kind == 8:
        return plain + 'x"' + plain  # a quote that opens nothing
    return '"' + plain + '"' + rng.choice(["z", 'z"', " ", ""])  # something after the closing quote


def table(rng, n):
    end = rng.choice(["\n", "\r\n", "\r"])
    lines = ["id,name,x"]
    for _ in range(n):
        lines.append(rng.choice(["", ",".join(field(rng) for _ in range(rng.randint(1, 5))), ",".join(field(rng) for _ in range(3))]))
    return end.join(lines) + rng.choice(["", end, end + end])


def test_csv_cuts_of_random_tables():
    from basketflow.sources import csv_splits as C
    for seed in range(1500):
        rng = random.Random(seed)
        text, size = table(rng, rng.randint(0, 12)), rng.randint(1, 60)
        data = text.encode()
        fed, pieces = data.endswith(b"\n"), data.removesuffix(b"\n").split(b"\n")
        scanned = sorted((r for b in C.scan_batches(dealt(pieces, size, {})) for r in b.to_pylist()), key=lambda r: r["start"])
        begins, inside, number = {"inside": {}, "number": {}, "fed": {}, "last": {}}, False, 1
        for r in scanned:
            for name, x in zip(begins, (inside, number, fed, r is scanned[-1])):
                begins[name][r["start"]] = x
            number += r["open_records"] if inside else r["closed_records"]
            inside = r["open_open"] if inside else r["closed_open"]
        got, ends = {}, {}
        for r in (r for b in C.cut_batches(dealt(pieces, size, begins)) for r in b.to_pylist()):
            if r["edge"]:
                ends.setdefault(r["number"], []).append((r["start"], r["raw"]))
            else:
                assert r["number"] not in got
                got[r["number"]] = r["fields"]
        for n, parts in ends.items():
            for fields in C.parsed(b"\n".join(raw for _, raw in sorted(parts))):
                assert n not in got
                got[n] = fields
        assert [got[n] for n in range(1, len(got) + 1)] == [r for r in csv.reader(io.StringIO(text, newline="")) if r], seed


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_csv_equals_the_dict_reader(spark, tmpdir_path, size):
    for seed in range(2):
        rng = random.Random(seed * 1000 + size)
        text = rng.choice(["", "﻿"]) + table(rng, 20)
        with splits_of(spark, size):
            got = rows(src.read_csv(spark, put(tmpdir_path, f"t{size}-{seed}.csv", text)))
        assert got == sorted(dict_reader(text), key=lambda x: x[0]), (size, seed)


@pytest.mark.parametrize("text", [
    "a,b\n1,2,3\n4\n", 'a,b\n"x\ny",2\n', 'a,b\n"open,2\nmore\n', 'a,b\n"open', "a,a\n1,2\n3\n", "a,b\r\n\r\n1,2\r\n", "a\n\n\n1", 'a,"b\nc"\n1,2', "a,null\n1,2,3\n",
])
def test_csv_odd_records(spark, tmpdir_path, text):
    with splits_of(spark, 7):
        assert rows(src.read_csv(spark, put(tmpdir_path, "o.csv", text))) == dict_reader(text)


def test_csv_extra_fields_are_kept(spark, tmpdir_path):
    got = rows(src.read_csv(spark, put(tmpdir_path, "e.csv", "customer_id,x\nc1,1,EXTRA\nc2\n")))
    assert got == [(2, {"customer_id": "c1", "x": "1", "null": ["EXTRA"]}), (3, {"customer_id": "c2", "x": None})]


@pytest.mark.parametrize("text", ["", "\na,b\n1,2\n", "\r\na\n"])
def test_csv_without_a_header_is_refused(spark, tmpdir_path, text):
    with pytest.raises(src.ImportError_) as e:
        src.read_csv(spark, put(tmpdir_path, "h.csv", text))
    assert e.value.code == "IMPORT_INVALID_CSV"


def test_csv_quoted_line_ends_are_split_across_tasks(spark, tmpdir_path):
    text = "id,t\n" + "".join(f'{i},"line {i}\nmore, ""{i}"""\n' for i in range(3000))
    with splits_of(spark, 4096):
        path = put(tmpdir_path, "q.csv", text)
        from basketflow.sources import csv_splits, json_splits
        n = os.path.getsize(path) // 4096
        assert json_splits.pieces(spark, path, "\n").rdd.getNumPartitions() >= n
        assert csv_splits.records(spark, path, csv_splits.file_splits(spark, path)).count() == 3001
        assert rows(src.read_csv(spark, path)) == dict_reader(text)
