import json
import os

import pytest

from basketflow.operators import imports
from basketflow.sources import imports as src


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def _rows(df):
    return sorted((r["row_number"], json.loads(r["row_json"])) for r in
                  df.selectExpr("row_number", "to_json(row) AS row_json").collect())


def test_detect_format():
    assert src.detect_format("a.JSONL") == "jsonl"
    with pytest.raises(src.ImportError_):
        src.detect_format("a.xlsx")


def test_csv_bom_and_numbering(spark, tmpdir_path):
    p = _write(tmpdir_path, "s.csv", "﻿store_id,name\nstore-001,A\n  ,B\n\"store-003\",\"multi\nline\"\n")
    rows = _rows(src.read_csv(spark, p))
    assert [r[0] for r in rows] == [2, 3, 4]
    assert rows[0][1]["store_id"] == "store-001"
    v = imports.validate(src.read_csv(spark, p), "stores")
    assert sorted(r["row_number"] for r in v.where("size(errors) > 0").collect()) == [3]


def test_csv_header_only_and_empty(spark, tmpdir_path):
    p = _write(tmpdir_path, "h.csv", "store_id,name\n")
    s, e, st = imports.run_batch(spark, p, "b1", "stores")
    assert s.first()["status"] == "failed" and s.first()["total_rows"] == 0
    p2 = _write(tmpdir_path, "e.csv", "")
    s2, e2, _ = imports.run_batch(spark, p2, "b2", "stores")
    assert s2.first()["invalid_rows"] == 1 and e2.first()["error_code"] == "import_invalid_csv"


def test_json_array_object_lines(spark, tmpdir_path):
    a = _write(tmpdir_path, "a.json", json.dumps([{"id": "x"}, {"product_id": " "}, 5]))
    rows = _rows(src.read_json(spark, a))
    assert [r[0] for r in rows] == [1, 2, 3]
    v = imports.validate(src.read_json(spark, a), "products")
    codes = {r["row_number"]: [e["error_code"] for e in r["errors"]] for r in v.collect()}
    assert codes == {1: [], 2: ["required_field_missing"], 3: ["invalid_row_type"]}
    o = _write(tmpdir_path, "o.json", '\n\n  {"customer_id": "c",\n "x": 1}\n')
    assert [r[0] for r in _rows(src.read_json(spark, o))] == [1]
    ln = _write(tmpdir_path, "l.jsonl", '\n{"purchase_id": "p1"}\n\n{"purchase_id": ""}\n{"x": 1}\n')
    assert [r[0] for r in _rows(src.read_json(spark, ln))] == [1, 3, 4]


def test_json_bad_line_and_scalar(spark, tmpdir_path):
    bad = _write(tmpdir_path, "b.jsonl", '{"a": 1}\n{"a": 2}\n{"a": \n')
    with pytest.raises(src.ImportError_) as ei:
        src.read_json(spark, bad)
    assert "line 3" in ei.value.message
    sc = _write(tmpdir_path, "s.json", "42")
    with pytest.raises(src.ImportError_):
        src.read_json(spark, sc)


def test_summary_status_and_all_errors(spark, tmpdir_path):
    lines = "\n".join(json.dumps({"customer_id": "" if i % 2 else f"c{i}"}) for i in range(1200))
    p = _write(tmpdir_path, "c.jsonl", lines)
    s, e, st = imports.run_batch(spark, p, "b3", "customers")
    r = s.first()
    assert (r["status"], r["total_rows"], r["valid_rows"], r["invalid_rows"]) == ("partial", 1200, 600, 600)
    assert e.count() == 600 and e.agg({"row_number": "max"}).first()[0] == 1200
    assert st.count() == 600 and st.where("business_key = 'c0'").count() == 1


def test_business_key_types(spark, tmpdir_path):
    p = _write(tmpdir_path, "p.json", json.dumps([{"id": 7}, {"product_id": "  p-1 ", "id": "z"}, {"id": True}]))
    s, e, st = imports.run_batch(spark, p, "b4", "products")
    assert sorted(r["business_key"] for r in st.collect()) == ["7", "True", "p-1"]


def test_row_numbers_exact_across_many_splits(spark, tmpdir_path):
    n = 3000
    p = _write(tmpdir_path, "big.jsonl", "\n".join(json.dumps({"purchase_id": f"p{i}"}) for i in range(1, n + 1)))
    csvp = _write(tmpdir_path, "big.csv", "purchase_id,x\n" + "\n".join(f"p{i},{i}" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # dozens of splits per file
    try:
        lines = src.read_json(spark, p)
        assert lines.rdd.getNumPartitions() > 5
        got = {(r["row_number"], r["pid"]) for r in lines.selectExpr(
            "row_number", "try_variant_get(row, '$.purchase_id', 'string') AS pid").collect()}
        assert got == {(i, f"p{i}") for i in range(1, n + 1)}
        rows = src.read_csv(spark, csvp)
        got = {(r["row_number"], r["pid"]) for r in rows.selectExpr(
            "row_number", "try_variant_get(row, '$.purchase_id', 'string') AS pid").collect()}
        assert got == {(i + 1, f"p{i}") for i in range(1, n + 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pages_of_a_stored_batch_open_only_their_files(spark, tmpdir_path):
    rows = [("b1", i // 2, f"f{i % 2}", "c", "m", "{}") for i in range(400)] + [("b2", 5, "f", "c", "m", "{}")]
    schema = "batch_id string, row_number long, field_name string, error_code string, message string, raw_fragment string"
    all_rows = spark.createDataFrame(rows, schema)
    for batch in ("b1", "b2"):
        s = imports.failed_batch(spark, batch, "customers", "X", "m")[0]
        st = imports.failed_batch(spark, batch, "customers", "X", "m")[2]
        imports.write_batch(tmpdir_path, s, all_rows.where(f"batch_id = '{batch}'").repartition(3), st)
    want = sorted((r[1], r[2]) for r in rows if r[0] == "b1")
    for offset, limit in ((0, 7), (3, 100), (390, 50), (400, 5), (199, 2)):
        page, total = imports.stored_page(spark, tmpdir_path, "errors", "b1", all_rows.schema, limit, 1000, offset)
        assert total == 400 and [(r.row_number, r.field_name) for r in page.collect()] == want[offset:offset + limit]
    assert imports.stored_page(spark, tmpdir_path, "staging", "b1", st.schema, 5, 500)[1] == 0
    assert imports.stored_page(spark, tmpdir_path, "errors", "gone", all_rows.schema, 5, 500)[1] == 0
    with pytest.raises(ValueError):
        imports.stored_page(spark, tmpdir_path, "errors", "b1", all_rows.schema, 0, 1000)


def test_replays_are_guarded_and_numbered_once(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    p = _write(tmpdir_path, "c.jsonl", '{"customer_id": "c1"}\n{"customer_id": ""}\n')
    s, e, st = imports.run_batch(spark, p, "b1", "customers")
    imports.write_batch(out, s, e, st)
    imports.replay_batch(spark, out, p, "b1", "customers")
    assert spark.read.parquet(f"{out}/batches").first()["replay_count"] == 1
    assert [imports.claim_attempt(spark, out, "b1") for _ in range(2)] == [2, 3]
    with pytest.raises(src.ImportError_) as gone:
        imports.replay_batch(spark, out, p + ".gone", "b1", "customers")
    assert gone.value.code == "IMPORT_FILE_MISSING"
    assert imports._create_new(spark, f"{out}/running/b1") and not imports._create_new(spark, f"{out}/running/b1")
    with pytest.raises(src.ImportError_) as busy:
        imports.replay_batch(spark, out, p, "b1", "customers")
    assert busy.value.code == "IMPORT_BUSY"
