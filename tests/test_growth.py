"""What a table's growth must not make larger than the table: a task's share, rows that travel twice, work per line."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketflow.operators import raw
from basketflow.plans import catalog, tables
from basketflow.session import checkpoint_dir
from basketflow.sources import json_splits

D = "/root/testdata/sf0.001"


@pytest.fixture
def made(spark):
    """The folders that a query has made in the scratch folder, by the beginning of their name."""
    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/*"))
    return lambda name: sorted(p for p in glob.glob(f"{base}/{name}*") if p not in before)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_quality_reads_as_many_files_as_a_shuffle_has_partitions(spark, made):
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = catalog.QUERIES["quality_snapshot_kept"](spark, D).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    (folder,) = made("raw-purchases")
    assert len(glob.glob(f"{folder}/*.parquet")) == 7
    # two micro-batches of rows, none more in the second run
    (kept,) = made("kept-quality")
    assert len(glob.glob(f"{kept}/rows/entity=purchases/batch=*")) == 2
    assert {r["entity"]: r["total_rows_raw"] for r in rows}["purchases"] == tables.messages(spark, D, "purchases").count()


def test_document_files_lie_in_folders_of_their_tasks(spark, made):
    got = catalog.QUERIES["src_json_document_files"](spark, D)
    stores = spark.read.parquet(f"{D}/supplier.parquet").count()
    assert got.where("has_file").count() == stores
    (folder,) = made("doc-files")
    assert len(glob.glob(f"{folder}/folder=*/part-*")) == stores and not glob.glob(f"{folder}/part-*")


def test_counts_do_not_make_the_texts_of_lines(spark):
    sent = tables.written_purchases(spark, D)
    assert "StructsToJson" not in plan(catalog._final(spark, D, "purchase_items", sent))
    assert "payload" not in catalog._final(spark, D, "purchases").columns


def test_compacted_parts_travel_once_and_without_message_texts(spark, made):
    catalog.QUERIES["compact_latest_merged"](spark, D)
    (rows,) = [p for p in made("compacted-purchases") if p.endswith("-in")]
    assert "payload" not in spark.read.parquet(rows).columns


def test_uploads_are_written_in_batches(spark, tmp_path):
    seen = []
    lines = spark.range(5).select(F.col("id").cast("string").alias("x")).coalesce(1)

    class Rows:
        def select(self, _):
            return self

        def mapInArrow(self, framed, _):
            batches = [pa.RecordBatch.from_pydict({"value": v}) for v in (["a", "b", "c"], [], ["d"], [None, "e"])]
            seen.extend(b.column(0).to_pylist() for b in framed(batches))
            return lines.select(F.col("x").alias("value"))

    catalog._upload(Rows(), str(tmp_path / "up"), F.col("x"), "[", ",", "]")
    assert seen == [["[a,", "b,"], ["c,"], ["d,"], ["e]"]]


def test_levels_of_a_drifting_text():
    rng = np.random.default_rng(5)
    levels, known = json_splits.Levels(), {}
    for base in (0, -700, 900, 5000):
        for kind in (0, 1):
            depths = base + np.cumsum(rng.integers(-1, 2, 400))
            levels.add(kind, depths)
            for d in depths.tolist():
                known.setdefault(d, [0, 0])[kind] += 1
    got = levels.listed().to_pylist()[0]
    assert got == [{"depth": d, "commas": c, "others": o} for d, (c, o) in sorted(known.items())]
    # two counts a level, not Python objects
    assert levels.counts.nbytes < 16 * 2 * (5000 + 2000)


def test_scanned_stretch_of_wrongly_read_strings():
    text = ",".join('{"note": "[1, \\"{\\"] ,"}' for _ in range(500))
    batch = pa.RecordBatch.from_pydict({"piece": [p.encode() for p in text.split(",")], "file": ["f"] * (text.count(",") + 1), "start": [0] * (text.count(",") + 1)})
    (row,) = [r for b in json_splits.scan_batches([batch]) for r in b.to_pylist()]
    commas = sum(x["commas"] for x in row["levels_out"])
    assert (row["depth_out"], row["turns"]) == (0, False) and commas == 499
def test_topics_are_compressed(spark, made):
    catalog._stamped_topic(spark, D, "stores")
    (topic,) = made("topic-stores")
    files = glob.glob(f"{topic}/part-*")
    assert files and all(f.endswith(".lz4") for f in files)


def test_line_ids_are_extracted_once(spark):
    items = raw.raw_purchase_items(raw.raw_purchases(tables.messages(spark, D, "purchases"), keep_doc=True))
    text = plan(items.drop("payload"))
    # its type and its value
    assert text.count("$['product_id']") == 2


def test_the_time_grammar_names_its_text_once(spark):
    sent = tables.messages(spark, D, "purchases")
    assert plan(raw.raw_purchases(sent).select("purchase_datetime")).count("$['purchase_datetime']") == 2
