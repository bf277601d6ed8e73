"""The compacted table: readers see whole versions, writers lose races without losing rows."""
import random
import threading

import pytest

from basketflow.operators.compacted import CompactedTable, ConcurrentWriters
from basketflow.operators.latest import latest_by_key
from basketflow.session import scratch_path

SCHEMA = "k string, j int, ingested_at long, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def batch(rng, n, keys):
    return [(rng.choice([None, *(f"k{i}" for i in range(keys))]), rng.randint(0, 1), rng.randint(0, 50), rng.choice("abc")) for _ in range(n)]


def test_merges_equal_one_pass_over_everything(spark):
    rng = random.Random(1)
    t = CompactedTable(spark, scratch_path(spark, "t-compacted"), ["k", "j"], buckets=4)
    with pytest.raises(FileNotFoundError):
        t.read()
    everything, snapshots = [], []
    for n in (30, 1, 40, 5):
        everything += batch(rng, n, 25)
        number = t.merge(spark.createDataFrame(everything[-n:], SCHEMA))
        want = rows_of(latest_by_key(spark.createDataFrame(everything, SCHEMA), ["k", "j"]))
        assert rows_of(t.read()) == want
        snapshots.append((number, want))
    for number, want in snapshots:  # old versions stay as they were
        assert rows_of(t.read(number)) == want
    before = rows_of(t.read())
    t.merge(spark.createDataFrame(everything[-5:], SCHEMA))  # again
    assert rows_of(t.read()) == before
    assert t.merge(spark.createDataFrame([], SCHEMA)) == max(t.versions())
    assert t.expire(keep=2) == len(snapshots) + 1 - 2 and rows_of(t.read()) == before


def test_only_touched_buckets_change_and_new_keys_are_appended(spark):
    t = CompactedTable(spark, scratch_path(spark, "t-compacted"), ["k"], buckets=8)
    schema = "k string, ingested_at long"
    t.merge(spark.createDataFrame([(f"k{i}", 0) for i in range(60)], schema))
    first = t.manifest()["parts"]
    t.merge(spark.createDataFrame([("k7", 1)], schema))
    second = t.manifest()["parts"]
    changed = [b for b in second if second[b] != first.get(b)]
    assert len(changed) == 1 and len(second[changed[0]]) == 1  # the key was there: rewritten
    t.merge(spark.createDataFrame([("new", 1)], schema))
    third = t.manifest()["parts"]
    changed = [b for b in third if third[b] != second.get(b)]
    assert len(changed) == 1 and third[changed[0]][:-1] == second.get(changed[0], [])  # a part of its own
    assert t.read().where("k in ('k7', 'new')").count() == 2 and t.read().count() == 61


def test_a_writer_that_lost_the_race_merges_again(spark, monkeypatch):
    path = scratch_path(spark, "t-compacted")
    one, two = (CompactedTable(spark, path, ["k"], buckets=2) for _ in range(2))
    schema = "k string, ingested_at long"
    create, raced = one._create, []

    def slow(manifest):
        if not raced:
            raced.append(two.merge(spark.createDataFrame([("a", 5), ("c", 1)], schema)))
        return create(manifest)

    monkeypatch.setattr(one, "_create", slow)
    one.merge(spark.createDataFrame([("a", 3), ("b", 3)], schema))
    assert rows_of(one.read()) == [("a", 5), ("b", 3), ("c", 1)] and two.versions() == [1, 2]
    monkeypatch.setattr(one, "_create", lambda manifest: False)
    with pytest.raises(ConcurrentWriters):
        one.merge(spark.createDataFrame([("z", 1)], schema), attempts=2)
    assert two.read().where("k = 'z'").count() == 0


def test_a_crash_before_the_commit_changes_nothing(spark, monkeypatch):
    t = CompactedTable(spark, scratch_path(spark, "t-compacted"), ["k"], buckets=2)
    schema = "k string, ingested_at long"
    t.merge(spark.createDataFrame([("a", 1)], schema))

    def crash(manifest):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(t, "_create", crash)
        with pytest.raises(RuntimeError):
            t.merge(spark.createDataFrame([("a", 2), ("b", 1)], schema))
    assert rows_of(t.read()) == [("a", 1)]
    t.merge(spark.createDataFrame([("a", 2), ("b", 1)], schema))
    assert rows_of(t.read()) == [("a", 2), ("b", 1)]


def test_readers_see_whole_versions_while_writers_merge(spark):
    """Every version holds all keys at one time; a reader must never meet two times."""
    path, schema = scratch_path(spark, "t-compacted"), "k string, ingested_at long"
    t = CompactedTable(spark, path, ["k"], buckets=4)
    t.merge(spark.createDataFrame([(f"k{i}", 0) for i in range(20)], schema))
    seen, stop = [], threading.Event()

    def reader():
        mine = CompactedTable(spark, path, ["k"])
        while not stop.is_set():
            seen.append({(r.ingested_at, r["count"]) for r in mine.read().groupBy("ingested_at").count().collect()})

    thread = threading.Thread(target=reader)
    thread.start()
    for at in (1, 2, 3):
        t.merge(spark.createDataFrame([(f"k{i}", at) for i in range(20)], schema))
    stop.set()
    thread.join()
    assert seen and all(len(s) == 1 and next(iter(s))[1] == 20 for s in seen)
