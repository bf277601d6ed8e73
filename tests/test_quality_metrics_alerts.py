import datetime as dt

import pytest
import json

from pyspark.sql import functions as F

from basketflow.operators import alerts, mart, metrics, quality

AS_OF = "2025-07-10 12:00:00"


def _store_msgs(spark, docs):
    return spark.createDataFrame([(json.dumps(d), "2025-07-01 00:00:00") for d in docs],
                                 "payload string, ingested_at string").withColumn("ingested_at",
                                                                                  F.col("ingested_at").cast("timestamp"))


def test_quality_counters(spark):
    good = {"store_id": "store-001", "store_network": "n", "location": {"city": "c"}}
    bad = {"store_id": "store-1", "store_network": "n", "location": {"city": "c"}}
    blank = {"store_id": "", "store_network": "n", "location": {"city": "c"}}
    msgs = _store_msgs(spark, [good, good, bad, bad, blank, blank])
    r = quality.quality("stores", mart.store_fields(msgs), AS_OF).first()
    assert (r["total_rows_raw"], r["inserted_rows_mart"], r["invalid_rows"], r["duplicates_rows"]) == (6, 2, 4, 3)
    assert abs(r["duplicates_ratio"] - 0.5) < 1e-12


def test_quality_empty_table(spark):
    empty = _store_msgs(spark, []).limit(0)
    r = quality.quality("stores", mart.store_fields(empty), AS_OF).first()
    assert r["total_rows_raw"] == 0 and r["duplicates_ratio"] == 0.0


def _purchases(spark, rows):
    return spark.createDataFrame(rows, "payment_method string, purchase_dt timestamp")


def test_payments_buckets_and_fallback(spark):
    t = dt.datetime(2025, 7, 9)
    p = _purchases(spark, [("card", t), ("Cash ", t), ("online_wallet", t), ("other", t), ("sbp", t)])
    got = {r["method"]: (r["count"], r["share"]) for r in metrics.payments_breakdown(p, AS_OF, 7).collect()}
    assert got == {"sbp": (3, 0.6), "card": (1, 0.2), "cash": (1, 0.2)}
    old = _purchases(spark, [("card", dt.datetime(2020, 1, 1)), ("cash", dt.datetime(2020, 1, 1))])
    got = {r["method"]: r["count"] for r in metrics.payments_breakdown(old, AS_OF, 7).collect()}
    assert got == {"card": 1, "cash": 1}       # empty window → all time


def test_alert_threshold_and_cooldown(spark):
    now = dt.datetime(2025, 7, 10, 12, 0)
    latest = spark.createDataFrame([("at", 0.5), ("above", 0.51), ("cool", 0.9), ("warm", 0.9)],
                                   "entity string, duplicates_ratio double")
    ev = spark.createDataFrame(
        [("duplicates_ratio_threshold", "cool", now - dt.timedelta(minutes=14)),
         ("duplicates_ratio_threshold", "warm", now - dt.timedelta(minutes=16))],
        "rule_name string, entity string, created_at timestamp")
    out = alerts.dispatch(latest, ev, "2025-07-10 12:00:00", threshold=0.5, cooldown=15)
    assert sorted(r["entity"] for r in out.collect()) == ["above", "warm"]


def test_alert_replay_restarts_cooldown(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("e", t0 + dt.timedelta(minutes=m), r) for m, r in
            [(0, 0.9), (10, 0.9), (16, 0.9), (20, 0.1), (40, 0.9)]]
    log = spark.createDataFrame(rows, "entity string, event_time timestamp, duplicates_ratio double")
    fired = [r["fired"] for r in alerts.replay(log, 0.5, 15).orderBy("event_time").collect()]
    assert fired == [1, 0, 1, 0, 1]


def test_latest_by_entity_order(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(t, e, 10, 9, 1, 1, 0.1) for e in ("stores", "purchase_items", "purchases")]
    log = spark.createDataFrame(rows, "event_time timestamp, entity string, total_rows_raw long, "
                                      "inserted_rows_mart long, invalid_rows long, duplicates_rows long, "
                                      "duplicates_ratio double")
    assert [r["entity"] for r in quality.latest_by_entity(log).collect()] == ["Purchases", "Stores", "Purchase_items"]


def test_alert_stream_keeps_cooldown_across_batches(spark):
    from basketflow.session import scratch_path
    from basketflow.streaming import alerts as sa, ingest

    t0 = dt.datetime(2025, 1, 1)
    src = scratch_path(spark, "t-alert-src")
    batches = [[(0, 0.9), (10, 0.9)], [(20, 0.9), (40, 0.1)], [(50, 0.9)]]
    for b in batches:
        spark.createDataFrame([("e", t0 + dt.timedelta(minutes=m), r) for m, r in b],
                              "entity string, event_time timestamp, duplicates_ratio double") \
            .coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("entity string, event_time timestamp, duplicates_ratio double") \
        .option("maxFilesPerTrigger", "1").parquet(src)
    out, ck = scratch_path(spark, "t-alert-out"), scratch_path(spark, "t-alert-ck")
    q = sa.alert_stream(stream, 0.5, 15).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    ingest.run_available(q)
    fired = [r["fired"] for r in spark.read.parquet(out).orderBy("event_time").collect()]
    assert fired == [1, 0, 1, 0, 1]     # minute 20 is 20 > 15 after the fire at 0; 50 is 30 after 20


def _brute_replay(rows, threshold, minutes):
    fired, last = [], {}
    for e, t, r in sorted(rows, key=lambda x: (x[0], x[1])):
        hit = r is not None and r > threshold and (e not in last or t == last[e] or t - last[e] > dt.timedelta(minutes=minutes))
        if hit:
            last[e] = t
        fired.append((e, t, r, int(hit)))
    return sorted(fired, key=str)


@pytest.mark.parametrize("n,entities,days,minutes", [(400, 3, 900, 60), (300, 1, 2000, 60 * 24 * 40), (150, 2, 1, 1)])
def test_alert_replay_follows_chains_over_days(spark, n, entities, days, minutes):
    import random
    rng = random.Random(n)
    rows = [(f"e{rng.randrange(entities)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(days * 86400) // 60 * 60), rng.choice([0.1, 0.6, 0.9, None])) for _ in range(n)]
    schema = "entity string, event_time timestamp, duplicates_ratio double"
    got = alerts.replay(spark.createDataFrame(rows, schema), 0.5, minutes).collect()
    assert sorted(map(tuple, got), key=str) == _brute_replay(rows, 0.5, minutes)
    odd = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), 0.9), ("z", None, 0.9)], schema)
    assert [r.fired for r in alerts.replay(odd, 0.5, minutes).collect()] == [0, 0]
    assert alerts.replay(odd.limit(0), 0.5, minutes).count() == 0


def test_alert_stream_late_equals_the_replay_after_restarts(spark):
    import random
    from basketflow.session import scratch_path
    from basketflow.streaming import alerts as sa, ingest
    rng, t0, schema = random.Random(8), dt.datetime(2025, 1, 1), "entity string, event_time timestamp, duplicates_ratio double"
    rows = [(f"e{m % 2}", t0 + dt.timedelta(minutes=m), rng.choice([0.1, 0.9])) for m in range(0, 240, 3)]
    src, out, ck = (scratch_path(spark, f"t-late-{x}") for x in ("src", "out", "ck"))
    # up to half an hour out of order, over several runs of the query; then one that is far too late, then the clock
    jumbled = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 25)))
    late = ("e0", t0 - dt.timedelta(days=1), 0.95)
    clock = (sa.CLOCK, t0 + dt.timedelta(days=2), None)
    for batch in (jumbled[:25], jumbled[25:60], jumbled[60:], [clock], [late], [(sa.CLOCK, t0 + dt.timedelta(days=3), None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.run_available(sa.alert_stream_late(stream, "30 minutes", 0.5, 15).writeStream.format("parquet").outputMode("append")
                             .option("checkpointLocation", ck).trigger(availableNow=True).start(out))
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == _brute_replay(rows, 0.5, 15)


def test_kept_counters_equal_the_recount(spark):
    from basketflow.session import scratch_path
    from basketflow.streaming import ingest, quality as sq
    as_of = "2001-08-03"
    src, out, ck = (scratch_path(spark, f"t-kept-{x}") for x in ("src", "out", "ck"))
    schema = "store_id string, store_network string, store_name string, city string, payload string, ingested_at timestamp"
    t = dt.datetime(2000, 1, 1)
    rows = [(f"store-{i % 7:03d}" if i % 5 else "bad", "net", f"n{i}", "c", "{}", t) for i in range(40)] + [(None, None, None, None, None, t)]
    for part in (rows[:15], rows[15:], []):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        for q in sq.count_stream("stores", spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(src), out, ck, as_of):
            ingest.run_available(q)
    got = sq.kept_snapshot(spark, out, as_of).collect()
    want = quality.quality("stores", spark.createDataFrame(rows, schema), as_of).collect()
    assert got == want and want[0]["total_rows_raw"] == 41
    # a batch that is replayed takes its own place again
    again = sq._counted(out, "rows", "stores", F.count(F.lit(1)).alias("total"), F.lit(0).cast("long").alias("valid"))
    again(spark.createDataFrame(rows[:3], schema), 99)
    again(spark.createDataFrame(rows[:3], schema), 99)
    assert sq.kept_snapshot(spark, out, as_of).first()["total_rows_raw"] == 44
