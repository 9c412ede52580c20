"""Life-cycle events and episodes against a plain fold; the stream against the batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronolith.operators import lifecycle, pit
from chronolith.streaming.lifecycle import by_scan, fold, lifecycle_stream, once

T0 = datetime(2024, 1, 1)


def naive(rows):
    out, known, first, negatives, closed = [], False, None, 0, False
    for moment, present in rows:
        if present:
            out.append((moment, "STILL_ACTIVE" if known else "NEW"))
            known, first, negatives, closed = True, None, 0, False
        elif known and not closed:
            first = first or moment
            closed = negatives >= 1 and (moment - first).total_seconds() >= 48 * 3600
            negatives += 1
            out.append((moment, "CLOSED_OBSERVED" if closed else "DISAPPEARED_PENDING"))
    return out


def histories():
    chance = random.Random(4)
    for key in range(60):
        hours = sorted(chance.sample(range(800), chance.randint(1, 30)))
        yield str(key), [(T0 + timedelta(hours=h), chance.random() < 0.35) for h in hours]
    yield "a", [(T0, True), (T0 + timedelta(days=1), False), (T0 + timedelta(days=2), False), (T0 + timedelta(days=3), False), (T0 + timedelta(days=4), True)]
    yield "b", [(T0, True), (T0 + timedelta(hours=1), False), (T0 + timedelta(hours=49), False)]
    yield "c", [(T0, False)]


def test_batch_and_fold_equal_the_naive_fold(spark):
    want = {k: naive(rows) for k, rows in histories()}
    assert {k: fold(rows, None)[0] for k, rows in histories()} == want
    flat = [(k, i, m, p) for k, rows in histories() for i, (m, p) in enumerate(rows)]
    random.Random(1).shuffle(flat)
    rows = spark.createDataFrame(flat, "key string, id int, ts timestamp, present boolean")
    events = lifecycle.lifecycle_events(rows, ["key"], "ts", "present", "id")
    got = {k: [] for k in want}
    for r in events.orderBy("key", "ts").collect():
        got[r.key].append((r.ts, r.lifecycle_event))
    assert got == want
    told = lifecycle.episodes(events, ["key"], [F.col("ts"), F.col("id")]).groupBy("key").agg(F.max("episode").alias("n"))
    for r in told.collect():
        n, closed = 1, False
        for _, kind in want[r.key]:
            n += closed and kind in ("NEW", "STILL_ACTIVE")
            closed = kind == "CLOSED_OBSERVED" or closed and kind == "DISAPPEARED_PENDING"
        assert r.n == n


def test_stream_equals_batch(spark, tmp_path):
    flat = [(k, m, p) for k, rows in histories() for m, p in rows]
    rows = spark.createDataFrame(flat, "key string, ts timestamp, present boolean").orderBy("ts")
    for day, part in enumerate([rows.where("ts < '2024-01-15'"), rows.where("ts >= '2024-01-15'")]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{day}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    query = lifecycle_stream(stream).writeStream.format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = sorted((k, m, e) for k, rows in histories() for m, e in naive(rows))
    assert sorted(tuple(r) for r in spark.table("life").collect()) == want


def test_presence_needs_full_healthy_scans(spark):
    day = lambda d: T0 + timedelta(days=d)
    scans = [("r0", "s", "TARGETED", "SUCCESS", "HEALTHY", day(0)), ("r1", "s", "FULL_SOURCE", "SUCCESS", "HEALTHY", day(1)), ("r2", "s", "FULL_SOURCE", "SUCCESS", "DEGRADED", day(2)), ("r3", "s", "FULL_SOURCE", "SUCCESS", "HEALTHY", day(3)), ("r4", "s", "TARGETED", "SUCCESS", "HEALTHY", day(4)), ("r5", "s", "FULL_SOURCE", "FAILED", "OUTAGE", day(5))]
    scans = spark.createDataFrame(scans, "run_id string, source_id string, run_scope string, status string, source_health_status string, observed_at timestamp")
    seen = spark.createDataFrame([("r0", "s", "p"), ("r4", "s", "p")], "run_id string, source_id string, source_posting_id string")
    rows = lifecycle.presence(scans, seen)
    events = lifecycle.lifecycle_events(rows, ["source_id", "source_posting_id"], "observed_at", "present", "run_id")
    assert [r.lifecycle_event for r in events.orderBy("observed_at").collect()] == ["NEW", "DISAPPEARED_PENDING", "CLOSED_OBSERVED", "STILL_ACTIVE"]


def test_later_rows_change_no_earlier_state(spark):
    rows = [(1, k, T0 + timedelta(days=k), "ACTIVE") for k in range(5)]
    frame = lambda n: spark.createDataFrame(rows[:n], "posting_id int, observation_id int, observed_at timestamp, observation_status string")
    none = spark.createDataFrame([], "posting_id int, event_id int, event_type string, observed_at timestamp, created_at timestamp")
    cutoff = F.lit("2024-01-03 00:00:00").cast("timestamp")
    a, b = (pit.posting_states(frame(n), none, cutoff).collect() for n in (3, 5))
    assert a == b and a[0].observation_id == 2 and a[0].lifecycle_state == "ACTIVE_OBSERVED"


def test_repeats_are_dropped_and_batches_told_apart(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(minutes=1)), ("b", T0)]
    for n, part in enumerate([rows, rows[:1]]):
        spark.createDataFrame(part, "event_key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema("event_key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    told = {}
    for _ in range(2):  # a second start finds nothing new
        by_scan(once(stream, "1 hour"), lambda batch, number: told.setdefault(number, sorted(r.event_key for r in batch.collect())), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(k for keys in told.values() for k in keys) == ["a", "b"] and len(told) >= 2
