"""Streaming jobs over several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from siftline.session import scratch_path
from siftline.streaming import status, streams

SCHEMA = "id int, k string, ts timestamp, v double, ok boolean"


def feed(spark, batches):
    """A folder with one file per batch, read one file at a time in this order."""
    path = scratch_path(spark, "feed")
    for i, rows in enumerate(batches):
        data = [(r[0], r[1], dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=r[2]), float(r[3]), r[4]) for r in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return streams.read_feed(spark, path, SCHEMA, files_per_batch=1)


def test_windows_drop_and_count_late_rows(spark, rows):
    src = feed(spark, [[(1, "a", 0, 1, True), (2, "a", 5, 3, True)], [(3, "a", 60, 9, True)], [(6, "a", 62, 1, True)], [(4, "a", 1, 99, True), (5, "a", 61, 2, True)]])
    out = streams.stream_windows(src, "ts", ["k"], "10 minutes", {"n": F.count(F.lit(1)), "peak": F.max("v")}, "10 minutes")
    path = scratch_path(spark, "w")
    dropped = streams.run_available(out, path)
    assert rows(streams.read_rows(spark, path, out.schema), "n", "peak") == [(2, 3.0)] and dropped == 1


def test_exact_dedupe_never_forgets(spark, rows):
    src = feed(spark, [[(1, "a", 0, 1, True), (2, "a", 1, 1, True)], [(3, "b", 2, 1, True)], [(4, "a", 900, 1, True), (5, "c", 901, 1, True)]]).select("k", "id")
    path = scratch_path(spark, "d")
    streams.run_available(src, path, "append", streams.exact_dedupe(path, "k", ["id"]))
    assert rows(streams.read_rows(spark, path, src.schema)) == [("a", 1), ("b", 3), ("c", 5)]


def test_bounded_dedupe(spark):
    src = feed(spark, [[(1, "a", 0, 1, True)], [(2, "a", 1, 1, True), (3, "b", 2, 1, True)]])
    out = streams.stream_dedupe(src, "k", "ts", "1 hour")
    path = scratch_path(spark, "bd")
    streams.run_available(out, path)
    assert streams.read_rows(spark, path, out.schema).count() == 2


def test_status_and_gate(spark, rows):
    src = feed(spark, [[(1, "a", 0, 1, True), (2, "b", 1, 5, True)], [(3, "a", 2, 95, False)]])
    out = streams.stream_status(src, ["k"], ["ts", "id"], ["id", "v"])
    path = scratch_path(spark, "s")
    streams.run_available(out, path, "update")
    assert rows(streams.latest_changes(spark, path, out.schema, ["k"])) == [("a", 3, 95.0, 2), ("b", 2, 5.0, 1)]
    gate = streams.stream_peak_gate(src.withColumn("t", F.lit(100.0)), ["k"], "v", "t")
    path = scratch_path(spark, "g")
    streams.run_available(gate, path, "update")
    assert rows(streams.latest_changes(spark, path, gate.schema, ["k"])) == [("a", 0.95, 0)]
    broken = streams.stream_peak_gate(src.withColumn("t", F.when(F.col("id") == 2, -1.0).otherwise(1000.0)), ["k"], "v", "t")
    path = scratch_path(spark, "g")
    streams.run_available(broken, path, "update")
    assert rows(streams.latest_changes(spark, path, broken.schema, ["k"])) == [("b", None, 1)]


def test_acceptance_carries_over_batches(spark, rows):
    ok = [(1, "a", 0, 0, True), (2, "a", 1, 0, False)], [(3, "a", 2, 0, False), (4, "b", 3, 0, True)], [(5, "a", 4, 0, False), (6, "a", 5, 0, False), (7, "b", 6, 0, True)]
    src = feed(spark, ok).select("k", "id", "ok")
    path = scratch_path(spark, "acc")
    streams.run_available(src, path, "append", streams.acceptance_monitor(path, ["k"], ["id"], "ok", 3, 0.3))
    got = spark.read.parquet(f"{path}/rows").select("k", "stopped_at")
    assert rows(got) == [("a", 4)]  # 1/3 is above the limit, 1/4 is not
    last = spark.read.parquet(f"{path}/totals").filter("batch = 2").select("k", "seen", "taken")
    assert rows(last) == [("a", 5, 1), ("b", 2, 2)]


def test_event_counts_and_rejects(spark, rows):
    src = feed(spark, [[(1, "a", 0, 1, True), (2, "zz", 1, 1, True)], [(3, "a", 600, 1, True)]])
    lines = src.select(F.to_json(F.struct("id", "k", F.col("ts").cast("string").alias("at"))).alias("line"))
    counts, rejects = streams.stream_event_counts(lines, "line", "id INT, k STRING, at STRING", {"kind": F.col("k").isin("a")}, ["id", "k", "at"], F.to_timestamp("at"), "k", "1 hour")
    a, b = scratch_path(spark, "c"), scratch_path(spark, "r")
    streams.run_available(counts, a)
    streams.run_available(rejects, b)
    assert rows(streams.read_rows(spark, a, counts.schema), "k", "events") == [("a", 1)]
    assert rows(streams.read_rows(spark, b, rejects.schema), "reasons") == [("kind",)]


FACTS = "id long, k string, minute int, supersedes long, v double"


def fact_feed(spark, batches):
    path = scratch_path(spark, "facts")
    for rows in batches:
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(path)
    src = streams.read_feed(spark, path, FACTS, files_per_batch=1)
    return src.withColumn("ts", F.timestamp_seconds(F.lit(1767225600) + 60 * F.col("minute")))


def run_current(spark, batches, horizon, ttl, delay="1 hour"):
    out = status.stream_current(fact_feed(spark, batches), ["k"], "id", "supersedes", "ts", ["v"], delay, horizon, ttl)
    path = scratch_path(spark, "current")
    streams.run_available(out, path, "update", conf=dict([status.STATE_STORE]))
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{path}/_progress")
    return streams.latest_changes(spark, path, out.schema, ["k"]), held


def test_current_facts_out_of_order(spark, rows):
    big = 2**60 + 1
    batches = [
        [(1, "a", 0, None, 1.0), (2, "a", 5, None, 2.0), (10, "b", 1, 11, 3.0), (20, "c", 1, None, 4.0)],
        [(3, "a", 1, 2, 5.0), (11, "b", 9, None, 6.0), (21, "c", 2, 20, 7.0)],  # 11 was superseded before it came
        [(2, "a", 5, None, 2.0), (22, "c", 1, 21, 8.0), (big, "d", 3, None, 9.0), (None, "d", 9, None, 0.0)],  # 2 is sent again
        [(4, "a", 0, 3, 1.5), (23, "c", 3, 22, 9.5), (24, "c", 2, 23, 0.5), (25, "c", 0, 24, 0.1), (26, "c", 0, 25, 0.2), (big + 1, "d", 2, big, 0.7)],
    ]
    got, held = run_current(spark, batches, 86400, 86400)
    facts = [r for b in batches for r in b if r[0] is not None]
    gone = {(r[1], r[3]) for r in facts if r[3] is not None}
    want = {}
    for r in facts:
        if (r[1], r[0]) not in gone and (r[1] not in want or (r[2], r[0]) > (want[r[1]][2], want[r[1]][0])):
            want[r[1]] = r
    assert rows(got, "k", "id", "v") == sorted((k, r[0], r[4]) for k, r in want.items())
    assert held("superseded").count() == len(gone)


def test_current_facts_none_left_and_expiry(spark, rows):
    batches = [
        [(1, "a", 0, None, 1.0), (2, "b", 0, None, 2.0), (3, "b", 1, 99, 2.5)],
        [(4, "a", 1, 4, 1.0), (5, "a", 2, 1, 1.0), (6, "a", 3, 5, 1.0), (7, "a", 3, 6, 1.0), (8, "a", 3, 7, 1.0), (9, "a", 3, 8, 1.0), (9, "a", 3, 9, 1.0)],
        [(30, "z", 600, None, 0.0)],
        [(31, "z", 1200, None, 0.5)],
        [(32, "z", 1201, None, 0.7)],
    ]
    got, held = run_current(spark, batches, 3600, 7200)
    assert rows(got, "k", "id", "v") == [("a", None, None), ("b", 3, 2.5), ("z", 32, 0.7)]
    # a and b, their earlier facts and superseded ids have expired; of z only what is within the horizon is left.
    assert held("current").count() == 1 and held("superseded").count() == 0 and held("earlier").count() <= 1
