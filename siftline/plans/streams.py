"""Streaming jobs run to completion over the events table; results are read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.plans.registry import query
from siftline.session import scratch_path
from siftline.streaming import status, streams


def _feed(spark, t):
    """The events table as a stream, with a zoned timestamp for watermarks."""
    # As a pattern the path may be one file or a folder of files.
    raw = streams.read_feed(spark, t.path("events") + "*", t.events.schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query("stream_windows", """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s, event_type, count(*) AS samples, max(value) AS peak, min(value) AS low FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, samples, peak, low FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_windows(spark, t):
    out = streams.stream_windows(_feed(spark, t), "ts", ["event_type"], "6 hours", {"samples": F.count(F.lit(1)), "peak": F.max("value"), "low": F.min("value")})
    path = scratch_path(spark, "windows")
    streams.run_available(out, path)
    rows = streams.read_rows(spark, path, out.schema)
    return rows.select(_text("window_start").alias("window_start"), "event_type", "samples", "peak", "low")


@query("stream_event_counts", """
WITH x AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS s, event_type, value FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS kind, count(*) AS events FROM x WHERE event_type <> 'signup' AND value <= 200 AND s + INTERVAL 1 DAY <= (SELECT date_trunc('second', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE event_type <> 'signup' AND value <= 200) GROUP BY 1, 2
UNION ALL SELECT 'rejected', CASE WHEN event_type = 'signup' AND value > 200 THEN 'kind_enum;value_range' WHEN event_type = 'signup' THEN 'kind_enum' ELSE 'value_range' END, count(*) FROM x WHERE event_type = 'signup' OR value > 200 GROUP BY 1, 2""")
def stream_event_counts(spark, t):
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "value"))
    lines = _feed(spark, t).select(payload.alias("line"))
    rules = {"kind_enum": F.col("kind").isin("view", "click", "purchase", "error"), "value_range": F.col("value") <= 200}
    counts, rejects = streams.stream_event_counts(
        lines, "line", "id BIGINT, kind STRING, at STRING, value DOUBLE", rules, ["id", "kind", "at", "value"], F.to_timestamp("at"), "kind", "1 day")
    a, b = scratch_path(spark, "counts"), scratch_path(spark, "rejects")
    streams.run_available(counts, a)
    streams.run_available(rejects, b)
    good = streams.read_rows(spark, a, counts.schema).select(_text("window_start").alias("window_start"), "kind", "events")
    bad = streams.read_rows(spark, b, rejects.schema).groupBy("reasons").agg(F.count(F.lit(1)).alias("events"))
    return good.unionAll(bad.select(F.lit("rejected"), "reasons", "events"))


@query("stream_dedupe", "SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, t):
    out = streams.stream_dedupe(_feed(spark, t), "user_id", "ts", "60 days")
    path = scratch_path(spark, "dedupe")
    streams.run_available(out, path)
    return streams.read_rows(spark, path, out.schema).select("user_id")


@query("stream_dedupe_exact", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_dedupe_exact(spark, t):
    src = _feed(spark, t).select("user_id", "event_id")
    path = scratch_path(spark, "registry")
    streams.run_available(src, path, "append", streams.exact_dedupe(path, "user_id", ["event_id"]))
    return streams.read_rows(spark, path, src.schema)


@query("stream_status", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS facts FROM events GROUP BY 1""")
def stream_status(spark, t):
    out = streams.stream_status(_feed(spark, t), ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    path = scratch_path(spark, "status")
    streams.run_available(out, path, "update")
    return streams.latest_changes(spark, path, out.schema, ["user_id"])


@query("stream_peak_gate", """
WITH e AS (SELECT user_id, value, 200.0::DOUBLE + event_id % 7 - CASE WHEN event_id % 97 = 0 THEN 1000 ELSE 0 END AS total FROM events)
SELECT user_id, round(max(value) / min(total) FILTER (total > 0), 6) AS peak_fraction, count(*) FILTER (total <= 0) AS bad_totals FROM e GROUP BY 1 HAVING max(value) / min(total) FILTER (total > 0) > 0.9 OR count(*) FILTER (total <= 0) > 0""")
def stream_peak_gate(spark, t):
    src = _feed(spark, t).select("user_id", "value", (F.lit(200.0) + F.col("event_id") % 7 - F.when(F.col("event_id") % 97 == 0, 1000).otherwise(0)).alias("total"))
    out = streams.stream_peak_gate(src, ["user_id"], "value", "total")
    path = scratch_path(spark, "gate")
    streams.run_available(out, path, "update")
    return streams.latest_changes(spark, path, out.schema, ["user_id"]).withColumn("peak_fraction", F.round("peak_fraction", 6))


@query("stream_acceptance", """
WITH x AS (SELECT user_id, sum((event_type = 'purchase')::INT) OVER w AS acc, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, min(n) AS stopped_at FROM x WHERE n >= 20 AND acc / n < 0.2 GROUP BY 1""")
def stream_acceptance(spark, t):
    src = _feed(spark, t).select("user_id", "event_id", (F.col("event_type") == "purchase").alias("accepted"))
    path = scratch_path(spark, "acceptance")
    streams.run_available(src, path, "append", streams.acceptance_monitor(path, ["user_id"], ["event_id"], "accepted", 20, 0.2))
    schema = T.StructType([t.events.schema["user_id"], T.StructField("stopped_at", T.LongType())])
    return streams.read_rows(spark, path, schema)


@query("stream_current", """
WITH e AS (SELECT event_id, event_id % 61 AS line, event_type, value, ts, CASE event_type WHEN 'error' THEN event_id - 61 WHEN 'signup' THEN event_id + 61 END AS supersedes FROM events)
SELECT line, event_id, event_type, value FROM e WHERE event_id NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY line ORDER BY ts DESC, event_id DESC) = 1""")
def stream_current(spark, t):
    sup = F.when(F.col("event_type") == "error", F.col("event_id") - 61).when(F.col("event_type") == "signup", F.col("event_id") + 61)
    src = _feed(spark, t).select("event_id", (F.col("event_id") % 61).alias("line"), "event_type", "value", "ts", sup.alias("supersedes"))
    out = status.stream_current(src, ["line"], "event_id", "supersedes", "ts", ["event_type", "value"], "60 days", 90 * 86400, 365 * 86400)
    path = scratch_path(spark, "current")
    streams.run_available(out, path, "update", conf=dict([status.STATE_STORE]))
    return streams.latest_changes(spark, path, out.schema, ["line"]).filter("event_id IS NOT NULL").select("line", "event_id", "event_type", "value")
