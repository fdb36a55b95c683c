"""Streams over append-only feeds: windows, counts, duplicates, status, gates, acceptance.

Every job takes a streaming DataFrame. Aggregating jobs use Spark's own state, so a hot key is
combined before it is shuffled. Jobs that need an order or a registry run per micro-batch and keep
their carry in tables versioned by batch id: a batch that is run again writes the same version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.checks import validate_events
from siftline.operators.ranking import best_per_key
from siftline.operators.summary import acceptance_rate


ALL_PROGRESS = 1_000_000
REGISTRY_BUCKETS = 256


def read_feed(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """File feed under an explicit schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
                  conf: dict[str, str] | None = None) -> int:
    """Process everything available, then stop; returns rows dropped as late.

    ``conf``: session settings that hold while the stream runs, such as its state store.

    Append mode writes parquet rows. Update mode writes each batch of changed rows under its batch
    id; ``latest_changes`` reads the current view.
    """
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_progress").outputMode(mode)
    if each is None and mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/rows")
    else:
        def save(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

        writer = writer.foreachBatch(each or save)
    session = stream.sparkSession.conf
    settings = {"spark.sql.streaming.numRecentProgressUpdates": str(ALL_PROGRESS), **(conf or {})}  # else only the last 100 batches are counted
    before = {k: session.get(k) for k in settings}
    for k, v in settings.items():
        session.set(k, v)
    try:
        running = writer.start()
        running.awaitTermination()
    finally:
        for k, v in before.items():
            session.set(k, v)
    dropped = 0
    for progress in running.recentProgress:
        dropped += sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in progress["stateOperators"])
    return dropped


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows written by ``run_available``; the stated schema also covers an empty result."""
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*[f.name for f in schema.fields])


def latest_changes(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """Current view of update-mode output: the newest change of each key."""
    changes = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return best_per_key(changes, keys, [F.col("batch").desc()]).select(*[f.name for f in schema.fields])


def stream_windows(src: DataFrame, time: str, keys: Sequence[str], width: str, metrics: dict[str, Column], delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows with peaks and minima per key; a window is final once the watermark passes it (ST1)."""
    at = F.col(time).cast("timestamp")
    timed = src.withColumn(time, at).withWatermark(time, delay)
    out = timed.groupBy(F.window(time, width), *keys).agg(*[m.alias(k) for k, m in metrics.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *metrics)


def stream_event_counts(src: DataFrame, text: str, schema: str, rules: dict[str, Column], keys: Sequence[str], time: Column, kind: str, width: str,
                        delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Valid events counted per type and window, and the rejected lines with reasons (ST2)."""
    good, rejects = validate_events(src, text, schema, rules, keys)
    counts = stream_windows(good.withColumn("_time", time), "_time", [kind], width, {"events": F.count(F.lit(1))}, delay)
    return counts, rejects


def stream_dedupe(src: DataFrame, id_col: str, time: str, delay: str) -> DataFrame:
    """First row per id; ids are forgotten once the watermark passes them (ST3, bounded)."""
    timed = src.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark([id_col])


def exact_dedupe(path: str, id_col: str, order: Sequence) -> Callable[[DataFrame, int], None]:
    """Per batch: the first row of every id no earlier batch holds (ST3, exact).

    The registry is the output of all earlier batches, so no id is ever forgotten. It is kept in
    buckets by a hash of the id; a batch reads only the buckets of its own ids.
    """
    def each(df: DataFrame, batch: int) -> None:
        first = best_per_key(df, [id_col], order).withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(REGISTRY_BUCKETS)).cast("int"))
        if batch > 0:
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # REGISTRY_BUCKETS numbers at most
            known = df.sparkSession.read.schema(first.select(id_col, "bucket", F.lit(0).alias("batch")).schema).parquet(f"{path}/rows").filter((F.col("batch") < batch) & F.col("bucket").isin(touched)).select(id_col)
            first = first.join(known, id_col, "left_anti")
        first.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch}")

    return each


def stream_status(src: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Latest fact per key as a running aggregate; corrections are later facts (ST4)."""
    return src.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_fact"), F.count(F.lit(1)).alias("facts")).select(*key, "_fact.*", "facts")


def stream_peak_gate(src: DataFrame, by: Sequence[str], used: str, total: str, limit: float = 0.90) -> DataFrame:
    """Runs whose largest use over smallest total exceeds the limit, or that have a total not above 0 (ST5)."""
    peak = F.try_divide(F.max(used), F.min(F.when(F.col(total) > 0, F.col(total))))
    bad = F.count_if(F.coalesce(F.col(total) <= 0, F.lit(True)))
    return src.groupBy(*by).agg(peak.alias("peak_fraction"), bad.alias("bad_totals")).filter((F.col("peak_fraction") > limit) | (F.col("bad_totals") > 0))


def acceptance_monitor(path: str, by: Sequence[str], order: Sequence[str], accepted: str, warmup: int, limit: float) -> Callable[[DataFrame, int], None]:
    """Per batch: running acceptance per campaign over all batches; one alert when it falls short (ST6).

    Rows inside a batch are ordered by ``order``; totals of earlier batches are carried per campaign.
    """
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.select(*by, *order, accepted)
        rows = acceptance_rate(df, by, order, accepted, 0, -1.0).select(*by, "seen_so_far", "accepted_so_far")
        last = None
        if batch > 0:
            totals = spark.read.parquet(f"{path}/totals").filter(F.col("batch") < batch)
            last = totals.agg(F.max("batch")).first()[0]
        if last is not None:
            old = totals.filter(F.col("batch") == last).drop("batch")
        else:
            old = spark.createDataFrame([], df.select(*by).schema).selectExpr("*", "0L AS seen", "0L AS taken", "CAST(NULL AS BIGINT) AS stopped_at")
        carried = rows.join(old, list(by), "left")
        seen = F.col("seen_so_far") + F.coalesce("seen", F.lit(0))
        taken = F.col("accepted_so_far") + F.coalesce("taken", F.lit(0))
        new_stop = F.min(F.when(F.col("stopped_at").isNull() & (seen >= warmup) & (taken / seen < limit), seen))
        now = carried.groupBy(*by).agg(F.max(seen).alias("seen_now"), F.max(taken).alias("taken_now"), new_stop.alias("new_stop"))
        both = old.join(now, list(by), "full_outer")
        both.select(
            *by, F.coalesce("seen_now", "seen").alias("seen"), F.coalesce("taken_now", "taken").alias("taken"),
            F.coalesce("stopped_at", "new_stop").alias("stopped_at"),
        ).write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")
        now.filter("new_stop IS NOT NULL").select(*by, F.col("new_stop").alias("stopped_at")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    return each
