"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "siftline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on (AQE, skew joins, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach; a local folder only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; nothing is ever written over."""
    return f"{_shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write once, read back: later passes see the same rows and can prune columns."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop state, written and read back.

    A checkpoint would keep the plan's estimated size, in a loop with joins a number whose digits
    double each round; a file has its own.
    """
    return stage_table(df, "cut")


class LoopState:
    """A loop state written and read back like ``cut``, in two places by turns: the state before the last is written over.

    Each state may depend on the one before it and on nothing older; the last one stays.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.path, self.turn = scratch_path(spark, tag), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.turn % 2}"
        self.turn += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows, names) -> DataFrame:
    """A small table of constants made inside the plan, without a Python worker."""
    cells = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*cells)))
