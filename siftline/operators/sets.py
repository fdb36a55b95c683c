"""Set operations over tables, stages and snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def stage_sets(df: DataFrame, id_col: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """Ids not seen in every stage, with the stages they miss."""
    seen = df.filter(F.col(stage).isin(*stages)).groupBy(id_col).agg(
        *[F.max((F.col(stage) == s).cast("int")).alias(f"_s{i}") for i, s in enumerate(stages)]
    )
    absent = F.array_compact(F.array(*[F.when(F.col(f"_s{i}") == 0, F.lit(s)) for i, s in enumerate(stages)]))
    return seen.select(id_col, F.array_join(absent, ";").alias("missing_stages")).filter(F.col("missing_stages") != "")


def not_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks; empty means subset."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both; empty means disjoint."""
    return a.select(key).intersect(b.select(key))


def two_sided_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, labelled ``missing`` (not in b) or ``extra`` (not in a)."""
    marks = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(key, F.lit(0), F.lit(1)))
    # One aggregation finds both differences; the flags merge before the shuffle.
    sides = marks.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).filter(F.col("_a") != F.col("_b"))
    return sides.select(key, F.when(F.col("_a") == 1, "missing").otherwise("extra").alias("side"))


def snapshot_delta(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "sha256", size: str = "bytes") -> DataFrame:
    """Created, modified and removed paths with the bytes now stored."""
    old = before.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_had"))
    new = after.select(F.col(key), F.col(digest).alias("_new"), F.col(size).alias("_size"), F.lit(True).alias("_has"))
    both = old.join(new, key, "full_outer")
    change = (
        F.when(F.col("_had").isNull(), "created").when(F.col("_has").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return both.select(key, change.alias("change"), F.coalesce("_size", F.lit(0)).cast("long").alias("changed_bytes")).filter(
        F.col("change").isNotNull()
    )


def unchanged(before: DataFrame, after: DataFrame, **names) -> DataFrame:
    """One row: number of changes and whether the tree stayed the same."""
    return snapshot_delta(before, after, **names).agg(F.count(F.lit(1)).alias("changes")).withColumn(
        "unchanged", F.col("changes") == 0
    )


def distinct_ordered(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct rows in a stated order."""
    return df.select(*cols).distinct().orderBy(*order)
