"""Ranking, numbering and top-k inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.clean import padded_id
from siftline.operators.ordered import lagged, number_rows, sort_column


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in a total order.

    ``row_number() = 1`` becomes a group limit that runs before the shuffle, so a hot key sends
    one row per map task.
    """
    w = Window.partitionBy(*key).orderBy(*[sort_column(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def keep_last(df: DataFrame, key: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """Sort by score and keep the last row per key, i.e. the best score; ties by ``tie``."""
    return best_per_key(df, key, [F.col(score).desc_nulls_last(), *tie])


def latest_complete(df: DataFrame, task: Sequence[str], attempt: str, complete: Column) -> DataFrame:
    """Latest attempt per task whose status and stages are complete."""
    return best_per_key(df.filter(complete), task, [F.col(attempt).desc_nulls_last()])


def latest_attempt(df: DataFrame, task: Sequence[str], attempt: str) -> DataFrame:
    """Latest attempt per task, complete or not."""
    return best_per_key(df, task, [F.col(attempt).desc_nulls_last()])


def renumber(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "ordinal") -> DataFrame:
    """1..N in source order inside each group."""
    return number_rows(df, by, order, name)


def adjacent_checks(df: DataFrame, by: Sequence[str], seq: str, lo: float | None = None, hi: float | None = None,
                    distance=None, carry: Sequence[str] = ()) -> DataFrame:
    """Breaks between neighbours: numbering gaps and distances outside [lo, hi].

    ``distance`` builds the distance from a prefix-to-column function, so it may use the row and
    the row before it; without it only gaps are reported.
    """
    rows = lagged(df, by, [seq], [seq, *carry]).filter(F.col(f"prev_{seq}").isNotNull())
    gap = F.col(seq) != F.col(f"prev_{seq}") + 1
    kinds = [F.when(gap, F.struct(F.lit("gap").alias("kind"), F.lit(None).cast("double").alias("distance")))]
    if distance is not None:
        value = distance()
        broken = ~gap & ~F.coalesce(value.between(lo, hi), F.lit(False)) & value.isNotNull()
        kinds.append(F.when(broken, F.struct(F.lit("distance").alias("kind"), value.alias("distance"))))
    return rows.select(
        *by, F.col(f"prev_{seq}").alias("from_seq"), F.col(seq).alias("to_seq"),
        F.explode(F.array_compact(F.array(*kinds))).alias("_k"),
    ).select(*by, "from_seq", "to_seq", "_k.*")


def islands(df: DataFrame, by: Sequence[str], idx: str) -> DataFrame:
    """Maximal runs of consecutive integers per group, as start and end."""
    rows = number_rows(df.select(*by, idx).distinct(), by, [idx], "_no")
    return (
        rows.groupBy(*by, (F.col(idx) - F.col("_no")).alias("_island"))
        .agg(F.min(idx).alias("start"), F.max(idx).alias("end")).drop("_island")
    )


def compress_ranges(df: DataFrame, by: Sequence[str], idx: str, dots: str = "..", name: str = "ranges") -> DataFrame:
    """``1..3,7`` per group (W7). The text holds one entry per run, not per index."""
    runs = islands(df, by, idx)
    piece = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(
        F.concat(F.col("start").cast("string"), F.lit(dots), F.col("end").cast("string"))
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start"), piece.alias("piece"))))
    return runs.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda r: r["piece"]), ",").alias(name))


def contiguity(df: DataFrame, by: Sequence[str], rank: str, start: int = 1) -> DataFrame:
    """Per group: are the ranks exactly ``start .. start + N - 1``, each once (W8)?"""
    # Distinct (group, rank) pairs are counted in two steps, so a hot group is split by rank.
    pairs = df.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("_c"))
    stats = pairs.groupBy(*by).agg(
        F.sum("_c").alias("row_count"), F.count(rank).alias("distinct_ranks"),
        F.min(rank).alias("min_rank"), F.max(rank).alias("max_rank"),
    )
    ok = (
        (F.col("min_rank") == start) & (F.col("row_count") == F.col("distinct_ranks"))
        & (F.col("max_rank") == F.col("row_count") + start - 1)
    )
    return stats.withColumn("contiguous", F.coalesce(ok, F.lit(False)))


def monotonic(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per group: does ``value`` never rise in ``order`` (W9)?"""
    rows = lagged(df, by, order, [value])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum((F.col(value) > F.col(f"prev_{value}")).cast("long")), F.lit(0)).alias("rises"),
    ).withColumn("monotonic", F.col("rises") == 0)


def argmax_agreement(df: DataFrame, id_cols: Sequence[str], idx: str, score_a: Column, score_b: Column) -> DataFrame:
    """Best sample under two scores, lowest index on ties, and whether they agree."""
    # max_by on (score, -index) merges partial results, so no group is ever sorted whole.
    pick = lambda s: F.max_by(F.col(idx), F.struct(s, -F.col(idx)))
    return df.groupBy(*id_cols).agg(
        pick(score_a).alias("best_a"), pick(score_b).alias("best_b"),
        F.max(score_a).alias("score_a"), F.max(score_b).alias("score_b"),
    ).withColumn("same_best", F.col("best_a") == F.col("best_b"))


def best_or_ambiguous(df: DataFrame, by: Sequence[str], order: Sequence[Column], member: str) -> DataFrame:
    """Top-ranked member per group; several on the top rank make the group ambiguous."""
    w = Window.partitionBy(*by).orderBy(*order)
    top = df.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") == 1)
    return top.groupBy(*by).agg(F.count(F.lit(1)).alias("tied"), F.min(member).alias("_m")).select(
        *by, "tied", F.when(F.col("tied") == 1, F.col("_m")).alias(member),
        F.when(F.col("tied") == 1, "OK").otherwise("AMBIGUOUS").alias("status"),
    )


def rank_rows(df: DataFrame, order: Sequence, name: str = "final_rank") -> DataFrame:
    """Rank over the whole table in a total order."""
    return number_rows(df, [], order, name)


def share(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each value over the table total, from one scalar subquery."""
    total = df.select(F.sum(value).alias("t")).scalar()
    return df.withColumn(name, F.try_divide(F.col(value), total))


def first_n_distinct(df: DataFrame, by: Sequence[str], key: Sequence[str], order: Sequence[str], n: int,
                     drop: bool = False) -> DataFrame:
    """Rows of the first n distinct keys by first appearance, or of all but those."""
    first_seen = df.groupBy(*by, *key).agg(F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_first", *key)
    lead = first_seen.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= n)
    lead = lead.select(*by, *key)
    return df.join(lead, [*by, *key], "left_anti" if drop else "left_semi")


def number_groups(df: DataFrame, group: str, member: str, prefix: str, width: int = 4, name: str = "group_id") -> DataFrame:
    """Stable group ids ``PREFIX0001..`` in the order of each group's smallest member."""
    firsts = df.groupBy(group).agg(F.min(member).alias("_min"))
    numbered = number_rows(firsts, [], ["_min"], "_no").select(
        F.col(group).alias("_g"), padded_id(prefix, F.col("_no"), width).alias(name)
    )
    return df.join(numbered, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def next_number(df: DataFrame, by: Sequence[str], number: str, name: str = "next_number") -> DataFrame:
    """Largest number plus one per group."""
    return df.groupBy(*by).agg((F.max(number) + 1).alias(name))


def prefix_pass(long: DataFrame, id_cols: Sequence[str], order: str, passed: str) -> DataFrame:
    """Leading passes before the first failure, next to all passes."""
    # One row per rule and candidate, so the list is as short as the rule list.
    stats = long.groupBy(*id_cols).agg(
        F.min(F.when(~F.col(passed), F.col(order))).alias("_fail"), F.collect_list(order).alias("_orders"),
        F.sum(F.col(passed).cast("int")).cast("long").alias("pass_count"),
    )
    before = F.size(F.filter("_orders", lambda x: F.col("_fail").isNull() | (x < F.col("_fail"))))
    return stats.select(*id_cols, before.cast("long").alias("prefix_pass_count"), "pass_count")


def order_total(df: DataFrame, order: Sequence) -> DataFrame:
    """Sort by an explicit total order."""
    return df.orderBy(*[sort_column(c) for c in order])


def top_k(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """First k rows by a composite key."""
    return order_total(df, order).limit(k)


def row_at_max(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """The whole row at the largest value per group, lowest ``tie`` first (T4)."""
    return best_per_key(df, by, [F.col(value).desc_nulls_last(), tie])


def evidence(df: DataFrame, by: Sequence[str], col: str, n: int, sep: str = ",", name: str = "evidence") -> DataFrame:
    """First n distinct members per group as text, with the full count (T5)."""
    members = df.select(*by, col).distinct()
    counts = members.groupBy(*by).agg(F.count(F.lit(1)).alias("member_count"))
    w = Window.partitionBy(*by).orderBy(col)
    # Only n rows per group survive the group limit, so the list below is bounded by n.
    few = members.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= n)
    texts = few.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", F.col(col).cast("string").alias("v")))),
                                 lambda r: r["v"]), sep).alias(name)
    )
    return counts.join(texts, list(by))


