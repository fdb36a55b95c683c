"""Ordered work inside groups of any size.

A window over a hot key sorts the whole key in one task. The size of the largest group is counted
first (a map-side combined count of the keys). Within ``PLAIN_GROUP_ROWS`` a plain window is used.
Beyond it rows are range partitioned on (group, order) and written once, so a hot group spreads
over many chunks; each chunk knows its own totals, and the small table of chunk totals carries
numbers, sums and previous rows across chunks. Windows then run per (chunk, group) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import stage_table

PLAIN_GROUP_ROWS = 1_000_000
_OFFSET_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def sort_column(item) -> Column:
    """A name sorts ascending with NULLs last; sort expressions pass through."""
    return F.col(item).asc_nulls_last() if isinstance(item, str) else item


def groups_fit(df: DataFrame, by: Sequence[str], bound: int) -> bool:
    """True when no group has more than ``bound`` rows."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= bound


def chunked(df: DataFrame, by: Sequence[str], order: Sequence, chunks: int | None = None) -> DataFrame:
    """Rows in (by, order) order with ``_at`` (position) and ``_chunk`` (range partition)."""
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [sort_column(c) for c in (*by, *order)]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = stage_table(ranged.withColumn("_at", F.monotonically_increasing_id()), "chunks")
    return placed.withColumn("_chunk", F.shiftright("_at", _OFFSET_BITS))


def _join_segments(rows: DataFrame, segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach one segment row per (chunk, group); NULL group keys match each other."""
    renamed = segments.select(
        F.col("_chunk").alias("_s_chunk"), *[F.col(c).alias(f"_s_{c}") for c in by],
        *[c for c in segments.columns if c not in ("_chunk", *by)],
    )
    cond = F.col("_chunk") == F.col("_s_chunk")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return rows.join(renamed, cond, "inner").drop("_s_chunk", *[f"_s_{c}" for c in by])


def _before(by: Sequence[str]):
    """Window over the chunks of one group: at most one row per chunk."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy()
    return spec.orderBy("_chunk")


def running(
    df: DataFrame, by: Sequence[str], order: Sequence, sums: dict[str, Column] | None = None,
    row_name: str = "row_no", bound: int = PLAIN_GROUP_ROWS,
) -> DataFrame:
    """Row number and running sums in ``order`` inside each group; ``order`` must be total."""
    sums = sums or {}
    if groups_fit(df, by, bound):
        spec = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*[sort_column(c) for c in order])
        upto = spec.rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", F.row_number().over(spec).cast("long").alias(row_name),
            *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(k) for k, v in sums.items()],
        )
    rows = chunked(df.withColumns({f"_v_{k}": v for k, v in sums.items()}) if sums else df, by, order)
    segments = rows.groupBy("_chunk", *by).agg(
        F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums],
    )
    prior = _before(by).rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select(
        "_chunk", *by, "_start",
        F.coalesce(F.sum("_rows").over(prior), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_t_{k}").over(prior), F.lit(0)).alias(f"_b_{k}") for k in sums],
    )
    out = _join_segments(rows, segments, by).withColumn(
        row_name, F.col("_at") - F.col("_start") + 1 + F.col("_rows_before")
    )
    if sums:
        inside = Window.partitionBy("_chunk", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns(
            {k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}
        )
    return out.select(*df.columns, row_name, *sums)


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "row_no", bound: int = PLAIN_GROUP_ROWS) -> DataFrame:
    """1..N inside each group (or over the table for ``by=[]``)."""
    return running(df, by, order, row_name=name, bound=bound)


def lagged(df: DataFrame, by: Sequence[str], order: Sequence, cols: Sequence[str], bound: int = PLAIN_GROUP_ROWS) -> DataFrame:
    """Adds ``prev_<col>``: the value one row earlier in the group, NULL on its first row."""
    if groups_fit(df, by, bound):
        spec = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*[sort_column(c) for c in order])
        return df.select("*", *[F.lag(c).over(spec).alias(f"prev_{c}") for c in cols])
    rows = chunked(df, by, order)
    segments = rows.groupBy("_chunk", *by).agg(
        F.max_by(F.struct(*cols), F.col("_at")).alias("_last")
    )
    segments = segments.select("_chunk", *by, F.lag("_last").over(_before(by)).alias("_carry"))
    inside = Window.partitionBy("_chunk", *by).orderBy("_at")
    out = _join_segments(rows, segments, by)
    first = F.row_number().over(inside) == 1
    out = out.withColumns(
        {f"prev_{c}": F.when(first, F.col("_carry")[c]).otherwise(F.lag(c).over(inside)) for c in cols}
    )
    return out.select(*df.columns, *[f"prev_{c}" for c in cols])


DIGITS = (6, 22, 38)  # bits behind the point of the place of a value at each pass


def value_place(value: Column) -> Column:
    """A number that rises with the value: its binary logarithm, straight between powers of two, and its sign.

    Where the logarithm is rounded up to the next power, the place stays below that of the power.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # 2^-exponent in two factors, as one of them alone can be beyond the range of a double.
    scaled = size * F.pow(F.lit(2.0), -F.floor(exponent / 2)) * F.pow(F.lit(2.0), -(exponent - F.floor(exponent / 2)))
    own = F.signum(value) * (exponent + scaled - 1 + 1100)
    return F.when(F.isnan(value), F.lit(8000.0)).when(size == float("inf"), F.signum(value) * 4000).when(size == 0, F.lit(0.0)).otherwise(own)


def medians(df: DataFrame, by: Sequence[str], cols: Sequence[str], bound: int = PLAIN_GROUP_ROWS) -> DataFrame:
    """Exact interpolated medians per group, one row per group with a value, columns ``median_<col>``.

    Groups of up to ``bound`` rows are moved once and ranked by windows. Larger ones, of which there are at
    most as many as ``bound`` goes into the table, are listed, and their values are selected by radix. Both
    are parts of one plan, and nothing runs before the action; where no group is larger, the second is
    dropped while running. NaN is the largest value; missing values don't count.
    """
    keys, values = [f"_k{i}" for i in range(max(len(by), 1))], [f"_v{i}" for i in range(len(cols))]
    given = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_k0")]
    rows = df.select(*given, *[(F.col(c).cast("double") + F.lit(0.0)).alias(v) for c, v in zip(cols, values)])
    rows = rows.withColumn("_g", F.struct(F.lit(0).alias("_0"), *keys))
    large = F.broadcast(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select("_g"))
    few = rows.join(large, "_g", "left_anti").drop("_g")
    middle, halves = F.lit(False), []
    for i, v in enumerate(values):
        w = Window.partitionBy(*keys).orderBy(F.col(v).asc_nulls_last())
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        few = few.withColumns({f"_r{i}": F.row_number().over(w), f"_n{i}": F.count(v).over(whole)})
        low, high = (F.col(f"_r{i}") == F.floor((F.col(f"_n{i}") + 1) / 2)), (F.col(f"_r{i}") == F.floor(F.col(f"_n{i}") / 2) + 1)
        middle = middle | (F.col(v).isNotNull() & (low | high))
        halves.append(F.max(F.when(low, 0.5 * F.col(v))) + F.max(F.when(high, 0.5 * F.col(v))))
    names = [*[F.col(k).alias(c) for k, c in zip(keys, by)], *[f"median_{c}" for c in cols]]
    ranked = few.filter(middle).groupBy(*keys).agg(*[h.alias(f"median_{c}") for h, c in zip(halves, cols)]).select(*names)
    selected = _radix_medians(rows.join(large, "_g", "left_semi"), dict(zip(values, cols)))
    return ranked.unionAll(selected.select(*[F.col("_g")[k].alias(c) for k, c in zip(keys, by)], *[f"median_{c}" for c in cols]))


def _radix_medians(rows: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Medians of the values named in ``cols`` per ``_g``, in groups of any size.

    Equal values are counted, in map tasks first. Each pass counts the values of a group by a few more
    digits of their place, finds the digits of both middle ranks by a running sum over at most 2^18 counts,
    and keeps only the values there; the last pass sees at most 2^15 values. No group is sorted whole.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(v).alias("value")) for v, c in cols.items()])).alias("_m")
    long = rows.select("_g", cells).select("_g", "_m.metric", "_m.value").filter("value IS NOT NULL")
    counts = long.groupBy("_g", "metric", "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", value_place(F.col("value")))
    digit = lambda bits: F.floor(F.col("_place") * F.lit(2.0**bits))
    keys = ["_g", "metric"]

    def middle(found: DataFrame, keys: Sequence[str], order: str, rank: Column) -> DataFrame:
        """Of each running sum in ``order`` the rows that hold a rank, with the rank among their own values."""
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        placed = found.withColumns({"_upto": upto, "_rank": rank})
        return placed.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))).withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n"))

    first = counts.groupBy(*keys, digit(DIGITS[0]).alias("_digit")).agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("_total") + 1) / 2).alias("r")), F.struct(F.lit(1).alias("which"), (F.floor(F.col("_total") / 2) + 1).alias("r")))).alias("_q")
    both = first.withColumn("_total", total).select("*", ranks).select(*keys, "_digit", "_n", "_q.which", "_q.r")
    target = middle(both, [*keys, "which"], "_digit", F.col("r")).select(*keys, "which", "_rank", "_digit")
    for bits, finer in zip(DIGITS, (*DIGITS[1:], None)):
        here = counts.withColumn("_digit", digit(bits)).join(target, [*keys, "_digit"])
        order = "value" if finer is None else "_finer"
        if finer is not None:
            here = here.groupBy(*keys, "which", "_rank", digit(finer).alias("_finer")).agg(F.sum("_n").alias("_n"))
        found = middle(here, [*keys, "which"], order, F.col("_rank"))
        target = found.select(*keys, "which", "_rank", F.col(order).alias("_digit"))
    half = lambda c: F.sum(F.when(F.col("metric") == c, 0.5 * F.col("_digit"))).alias(f"median_{c}")
    return target.groupBy("_g").agg(*[half(c) for c in cols.values()])


def chunk_digest(df: DataFrame, by: Sequence[str], order: Sequence, line: Column, size: int = 65536) -> DataFrame:
    """Two-level SHA-256 of ordered lines per group, as ``n_rows`` and ``digest``.

    Each run of ``size`` lines, every line ended by a newline, is hashed; the digest of a group is
    the hash of its run digests, written the same way. The definition is the same for every group.
    """
    lines = number_rows(df.select(*by, *_order_names(df, order), line.alias("_line")), by, order, "_no")
    text = lambda parts: F.concat(F.array_join(F.transform(F.array_sort(parts), lambda x: x["line"]), "\n"), F.lit("\n"))
    pair = lambda no, value: F.collect_list(F.struct(F.col(no).alias("no"), F.col(value).alias("line")))
    runs = lines.groupBy(*by, F.floor((F.col("_no") - 1) / size).alias("_run")).agg(F.sha2(text(pair("_no", "_line")), 256).alias("_digest"), F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.sha2(text(pair("_run", "_digest")), 256).alias("digest"))


def _order_names(df: DataFrame, order: Sequence) -> list[str]:
    names = [c for c in order if isinstance(c, str)]
    if len(names) != len(order):
        raise ValueError("digest order takes column names")
    return names
