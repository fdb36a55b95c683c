"""Summaries: rule and group tables, funnels, histograms, digests, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.clean import padded_id
from siftline.operators.ordered import chunk_digest, medians, number_rows, running
from siftline.session import literal_rows


def _on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per key from ``b``; NULL keys match."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(right, cond, how).drop(*[f"_k_{k}" for k in keys])


def rule_summary(long: DataFrame, keys: Sequence[str] = ("rule_order", "label"), passed: str = "passed") -> DataFrame:
    """Evaluated, passed, failed and failure rate per rule (A1)."""
    hit = F.sum(F.col(passed).cast("long"))
    total = F.count(F.lit(1))
    return long.groupBy(*keys).agg(
        total.alias("evaluated"), hit.alias("passed_count"), (total - hit).alias("failed_count"),
        ((total - hit) / total).alias("failure_rate"),
    )


def group_summary(df: DataFrame, by: Sequence[str], metrics: dict[str, Column], median_cols: Sequence[str] = ()) -> DataFrame:
    """Conditional counts, sums and maxima per group, with exact medians beside them (A2)."""
    named = [m.alias(k) for k, m in metrics.items()]
    base = df.groupBy(*by).agg(*named)
    return _on(base, medians(df, by, median_cols), by, "left") if median_cols else base


def grain_rollup(df: DataFrame, cols: Sequence[str], sets: Sequence[Sequence[str]], metrics: dict[str, Column]) -> DataFrame:
    """Several grains in one pass; ``grain_id`` tells which columns are rolled up (A3)."""
    return df.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]
    ).agg(F.grouping_id().alias("grain_id"), *[m.alias(k) for k, m in metrics.items()])


def stage_summary(df: DataFrame, by: Sequence[str], attempt: str, seconds: str) -> DataFrame:
    """Distinct attempts, total, median and longest seconds per stage (A4)."""
    attempts = df.select(*by, attempt).distinct().groupBy(*by).agg(F.count(attempt).alias("attempts"))
    sums = df.groupBy(*by).agg(F.sum(seconds).alias("total_seconds"), F.max(seconds).alias("max_seconds"))
    mid = medians(df, by, [seconds]).withColumnRenamed(f"median_{seconds}", "median_seconds")
    return _on(_on(sums, attempts, by), mid, by, "left")


def envelope(df: DataFrame, by: Sequence[str], maxes: Sequence[str] = (), mins: Sequence[str] = ()) -> DataFrame:
    """Largest and smallest values over stages (A5)."""
    return df.groupBy(*by).agg(
        *[F.max(c).alias(f"max_{c}") for c in maxes], *[F.min(c).alias(f"min_{c}") for c in mins]
    )


def series_summary(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, extremes, first and last by sample order, change and range per series."""
    # The position is a total order, so first and last are merged partial results, not a sort.
    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("samples")]
    for c in cols:
        first, last = F.min_by(c, at), F.max_by(c, at)
        aggs += [
            F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), first.alias(f"{c}_first"),
            last.alias(f"{c}_last"), (last - first).alias(f"{c}_delta"), (F.max(c) - F.min(c)).alias(f"{c}_range"),
        ]
    return df.groupBy(*by).agg(*aggs)


def peak_gate(df: DataFrame, by: Sequence[str], used: str, total: str, limit: float = 0.90) -> DataFrame:
    """Largest use over smallest total per run, and whether it lies in (0, limit]."""
    peak = F.max(used) / F.min(F.when(F.col(total) > 0, F.col(total)))
    # One non-positive total spoils the run, as no fraction of it means anything.
    bad = F.coalesce(F.sum((F.coalesce(F.col(total), F.lit(0.0)) <= 0).cast("long")), F.lit(0))
    return df.groupBy(*by).agg(peak.alias("peak_fraction"), bad.alias("bad_totals")).withColumn(
        "within_gate",
        F.coalesce((F.col("peak_fraction") > 0) & (F.col("peak_fraction") <= limit) & (F.col("bad_totals") == 0), F.lit(False)),
    )


def forged_peaks(reported: DataFrame, raw: DataFrame, by: Sequence[str], value: str, tol: float = 1e-9) -> DataFrame:
    """Runs whose reported peak lies below the peak of their raw samples."""
    return _on(reported, raw.select(*by, F.col("peak_fraction").alias("raw_peak")), by).filter(
        F.col(value) < F.col("raw_peak") - tol
    )


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative condition, counted in one scan."""
    alive, sums = F.lit(True), []
    for _, cond in stages:
        alive = alive & F.coalesce(cond, F.lit(False))
        sums.append(F.coalesce(F.sum(alive.cast("long")), F.lit(0)))
    totals = df.agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    rows = [
        F.struct(F.lit(i + 1).alias("stage_order"), F.lit(name).alias("stage"), F.col(f"_s{i}").alias("remaining_count"))
        for i, (name, _) in enumerate(stages)
    ]
    return totals.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def table_funnel(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Funnel whose stages are row counts of several tables."""
    out = None
    for i, (name, df) in enumerate(tables, start=1):
        row = df.agg(F.count(F.lit(1)).alias("remaining_count")).select(
            F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), "remaining_count"
        )
        out = row if out is None else out.unionAll(row)
    return out


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """Counts, most common first, ties by label, with their ordinal."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))
    return number_rows(counts, [], [F.col("row_count").desc(), F.col(col).asc_nulls_last()], "ordinal")


def exploded_frequencies(df: DataFrame, col: str, sep: str = r" \| ", k: int = 15, detail: str = ":") -> DataFrame:
    """Counts of delimited items with their details cut off, top k (A10)."""
    items = df.select(F.explode(F.split(col, sep)).alias("_item"))
    items = items.select(F.substring_index("_item", detail, 1).alias("item")).filter(F.col("item") != "")
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("row_count")).orderBy(
        F.col("row_count").desc(), F.col("item")
    ).limit(k)


def histogram_text(df: DataFrame, by: Sequence[str], col: str, name: str = "histogram") -> DataFrame:
    """``value:count;value:count`` per group in value order."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(col).cast("string").alias("v"), F.col("_n").alias("n"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["v"], F.lit(":"), p["n"].cast("string"))), ";")
    return counts.groupBy(*by).agg(text.alias(name))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts of several columns as one row.

    The (column, value) pairs are made distinct first, map side, instead of one expand per column.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols
    ])).alias("_p")).select("_p.*").filter(F.col("v").isNotNull()).distinct()
    return pairs.agg(*[F.coalesce(F.sum((F.col("c") == c).cast("long")), F.lit(0)).alias(f"distinct_{c}") for c in cols])


def duplicate_groups(df: DataFrame, hash_col: str, member: str, prefix: str = "DUP") -> DataFrame:
    """Members of every content hash seen more than once, numbered.

    The copies of a popular file may be a third of all rows, so members are numbered by chunks.
    """
    sizes = df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("member_count")).filter(F.col("member_count") > 1)
    groups = number_rows(sizes, [], [hash_col], "_g").withColumn("duplicate_group_id", padded_id(prefix, F.col("_g"))).drop("_g")
    members = df.join(groups, hash_col)
    return number_rows(members, [hash_col], [member], "member_index")


def duplicate_keys(df: DataFrame, keys: Sequence[str], casefold: bool = False) -> DataFrame:
    """Keys held by more than one row, letter case ignored on request."""
    cols = [F.lower(F.col(k).cast("string")).alias(k) if casefold else F.col(k) for k in keys]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def set_digest(df: DataFrame, col: str, by: Sequence[str] = (), size: int = 65536) -> DataFrame:
    """Order-free digest of the ids of a group; see ``chunk_digest`` for large groups."""
    ids = df.select(*by, F.col(col).cast("string").alias(col))
    return chunk_digest(ids, by, [col], F.col(col), size)


def ordered_fingerprint(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], size: int = 65536) -> DataFrame:
    """Digest of tab-joined columns in row order per group."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return chunk_digest(df, by, order, line, size)


def assemble(df: DataFrame, by: Sequence[str], order: str, col, sep: str = "", name: str = "text") -> DataFrame:
    """Ordered text of each group, and its digest (A17). The text is the result, one cell per group."""
    piece = F.col(col) if isinstance(col, str) else col
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    out = df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["p"]), sep).alias(name))
    return out.withColumn(f"{name}_sha256", F.sha2(name, 256))


def crosstab_fixed(df: DataFrame, a: str, b: str, dom_a: Sequence, dom_b: Sequence) -> DataFrame:
    """Counts over a fixed row and column domain; empty cells are 0."""
    counts = df.filter(F.col(a).isin(*dom_a)).groupBy(a).agg(
        *[F.sum((F.col(b) == v).cast("long")).alias(str(v)) for v in dom_b]
    )
    rows = literal_rows(df.sparkSession, [(v,) for v in dom_a], [a])
    return rows.join(counts, a, "left").select(a, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(str(v)) for v in dom_b])


def pivot_matrix(df: DataFrame, row: str, col: str, values: Sequence, agg: Column, fill=None) -> DataFrame:
    """One column per value of a known domain."""
    out = df.groupBy(row).pivot(col, list(values)).agg(agg)
    return out if fill is None else out.fillna(fill, subset=[str(v) for v in values])


def missing_cells(matrix: DataFrame, row: str, values: Sequence) -> DataFrame:
    """Cells of a pivot that got no value; a complete matrix has none."""
    hits = F.array_compact(F.array(*[F.when(F.col(str(v)).isNull(), F.lit(str(v))) for v in values]))
    return matrix.select(row, F.explode(hits).alias("missing_column"))


def panel_margin(
    df: DataFrame, id_col: str, target: str, role: str, score: str, contacts: str,
    minimum_positive: float, maximum_negative: float, minimum_margin: float, minimum_contacts: int,
    subset_prefix: str | None = None, bonus: float = 0.025,
) -> DataFrame:
    """Selectivity of each design: models averaged per target, then worst positive against best
    negative, gate and selection score (A22)."""
    means = df.groupBy(id_col, target, role).agg(
        F.round(F.avg(score), 4).alias("m"), F.max(contacts).alias("c")
    )
    pos, neg = F.col(role) == "positive", F.col(role) == "negative"
    named = neg & F.col(target).startswith(subset_prefix or "")
    out = means.groupBy(id_col).agg(
        F.min(F.when(pos, F.col("m"))).alias("positive_min"),
        F.max(F.when(neg, F.col("m"))).alias("negative_max"),
        F.max(F.when(named, F.col("m"))).alias("subset_max"),
        F.max("c").alias("contacts"),
    )
    margin = F.col("positive_min") - F.col("negative_max")
    passed = (
        (F.col("positive_min") >= minimum_positive) & (F.col("negative_max") <= maximum_negative)
        & (margin >= minimum_margin) & (F.col("contacts") >= minimum_contacts)
    )
    return out.select(
        id_col, "positive_min", "negative_max", "subset_max", F.round(margin, 4).alias("margin"), "contacts",
        F.round(margin + bonus * F.col("contacts"), 4).alias("selection_score"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def weighted_macro(df: DataFrame, partition: Sequence[str], group: str, x: str, w: str) -> DataFrame:
    """Weighted mean inside each source group, then plain mean over groups."""
    inner = df.groupBy(*partition, group).agg(F.try_divide(F.sum(F.col(w) * F.col(x)), F.sum(w)).alias("_m"))
    return inner.groupBy(*partition).agg(F.count(F.lit(1)).alias("group_count"), F.avg("_m").alias("macro_mean"))


def schema_census(rows: DataFrame, file: str = "file", role: str = "role") -> DataFrame:
    """Files per identical (name, shape, dtype) signature, with one example."""
    entry = F.concat_ws(":", "name", F.concat_ws("x", F.col("shape").cast("array<string>")), "dtype")
    per_file = rows.groupBy(role, file).agg(F.array_join(F.array_sort(F.collect_set(entry)), ";").alias("signature"))
    return per_file.groupBy(role, "signature").agg(F.count(F.lit(1)).alias("file_count"), F.min(file).alias("example"))


# Statistic prefixes that name one and the same rule.
STATISTIC_PREFIXES = ("Average_", "1_", "2_", "3_", "4_", "5_")


def failure_counters(df: DataFrame, id_col: str, failed: str, prefixes: Sequence[str] = STATISTIC_PREFIXES) -> DataFrame:
    """Failures per base rule; each design counts once per base rule."""
    pattern = "^(?:" + "|".join(prefixes) + ")"
    each = df.select(id_col, F.explode(failed).alias("_f"))
    base = each.select(id_col, F.regexp_replace("_f", pattern, "").alias("base_rule")).distinct()
    return base.groupBy("base_rule").agg(F.count(F.lit(1)).alias("failed_designs"))


def hotspot_summary(df: DataFrame, by: Sequence[str], covered: str, distance: str) -> DataFrame:
    """Candidates, covered candidates and median distance per site."""
    return group_summary(
        df, by, {"candidate_count": F.count(F.lit(1)), "covered_count": F.sum(F.col(covered).cast("long"))}, [distance]
    )


def cohort_summary(files: DataFrame, cohorts: DataFrame, cohort: str, status: str, active: Sequence[str]) -> DataFrame:
    """Observed against expected files per cohort with a status histogram."""
    counts = files.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(F.col("parse_ok").cast("long")).alias("parse_pass_count"),
        F.sum(F.col("complete").cast("long")).alias("complete_count"),
        F.sum(F.col(status).isin(*active).cast("long")).alias("active_count"),
    )
    joined = cohorts.join(counts, cohort, "left").join(histogram_text(files, [cohort], status, "statuses"), cohort, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("file_count", "parse_pass_count", "complete_count", "active_count")}
    return joined.withColumns(zero).withColumn("count_matches", F.col("file_count") == F.col("expected_count"))


def lineage_completeness(df: DataFrame, id_col: str, role: str, size: str, expected: int) -> DataFrame:
    """Artefacts and bytes per candidate against the number of roles."""
    per_role = df.groupBy(id_col, role).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    return per_role.groupBy(id_col).agg(
        F.sum("_n").alias("artefact_count"), F.sum("_b").alias("total_bytes"), F.count(role).alias("role_count")
    ).withColumn("complete", (F.col("role_count") == expected) & (F.col("artefact_count") == expected))


def compare_cohorts(df: DataFrame, cohort: str, metrics: dict[str, Column], median_cols: Sequence[str], config: DataFrame | None = None) -> DataFrame:
    """One descriptive row per cohort; cohorts are never pooled."""
    out = group_summary(df, [cohort], metrics, median_cols)
    return out if config is None else out.join(config, cohort, "left")


def symbol_sources(df: DataFrame, source: str, text: str) -> DataFrame:
    """Per letter and source: occurrences; one row each, so no list grows with the sources.

    Letters are counted as they are split off, within map tasks first.
    """
    letters = df.select(source, F.explode(F.split(text, "")).alias("symbol")).filter("symbol != ''")
    return letters.groupBy("symbol", source).agg(F.count(F.lit(1)).alias("occurrences"))


def symbol_inventory(df: DataFrame, source: str, text: str, sep: str = ";") -> DataFrame:
    """Per letter: occurrences, distinct sources and their list.

    The list is one cell, for sources of a bounded number; ``symbol_sources`` serves any number.
    """
    return symbol_sources(df, source, text).groupBy("symbol").agg(
        F.sum("occurrences").alias("occurrences"), F.count(source).alias("source_count"),
        F.array_join(F.array_sort(F.collect_list(F.col(source).cast("string"))), sep).alias("sources"),
    )


def acceptance_rate(df: DataFrame, by: Sequence[str], order: Sequence, accepted: str, warmup: int, limit: float) -> DataFrame:
    """Running acceptance rate per campaign; ``below_limit`` after the warm-up."""
    out = running(df, by, order, {"accepted_so_far": F.col(accepted).cast("long")}, "seen_so_far")
    rate = F.col("accepted_so_far") / F.col("seen_so_far")
    return out.withColumns({"rate": rate, "below_limit": (F.col("seen_so_far") >= warmup) & (rate < limit)})


def first_stop(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """First row per campaign at which monitoring would stop it."""
    return df.filter("below_limit").groupBy(*by).agg(F.min("seen_so_far").alias("stopped_at"))


def summary_json(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON document from several one-row tables."""
    cols = []
    spark = next(iter(parts.values())).sparkSession
    for name, df in sorted(parts.items()):
        cols.append(df.select(F.struct(*df.columns)).scalar().alias(name))
    return spark.range(1).select(F.to_json(F.struct(*cols)).alias("summary"))


def never_passed(long: DataFrame, keys: Sequence[str] = ("rule_order", "label"), passed: str = "passed") -> DataFrame:
    """Rules that failed for every candidate."""
    stats = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluated"), F.max(passed).alias("_any"))
    return stats.filter(~F.col("_any")).drop("_any")
