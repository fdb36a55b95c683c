"""Data-contract checks. Each returns violations as rows, or one verdict row per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.ranking import best_per_key
from siftline.operators.sets import shared


def run_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named boolean aggregates from one scan as (check_name, passed) (V1)."""
    totals = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"_c{i}") for i, c in enumerate(checks.values())])
    rows = [F.struct(F.lit(n).alias("check_name"), F.col(f"_c{i}").alias("passed")) for i, n in enumerate(checks)]
    return totals.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def overall_status(checks: DataFrame) -> DataFrame:
    """PASS or FAIL, with the failed names in order (V1). A check list is small by nature."""
    return checks.agg(
        F.count(F.lit(1)).alias("check_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check_name")))), ";").alias("failed_checks"),
        F.when(F.min("passed"), "PASS").otherwise("FAIL").alias("status"),
    )


def require_columns(df: DataFrame, required: Sequence[str], exact: bool = False) -> DataFrame:
    """Raise unless the columns are there, in exactly this order on request (V2)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if exact and list(df.columns) != list(required):
        raise ValueError(f"columns differ from the contract: {df.columns}")
    return df


def column_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required or unexpected column: its state and how many rows fill it (V2)."""
    names = list(dict.fromkeys([*required, *df.columns]))
    counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(0)).cast("long").alias(f"_c{i}") for i, c in enumerate(names)])
    rows = []
    for i, c in enumerate(names):
        state = "missing" if c not in df.columns else "ok" if c in required else "unexpected"
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(state).alias("state"), F.col(f"_c{i}").alias("filled")))
    return counts.select(F.inline(F.array(*rows)))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (V3)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def count_gates(tables: dict[str, DataFrame], contract: dict[str, int]) -> DataFrame:
    """Row counts against frozen expectations (V4)."""
    out = None
    for name, want in contract.items():
        row = tables[name].agg(F.count(F.lit(1)).alias("actual_count")).select(
            F.lit(name).alias("table_name"), F.lit(want).cast("long").alias("expected_count"), "actual_count"
        )
        out = row if out is None else out.unionAll(row)
    return out.withColumn("passed", F.col("expected_count") == F.col("actual_count"))


def cardinality(df: DataFrame, key: Sequence[str], expected: int, index: str | None = None, start: int = 0) -> DataFrame:
    """Keys whose row count, or whose index set start..start+n-1, is not as expected (V5)."""
    if index is None:
        stats = df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count"))
        return stats.filter(F.col("row_count") != expected)
    # Distinct indexes first, then their number: as many rows as expected, all different and in range.
    slots = df.groupBy(*key, F.col(index).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    inside = F.count_if(F.col("_at").between(start, start + expected - 1))
    stats = slots.groupBy(*key).agg(F.sum("_n").alias("row_count"), inside.alias("_inside"))
    return stats.filter((F.col("row_count") != expected) | (F.col("_inside") != expected)).select(*key, "row_count")


def domain_violations(df: DataFrame, id_cols: Sequence[str], col: str, allowed: Sequence | None = None,
                      lo=None, hi=None) -> DataFrame:
    """Values outside an enumeration or a closed range; NULL is outside (V6)."""
    ok = F.lit(True)
    if allowed is not None:
        ok = ok & F.col(col).isin(*allowed)
    if lo is not None:
        ok = ok & (F.col(col) >= lo)
    if hi is not None:
        ok = ok & (F.col(col) <= hi)
    return df.filter(~F.coalesce(ok, F.lit(False))).select(*id_cols, col)


def implication(df: DataFrame, if_cond: Column, then_cond: Column) -> DataFrame:
    """Rows where the condition holds but the consequence does not (V7)."""
    return df.filter(F.coalesce(if_cond, F.lit(False)) & ~F.coalesce(then_cond, F.lit(False)))


def validate_events(lines: DataFrame, text: str, schema: str, rules: dict[str, Column], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid events as columns, and rejected lines with every reason (V8).

    The key set is checked on the raw JSON, so an unknown key is a reason as well.
    """
    # As the output of a generator the parsed line is computed once, not once per rule.
    once = F.struct(F.from_json(text, schema).alias("_e"), F.json_object_keys(text).alias("_keys"))
    parsed = lines.select("*", F.inline(F.array(once)))
    want = F.array(*[F.lit(k) for k in keys])
    reasons = [
        F.when(F.col("_keys").isNull(), F.lit("not_an_object")),
        F.when(F.size(F.array_except(want, "_keys")) > 0, F.lit("missing_key")),
        F.when(F.size(F.array_except("_keys", want)) > 0, F.lit("unknown_key")),
    ]
    flat = parsed.select("*", "_e.*")
    reasons += [F.when(F.col("_keys").isNotNull() & ~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    verdict = F.struct(F.array_join(F.array_compact(F.array(*reasons)), ";").alias("reasons"))
    judged = flat.select("*", F.inline(F.array(verdict)))
    good = judged.filter(F.col("reasons") == "").select(*lines.columns, *[c for c in judged.columns if c in keys and c not in lines.columns])
    return good, judged.filter(F.col("reasons") != "").select(*lines.columns, "reasons")


def manifest_verify(manifest: DataFrame, inventory: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Status per path: ok, hash_mismatch, missing_file, unlisted_file or duplicate_entry (V9)."""
    listed = manifest.groupBy(path).agg(F.count(F.lit(1)).alias("_n"), F.min(digest).alias("_want"))
    found = inventory.select(path, F.col(digest).alias("_got"), F.lit(True).alias("_has"))
    status = (
        F.when(F.col("_n") > 1, "duplicate_entry").when(F.col("_has").isNull(), "missing_file")
        .when(F.col("_n").isNull(), "unlisted_file").when(F.col("_want") == F.col("_got"), "ok").otherwise("hash_mismatch")
    )
    return listed.join(found, path, "full_outer").select(path, status.alias("status"))


def array_contracts(df: DataFrame, id_cols: Sequence[str], col: str, length: int) -> DataFrame:
    """Per array: wrong length, non-finite members, NULL members."""
    values = F.col(col)
    bad_number = F.size(F.filter(values, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    nulls = F.size(F.filter(values, lambda x: x.isNull()))
    out = df.select(*id_cols, F.size(values).alias("length"), bad_number.alias("non_finite"), nulls.alias("null_members"))
    return out.withColumn("passed", (F.col("length") == length) & (F.col("non_finite") == 0) & (F.col("null_members") == 0))


def one_hot_contracts(edges: DataFrame, by: Sequence[str], row: str) -> DataFrame:
    """Rows of a one-hot matrix mapped more than once (V10); ``edges`` holds the set cells."""
    return edges.groupBy(*by, row).agg(F.count(F.lit(1)).alias("mapped")).filter(F.col("mapped") > 1)


def unmapped_resolved(atoms: DataFrame, edges: DataFrame, keys: Sequence[str], resolved: str) -> DataFrame:
    """Resolved atoms without a token."""
    return atoms.filter(F.col(resolved)).join(edges.select(*keys), list(keys), "left_anti").select(*keys)


def axis_contracts(shapes: DataFrame, by: Sequence[str], axes: Sequence[tuple[str, int, str]]) -> DataFrame:
    """Named axes on which the arrays of a file disagree, or that one of them lacks.

    ``shapes``: rows with ``name`` and ``shape``. ``axes``: (array, place of the axis, its name).
    """
    listed = F.array(*[F.struct(F.lit(a).alias("array"), F.lit(k).alias("place"), F.lit(n).alias("axis")) for a, k, n in axes])
    sized = shapes.select(*by, F.explode(F.filter(listed, lambda x: x["array"] == F.col("name"))).alias("x"), "shape").select(*by, "x.axis", F.get("shape", F.col("x.place")).alias("size"))
    wanted = F.lit(0)
    for axis in sorted({n for _, _, n in axes}):
        wanted = F.when(F.col("axis") == axis, sum(n == axis for _, _, n in axes)).otherwise(wanted)
    stats = sized.groupBy(*by, "axis").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("size").alias("arrays"))
    return stats.filter((F.col("least") != F.col("most")) | (F.col("arrays") != wanted) | F.col("least").isNull())


def token_contracts(cells: DataFrame, resolved: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, reason, item): broken rules of an atom-to-token matrix.

    ``cells``: ``atom``, ``token`` and ``value`` of the dense matrix; ``resolved``: ``atom`` and a
    boolean ``resolved``. An atom has one token at most, a resolved atom exactly one, every token an
    atom, and tokens are numbered from 0 without a gap.
    """
    def found(df: DataFrame, reason: str, item: str) -> DataFrame:
        return df.select(*by, F.lit(reason).alias("reason"), F.col(item).cast("long").alias("item"))

    atoms = cells.groupBy(*by, "atom").agg(F.count_if(F.col("value") != 0).alias("tokens"))
    tokens = cells.groupBy(*by, "token").agg(F.max(F.abs("value")).alias("most"))
    numbers = tokens.groupBy(*by).agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count(F.lit(1)).alias("n"))
    mapped = resolved.filter("resolved").select(*by, "atom").join(atoms, [*by, "atom"], "left")
    return (
        found(atoms.filter("tokens > 1"), "several_tokens", "atom")
        .unionAll(found(mapped.filter("coalesce(tokens, 0) <> 1"), "resolved_without_one_token", "atom"))
        .unionAll(found(tokens.filter("coalesce(most, 0) = 0"), "empty_token", "token"))
        .unionAll(found(numbers.filter("first <> 0 OR last + 1 <> n"), "tokens_not_contiguous", "last"))
    )


def new_only(batch: DataFrame, registry: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id the registry lacks, and rows refused: known ids or repeats in the batch."""
    counts = batch.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    known = registry.select(id_col).distinct().withColumn("_known", F.lit(True))
    state = counts.join(known, id_col, "left")
    fresh = state.filter((F.col("_n") == 1) & F.col("_known").isNull()).select(id_col)
    refused = state.filter((F.col("_n") > 1) | F.col("_known")).select(
        id_col, F.when(F.col("_known"), "known").otherwise("repeated").alias("reason")
    )
    return batch.join(fresh, id_col, "left_semi"), refused


def current_facts(events: DataFrame, id_col: str, supersedes: str) -> DataFrame:
    """Facts no later fact supersedes; nothing is updated in place."""
    replaced = events.filter(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_col))
    return events.join(replaced, id_col, "left_anti")


def complete_success(df: DataFrame, id_cols: Sequence[str], success: Column, required: Sequence[str]) -> DataFrame:
    """Success rows that lack a required value, with the columns they lack."""
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.filter(success).select(*id_cols, F.array_join(lacks, ";").alias("missing_values")).filter(
        F.col("missing_values") != ""
    )


def independent_domains(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Ids two cohorts share; they must share none."""
    return shared(a, b, id_col)


def readiness(expected: DataFrame, attempts: DataFrame, keys: Sequence[str], attempt: str, complete: Column) -> DataFrame:
    """Every expected unit with its latest attempt: READY, INCOMPLETE or MISSING."""
    latest = best_per_key(attempts, keys, [F.col(attempt).desc_nulls_last()]).select(
        *keys, F.col(attempt).alias("latest_attempt"), complete.alias("_ok")
    )
    state = F.when(F.col("latest_attempt").isNull(), "MISSING").when(F.col("_ok"), "READY").otherwise("INCOMPLETE")
    return expected.join(latest, list(keys), "left").select(*keys, "latest_attempt", state.alias("state"))


def sources_agree(df: DataFrame, key: Sequence[str], value: str, expected: str, tol: float = 1e-9) -> DataFrame:
    """Spread of one value over its sources, and its distance to the recomputed value."""
    stats = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("source_count"), (F.max(value) - F.min(value)).alias("spread"),
        F.max(F.abs(F.col(value) - F.col(expected))).alias("max_error"),
    )
    return stats.withColumn("agrees", F.coalesce((F.col("spread") <= tol) & (F.col("max_error") <= tol), F.lit(False)))


def map_contract(df: DataFrame, id_cols: Sequence[str], col: str, keys: Sequence[str], pattern: str) -> DataFrame:
    """Maps with a missing key, an unknown key or a badly shaped value."""
    want = F.array(*[F.lit(k) for k in keys])
    have = F.map_keys(col)
    missing = F.array_join(F.array_sort(F.array_except(want, have)), ";")
    extra = F.array_join(F.array_sort(F.array_except(have, want)), ";")
    bad = F.array_join(F.array_sort(F.map_keys(F.map_filter(col, lambda k, v: ~F.coalesce(v.rlike(pattern), F.lit(False))))), ";")
    return df.select(*id_cols, missing.alias("missing_keys"), extra.alias("unknown_keys"), bad.alias("bad_values")).filter(
        (F.col("missing_keys") != "") | (F.col("unknown_keys") != "") | (F.col("bad_values") != "")
    )
