"""Rules kept as data: thresholds, first reasons, classifiers, markers, file policy."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.clean import finite_of
from siftline.operators.ordered import number_rows


@dataclass(frozen=True)
class Rule:
    """One threshold: ``value_column operator threshold``, reported under ``label``."""

    order: int
    label: str
    value_column: str
    operator: str
    threshold: float
    unit: str = ""
    pass_column: str = ""

    def passes(self, value: Column) -> Column:
        """A missing or non-finite value fails."""
        if self.operator == "<=":
            test = value <= F.lit(float(self.threshold))
        elif self.operator == ">=":
            test = value >= F.lit(float(self.threshold))
        else:
            raise ValueError(f"unknown operator {self.operator!r} in rule {self.label!r}")
        return F.coalesce(test, F.lit(False))


# The ten default candidate filters (value column, operator, threshold, unit).
DEFAULT_FILTERS = (
    Rule(1, "unknown residues", "has_x", "<=", 0.0, "count", "pass_has_x_filter"),
    Rule(2, "complex backbone rmsd", "filter_rmsd", "<=", 2.5, "Å", "pass_filter_rmsd_filter"),
    Rule(3, "design backbone rmsd", "filter_rmsd_design", "<=", 2.5, "Å", "pass_filter_rmsd_design_filter"),
    Rule(4, "site coverage under 8 Å", "bindsite_under_8rmsd", ">=", 0.0001, "fraction",
         "pass_bindsite_under_8rmsd_filter"),
    Rule(5, "cysteine fraction", "CYS_fraction", "<=", 0.0, "fraction", "pass_CYS_fraction_filter"),
    Rule(6, "alanine fraction", "ALA_fraction", "<=", 0.3, "fraction", "pass_ALA_fraction_filter"),
    Rule(7, "glycine fraction", "GLY_fraction", "<=", 0.3, "fraction", "pass_GLY_fraction_filter"),
    Rule(8, "glutamate fraction", "GLU_fraction", "<=", 0.3, "fraction", "pass_GLU_fraction_filter"),
    Rule(9, "leucine fraction", "LEU_fraction", "<=", 0.3, "fraction", "pass_LEU_fraction_filter"),
    Rule(10, "valine fraction", "VAL_fraction", "<=", 0.3, "fraction", "pass_VAL_fraction_filter"),
)


def rules_from_table(table: DataFrame, limit: int = 10_000) -> list[Rule]:
    """Rules stored as rows; the row count is checked before they come to the driver."""
    rows = table.orderBy("order").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    fields = Rule.__dataclass_fields__
    return [Rule(**{k: r[k] for k in fields if k in r}) for r in rows]


def flag_all(df: DataFrame, flags: dict[str, Column], keep_all: str = "pass_all") -> DataFrame:
    """One boolean column per conjunct and their conjunction; NULL counts as false."""
    clean = {name: F.coalesce(cond, F.lit(False)) for name, cond in flags.items()}
    out = df.withColumns(clean)
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return out.withColumn(keep_all, every)


def apply_rules(df: DataFrame, id_cols: Sequence[str], rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Long pass/fail rows and the wide verdict, both in one scan and without a shuffle."""
    ordered = sorted(rules, key=lambda r: r.order)
    values = {r.value_column: finite_of(df, r.value_column) for r in ordered}
    entries = [
        F.struct(
            F.lit(r.order).alias("rule_order"), F.lit(r.label).alias("label"),
            F.lit(r.value_column).alias("value_column"), values[r.value_column].alias("observed_value"),
            F.lit(r.operator).alias("operator"), F.lit(float(r.threshold)).alias("threshold"),
            F.lit(r.unit).alias("unit"), r.passes(values[r.value_column]).alias("passed"),
        )
        for r in ordered
    ]
    long = df.select(*id_cols, F.explode(F.array(*entries)).alias("_r")).select(*id_cols, "_r.*")
    passes = [r.passes(values[r.value_column]) for r in ordered]
    count = F.lit(0)
    for p in passes:
        count = count + p.cast("int")
    failed = F.array_compact(F.array(*[F.when(~p, r.label) for p, r in zip(passes, ordered)]))
    wide = df.withColumns(
        {
            "pass_count": count,
            "failed_labels": F.array_join(failed, ";"),
            "pass_all_filters": count == len(ordered),
        }
    )
    return long, wide


def reconcile_flags(df: DataFrame, id_cols: Sequence[str], pairs: dict[str, Column]) -> DataFrame:
    """Rows whose reported flag differs from the recomputed one."""
    entries = [
        F.struct(
            F.lit(name).alias("flag"), F.col(name).alias("reported"),
            F.coalesce(cond, F.lit(False)).alias("recomputed"),
        )
        for name, cond in pairs.items()
    ]
    rows = df.select(*id_cols, F.explode(F.array(*entries)).alias("_f")).select(*id_cols, "_f.*")
    return rows.filter(~F.col("reported").eqNullSafe(F.col("recomputed")))


def first_reason(
    df: DataFrame, reasons: Sequence[tuple[Column, str]], default: str = "SELECTED",
    name: str = "first_exclusion_reason",
) -> DataFrame:
    """Label of the first condition that holds."""
    out = None
    for cond, label in reasons:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return df.withColumn(name, out.otherwise(default) if out is not None else F.lit(default))


def classify(col, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first regular expression that matches a path or name."""
    text = F.col(col) if isinstance(col, str) else col
    out = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def forbid_markers(df: DataFrame, cols: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Rows where any column contains a marker, upper or lower case (P10)."""
    text = F.lower(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    return df.filter(text.rlike("|".join(re.escape(m.lower()) for m in markers)))


# Labels and patterns of content that must not be published.
SENSITIVE_PATTERNS = {
    "macOS absolute home path": r"/Users/[^/\s<]+/",
    "Windows absolute home path": r"[A-Za-z]:\\Users\\[^\\\s<]+\\",
    "GitHub token": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "OpenAI-style secret": r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}",
    "AWS access key": r"AKIA[0-9A-Z]{16}",
    "private key block": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def scan_patterns(df: DataFrame, id_cols: Sequence[str], text: str, patterns: dict[str, str] = SENSITIVE_PATTERNS) -> DataFrame:
    """One row per text and matching label, over the whole text."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns.items()]))
    return df.select(*id_cols, F.explode(hits).alias("label"))


@dataclass(frozen=True)
class FilePolicy:
    """Limits a file inventory must keep."""

    max_bytes: int = 5 * 1024 * 1024
    blocked_suffixes: tuple[str, ...] = ()
    blocked_segments: tuple[str, ...] = ()
    restricted_suffix: str | None = None
    allowed_prefix: str | None = None
    dated_segment: str | None = None
    date_token: str = r"20\d{6}"


# Suffixes and path segments refused by the default policy.
DEFAULT_POLICY = FilePolicy(
    blocked_suffixes=(
        ".ckpt", ".pt", ".pth", ".safetensors", ".npy", ".npz", ".pkl", ".pickle", ".parquet",
        ".h5", ".hdf5", ".tgz", ".sqlite", ".db", ".so", ".dylib", ".pem", ".key", ".p12", ".pfx",
    ),
    blocked_segments=(
        "env", ".venv", "venv", "site-packages", "node_modules", "runtime_cache", "checkpoints",
        "runs", "snapshots", "outputs", "logs", "vendor", "__pycache__", ".ipynb_checkpoints",
        ".codex_artifacts",
    ),
)


def policy_check(inventory: DataFrame, policy: FilePolicy = DEFAULT_POLICY, path: str = "path", size: str = "bytes") -> DataFrame:
    """One row per file and broken rule, with the detail that broke it."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1))
    segments = F.split(p, "/")
    blocked = F.array_sort(F.array_distinct(F.array_intersect(segments, F.array(*[F.lit(s) for s in policy.blocked_segments]).cast("array<string>"))))
    rules = [
        ("size_limit", F.col(size) > policy.max_bytes, F.col(size).cast("string")),
        ("blocked_suffix", suffix.isin(*policy.blocked_suffixes), suffix),
        ("blocked_segment", F.size(blocked) > 0, F.array_join(blocked, ", ")),
    ]
    if policy.restricted_suffix:
        inside = p.startswith(policy.allowed_prefix or "")
        rules.append(("outside_allowed_prefix", (suffix == policy.restricted_suffix) & ~inside, suffix))
    if policy.dated_segment:
        stem = F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")
        undated = F.array_contains(segments, policy.dated_segment) & ~stem.rlike(policy.date_token)
        rules.append(("missing_date", undated, name))
    hits = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, cond, detail in rules
    ]))
    return inventory.select(p.alias("path"), F.explode(hits).alias("_v")).select("path", "_v.*")


def allowlist(df: DataFrame, condition: Column, level: str, wording: dict[str, str], name: str = "condition_text") -> DataFrame:
    """Rows the condition admits whose level has a wording, with that wording."""
    table = F.create_map(*[F.lit(x) for kv in wording.items() for x in kv])
    return df.filter(condition & F.col(level).isin(*wording)).withColumn(name, table[F.col(level)])


def find_reports(df: DataFrame, text_cols: Sequence[str], query: str, group_col: str | None = None, group: str | None = None) -> DataFrame:
    """Rows whose joined text holds the trimmed query, in any letter case, inside a group.

    ``group_col`` holds one group or an array of groups, of which the asked one must be a member.
    """
    joined = F.lower(F.concat_ws(" ", *text_cols))
    out = df.filter(joined.contains(query.strip().lower()))
    if group_col is not None and group not in (None, "all"):
        many = isinstance(df.schema[group_col].dataType, T.ArrayType)
        out = out.filter(F.array_contains(group_col, group) if many else F.col(group_col) == group)
    return out


def report_counts(df: DataFrame, text_cols: Sequence[str], query: str, group_col: str, groups: Sequence[str]) -> DataFrame:
    """How many rows ``find_reports`` gives for each of ``groups``, 0 included, and for ``all``."""
    found = find_reports(df, text_cols, query)
    many = isinstance(df.schema[group_col].dataType, T.ArrayType)
    inside = [F.array_contains(group_col, g) if many else F.col(group_col) == g for g in groups]
    counts = found.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate([*inside, F.lit(True)])])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(g).alias("group_name"), F.col(f"n{k}").alias("result_count")) for k, g in enumerate([*groups, "all"])])))


def intake_sequences(df: DataFrame, seen: DataFrame, seq: str, score: str, forbidden: str, order: Sequence[str]) -> DataFrame:
    """New sequences free of forbidden letters, the last row of each kept, best score first."""
    clean = df.filter(~F.col(seq).rlike(f"[{re.escape(forbidden)}]"))
    fresh = clean.join(seen.select(seq).distinct(), seq, "left_anti")
    last = F.max_by(F.struct(*[c for c in df.columns if c != seq]), F.struct(*order))
    kept = fresh.groupBy(seq).agg(last.alias("_row")).select(seq, "_row.*").select(*df.columns)
    return kept.orderBy(F.col(score).asc_nulls_last(), *[F.col(c) for c in order], F.col(seq))


def round_robin(df: DataFrame, order: Sequence, panel: Sequence[str], name: str = "member") -> DataFrame:
    """Item n goes to panel member ``(n - 1) % size``."""
    numbered = number_rows(df, [], order, "item_no")
    members = F.array(*[F.lit(m) for m in panel])
    return numbered.withColumn(name, F.element_at(members, (F.pmod(F.col("item_no") - 1, F.lit(len(panel))) + 1).cast("int")))
