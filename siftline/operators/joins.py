"""Joins: lookups, reconciliation, task matrix, near pairs, prefixes, patterns, chains."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.clean import semantic_equal
from siftline.operators.ordered import number_rows
from siftline.session import literal_rows


def enrich(df: DataFrame, dim: DataFrame, key, how: str = "left") -> DataFrame:
    """Lookup join (J1, J2). Spark broadcasts the dimension when its size allows."""
    return df.join(dim, key, how)


def missing_keys(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Rows of ``a`` without a partner in ``b``."""
    return a.join(b, key, "left_anti")


def only_needed(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Rows of ``a`` with a partner in ``b``."""
    return a.join(b, key, "left_semi")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], mapping: dict[str, str],
              rel: float = 1e-7, absolute: float = 1e-5) -> DataFrame:
    """Field-by-field differences of two tables, one row per key and field."""
    left = a.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(c).cast("string").alias(f"_l_{c}") for c in mapping],
                    F.lit(True).alias("_in_a"))
    right = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys],
                     *[F.col(c).cast("string").alias(f"_r_{f}") for f, c in mapping.items()], F.lit(True).alias("_in_b"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    both = left.join(right, cond, "full_outer")
    no_text = F.lit(None).cast("string")

    def row(field: Column, lhs: Column, rhs: Column, kind: str) -> Column:
        return F.struct(field.alias("field"), lhs.alias("left_value"), rhs.alias("right_value"), F.lit(kind).alias("kind"))

    found = [
        F.when(F.col("_in_b").isNull(), row(F.lit("*"), no_text, no_text, "missing_right")),
        F.when(F.col("_in_a").isNull(), row(F.lit("*"), no_text, no_text, "missing_left")),
    ] + [
        F.when(
            F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
            & ~semantic_equal(f"_l_{c}", f"_r_{c}", rel, absolute),
            row(F.lit(c), F.col(f"_l_{c}"), F.col(f"_r_{c}"), "different"),
        )
        for c in mapping
    ]
    return both.select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], F.explode(F.array_compact(F.array(*found))).alias("_d")
    ).select(*keys, "_d.*")


def cross_matrix(items: DataFrame, panel: DataFrame, panel_order: Sequence, task_id: Column, name: str = "task_id") -> DataFrame:
    """Every item paired with every panel member.

    The panel members are numbered; each item is expanded to the numbers 1..size and joined back
    to the panel by number, so the plan is a generator and an equi-join at any panel size.
    """
    numbered = number_rows(panel, [], panel_order, "panel_no")
    size = panel.select(F.count(F.lit(1)).alias("n")).scalar()
    slots = items.withColumn("panel_no", F.explode(F.when(size > 0, F.sequence(F.lit(1).cast("long"), size))))
    return slots.join(numbered, "panel_no").withColumn(name, task_id)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_on: Sequence[str], limit: int = 20_000) -> DataFrame:
    """Equi-join that splits crowded keys of the left side.

    Keys with more than ``limit`` left rows are listed with their number of salts; left rows take
    one salt, right rows of these keys are copied to each. Other keys are joined as they are.
    """
    crowded = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("long").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    spread = left.join(crowded, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_on), salts)).drop("_salts")
    copied = right.join(crowded, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    ).drop("_salts")
    # Sides are often copied to many cells before, which their estimated sizes don't show; none is broadcast.
    return spread.join(copied.hint("merge"), [*keys, "_salt"]).drop("_salt")


def _cell(value: Column, width: float) -> Column:
    """Number of the cell of a finite value. Where doubles lie farther apart than cells are wide, each has its own."""
    place = value / F.lit(width)
    return F.when(F.abs(place) < 2.0**53, F.floor(place)).otherwise(F.shiftright(F.xxhash64(place), 2)).cast("long")


def near_pairs(df: DataFrame, id_col: str, value: str, radius: float, block: Sequence[str] = (), carry: Sequence[str] = (),
               limit: int = 20_000) -> DataFrame:
    """Pairs a < b inside a block whose values differ by at most ``radius``.

    Values fall into bands as wide as the radius; a row meets its own and the next band only, so
    the work follows the number of pairs found and not the square of the block. Missing and
    non-finite values are in no pair.
    """
    df = df.filter(F.abs(F.col(value).cast("double")) < float("inf"))
    band = _cell(F.col(value), radius)
    keep = [id_col, value, *carry]
    a = df.select(*block, *[F.col(c).alias(f"{c}_a") for c in keep], F.explode(F.array(band, band + 1)).alias("_band"), band.alias("_home"))
    b = df.select(*block, *[F.col(c).alias(f"{c}_b") for c in keep], band.alias("_band"))
    pairs = salted_join(a, b, [*block, "_band"], [f"{id_col}_a"], limit)
    dist = F.abs(F.col(f"{value}_a") - F.col(f"{value}_b"))
    # Same band: keep one orientation. Next band: a is always the lower value.
    once = (F.col("_home") < F.col("_band")) | (F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))
    pairs = pairs.filter((dist <= radius) & once & (F.col(f"{id_col}_a") != F.col(f"{id_col}_b")))
    swap = F.col(f"{id_col}_a") > F.col(f"{id_col}_b")
    ordered = []
    for c in keep:
        ordered.append(F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"))
        ordered.append(F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b"))
    return pairs.select(*block, *ordered, dist.alias("difference"))


def range_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], xyz: Sequence[str], cutoff: float,
                carry_a: Sequence[str], carry_b: Sequence[str], limit: int = 20_000) -> DataFrame:
    """Points of ``a`` and ``b`` no farther apart than ``cutoff``, within equal keys.

    Space is cut into cells as wide as the cutoff; ``b`` is copied to the 27 cells around its own
    and the exact distance is tested after an equi-join on the cell, crowded cells being salted.
    Points with a missing or non-finite coordinate are in no pair.
    """
    placed = F.lit(True)
    for c in xyz:
        placed = placed & (F.abs(F.col(c).cast("double")) < float("inf"))
    a, b = a.filter(placed), b.filter(placed)
    cells = [_cell(F.col(c), cutoff) for c in xyz]
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in (*xyz, *carry_a)], *[g.alias(f"_c{i}") for i, g in enumerate(cells)])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in (*xyz, *carry_b)], *[g.alias(f"_g{i}") for i, g in enumerate(cells)])
    for i in range(3):
        right = right.withColumn(f"_d{i}", F.explode(around)).withColumn(f"_c{i}", F.col(f"_g{i}") + F.col(f"_d{i}")).drop(f"_d{i}", f"_g{i}")
    squared = sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in xyz), F.lit(0.0))
    joined = salted_join(left, right, [*keys, "_c0", "_c1", "_c2"], [f"{c}_a" for c in carry_a], limit)
    return joined.filter(squared <= cutoff**2).drop("_c0", "_c1", "_c2").withColumn("distance", F.sqrt(squared))


def path_prefixes(path: Column) -> Column:
    """All whole-segment prefixes of a path, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(df: DataFrame, id_col: str, path: str, prefixes: DataFrame, prefix: str, carry: Sequence[str]) -> DataFrame:
    """Longest listed prefix on a path boundary.

    Paths are expanded to their own prefixes and joined by equality; only (id, prefix) travels.
    """
    keys = df.select(id_col, F.explode(path_prefixes(F.col(path))).alias("_p"))
    hits = keys.join(prefixes.select(F.col(prefix).alias("_p"), *carry), "_p")
    best = hits.groupBy(id_col).agg(F.max_by(F.struct(F.col("_p").alias(prefix), *carry), F.length("_p")).alias("_b"))
    return df.join(best, id_col, "left").select(*df.columns, "_b.*")


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob; ``*`` and ``?`` stay inside one segment."""
    out = []
    for ch in re.split(r"(\*\*/|\*|\?)", pattern):
        out.append({"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch)))
    return "^" + "".join(out) + "$"


def match_patterns(df: DataFrame, path: str, patterns: dict[str, str], name: str = "pattern_id") -> DataFrame:
    """One row per path and glob it matches (J10); patterns travel inside the plan."""
    hits = F.array_compact(F.array(*[
        F.when(F.col(path).rlike(glob_regex(glob)), F.lit(key)) for key, glob in patterns.items()
    ]))
    return df.withColumn(name, F.explode(hits))


def match_counts(matched: DataFrame, expected: dict[str, int], name: str = "pattern_id") -> DataFrame:
    """Matches per pattern against the expected number."""
    want = literal_rows(matched.sparkSession, list(expected.items()), [name, "expected_count"])
    got = matched.groupBy(name).agg(F.count(F.lit(1)).alias("match_count"))
    return want.join(got, name, "left").withColumn("match_count", F.coalesce("match_count", F.lit(0))).withColumn(
        "matches", F.col("match_count") == F.col("expected_count")
    )


def match_endpoints(edges: DataFrame, points: DataFrame, id_col: str, tol: float) -> DataFrame:
    """Do both ends of some edge lie on a candidate's two points, in either direction (J11)?

    ``edges``: id, p1, p2 (point labels) with reference coordinates ax.. and bx..;
    ``points``: id, label, x, y, z. Direct and swapped sums are compared with twice the tolerance.
    """
    def side(n: int) -> DataFrame:
        return points.select(F.col(id_col), F.col("label").alias(f"p{n}"),
                             *[F.col(c).alias(f"{c}{n}") for c in "xyz"])

    both = edges.join(side(1), [id_col, "p1"]).join(side(2), [id_col, "p2"])

    def gap(ref: str, n: int) -> Column:
        return F.sqrt(sum(((F.col(f"{ref}{c}") - F.col(f"{c}{n}")) ** 2 for c in "xyz"), F.lit(0.0)))

    direct = gap("a", 1) + gap("b", 2)
    swapped = gap("a", 2) + gap("b", 1)
    scored = both.withColumn("_best", F.least(direct, swapped))
    return scored.groupBy(id_col).agg(
        F.min("_best").alias("best_distance"), F.max(F.col("_best") <= 2 * tol).alias("matched")
    )


def match_rewritten(df: DataFrame, key: str, old: str, new: str, compare: str) -> DataFrame:
    """Rows under ``old`` against their mirror under ``new``: same hash, other hash or missing."""
    source = df.filter(F.col(key).startswith(old)).withColumn("_mirror", F.concat(F.lit(new), F.substring(key, len(old) + 1, 1 << 30)))
    mirror = df.filter(F.col(key).startswith(new)).select(F.col(key).alias("_mirror"), F.col(compare).alias("_other"), F.lit(True).alias("_found"))
    joined = source.join(mirror, "_mirror", "left")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col(compare).eqNullSafe(F.col("_other")), "same").otherwise("different")
    return joined.select(key, F.col("_mirror").alias("mirror_key"), status.alias("mirror_status"))


def paired(df: DataFrame, stem: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Stems that have every kind of artefact."""
    flags = [F.max((F.col(kind) == k).cast("int")) for k in kinds]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return df.filter(F.col(kind).isin(*kinds)).groupBy(stem).agg(total.alias("_n")).filter(F.col("_n") == len(kinds)).select(stem)


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Base with updated or added columns, and the updates that did not hit exactly one row.

    A key with several updates is only reported; its base rows stay as they are.
    """
    new = updates.groupBy(*key).agg(*[F.first(c).alias(f"_u_{c}") for c in cols], (F.count(F.lit(1)) == 1).alias("_hit")).filter("_hit")
    joined = base.join(new, list(key), "left")
    merged = joined.select(
        *[c for c in base.columns if c not in cols],
        *[
            (F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)) if c in base.columns else F.col(f"_u_{c}")).alias(c)
            for c in cols
        ],
    )
    base_hits = base.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    update_hits = updates.groupBy(*key).agg(F.count(F.lit(1)).alias("update_rows"))
    bad = update_hits.join(base_hits, list(key), "left").select(
        *key, "update_rows", F.coalesce("_rows", F.lit(0)).alias("base_rows")
    ).filter((F.col("base_rows") != 1) | (F.col("update_rows") != 1))
    return merged, bad


def overlap_flag(a: DataFrame, b: DataFrame, key: str, name: str = "in_other") -> DataFrame:
    """Does the other library hold this key (J15)?"""
    marks = b.select(key).distinct().withColumn("_m", F.lit(True))
    return a.join(marks, key, "left").withColumn(name, F.col("_m").isNotNull()).drop("_m")


def deny(df: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows allowed and rows refused by a list of content hashes."""
    keys = listing.select(key)
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def verify_chain(receipts: DataFrame, id_col: str = "receipt_id", digest: str = "sha256", predecessor: str = "predecessor_sha256") -> DataFrame:
    """Each receipt's predecessor hash resolved: ROOT, LINKED, ORPHAN or AMBIGUOUS."""
    known = receipts.groupBy(F.col(digest).alias(predecessor)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("predecessor_id")
    )
    joined = receipts.select(id_col, digest, predecessor).join(known, predecessor, "left")
    status = (
        F.when(F.col(predecessor).isNull(), "ROOT").when(F.col("_n").isNull(), "ORPHAN")
        .when(F.col("_n") > 1, "AMBIGUOUS").otherwise("LINKED")
    )
    return joined.select(id_col, F.when(F.col("_n") == 1, F.col("predecessor_id")).alias("predecessor_id"), status.alias("chain_status"))


def match_by_token(a: DataFrame, b: DataFrame, key: str, name_col: str, regex: str) -> DataFrame:
    """Join ids with file names through the token inside the name."""
    tokens = b.withColumn(key, F.regexp_extract(name_col, regex, 1)).filter(F.col(key) != "")
    return a.join(tokens, key, "inner")


def with_override(df: DataFrame, overrides: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per-key values win over the defaults of the row."""
    marks = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    joined = df.join(marks, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c in cols}).drop(*[f"_o_{c}" for c in cols])

