"""Structures as tables: residues, conformers, contacts, bonds, chains, profiles, rule lists.

Atoms carry a structure id and label columns; every operator groups by structure and residue or
chain, so the work is spread by structure and no structure is handled as one object. Joins on them are
merged: residues and chains grow with the structures, and files of their repeated labels look small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.clean import RESIDUE_LETTERS, bucket, distance3, hydropathy, letters, motif_count, null_token, parse_position
from siftline.operators.joins import range_pairs
from siftline.operators.ranking import best_per_key

# Backbone atom names.
BACKBONE = ("N", "CA", "C", "O")
RESIDUE = ("structure_id", "label_seq_id")


def _has_all(names: Sequence[str], atom: str = "atom_name") -> Column:
    """Aggregate: every name occurs in the group."""
    out = F.lit(True)
    for n in names:
        out = out & (F.max((F.col(atom) == n).cast("int")) == 1)
    return out


def is_heavy(element: str = "element") -> Column:
    return ~F.coalesce(F.upper(F.trim(element)).isin("H", "D"), F.lit(False))


def choose_conformer(atoms: DataFrame, keys: Sequence[str] = RESIDUE) -> DataFrame:
    """One alternative location per residue, and one row per atom name in it.

    Atoms without a location belong to all. Order: backbone complete, total occupancy, location A,
    then the larger location letter; inside it the larger occupancy, then file order.
    """
    alt = F.coalesce(null_token("alt_id"), F.lit(""))
    rows = atoms.withColumn("_alt", alt)
    named = rows.filter("_alt <> ''").groupBy(*keys, "_alt").agg(
        F.sum("occupancy").alias("_occ"), *[F.max((F.col("atom_name") == n).cast("int")).alias(f"_h_{n}") for n in BACKBONE]
    )
    shared = rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("_alt") == "", F.col("occupancy"))).alias("_cocc"),
        *[F.max(((F.col("_alt") == "") & (F.col("atom_name") == n)).cast("int")).alias(f"_c_{n}") for n in BACKBONE],
    )
    complete = F.lit(True)
    for n in BACKBONE:
        complete = complete & (F.greatest(F.col(f"_h_{n}"), F.col(f"_c_{n}")) == 1)
    scored = named.join(shared.hint("merge"), list(keys)).select(
        *keys, "_alt", complete.alias("_complete"), (F.col("_occ") + F.coalesce("_cocc", F.lit(0.0))).alias("_total")
    )
    order = [F.col("_complete").desc(), F.col("_total").desc(), (F.col("_alt") == "A").desc(), F.col("_alt").desc()]
    chosen = best_per_key(scored, list(keys), order).select(*keys, F.col("_alt").alias("selected_altloc"))
    kept = rows.join(chosen.hint("merge"), list(keys), "left").withColumn("selected_altloc", F.coalesce("selected_altloc", F.lit("")))
    kept = kept.filter((F.col("_alt") == "") | (F.col("_alt") == F.col("selected_altloc")))
    # A name left over twice is resolved by occupancy and flagged.
    kept = kept.withColumn("repeated_name", F.count(F.lit(1)).over(Window.partitionBy(*keys, "atom_name")) > 1)
    unique = best_per_key(kept, [*keys, "atom_name"], [F.col("occupancy").desc(), (F.col("_alt") == "").desc(), "line_order"])
    return unique.drop("_alt")


def residue_rollup(atoms: DataFrame, keys: Sequence[str] = RESIDUE, required: Sequence[str] = BACKBONE) -> DataFrame:
    """Atoms to residues: component, completeness, mean occupancy and B factor."""
    return atoms.groupBy(*keys).agg(
        F.min("comp_id").alias("comp_id"), (F.min("comp_id") != F.max("comp_id")).alias("identity_ambiguous"),
        F.count(F.lit(1)).alias("atom_count"), _has_all(required).alias("backbone_complete"),
        F.avg(F.coalesce("occupancy", F.lit(1.0))).alias("mean_occupancy"), F.max(F.col("occupancy").isNull()).alias("occupancy_missing"),
        F.avg(F.coalesce("b_factor", F.lit(0.0))).alias("mean_b_factor"),
    ).withColumn("one_letter", letters("comp_id"))


def structure_profile(atoms: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Counts and completeness of every structure (A21); ``expected``: structure_id, expected_residues."""
    per_residue = atoms.groupBy("structure_id", "model_num", "label_asym_id", "label_seq_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_heavy().cast("long")).alias("heavy"), _has_all(BACKBONE).alias("bb"),
        F.max((F.col("atom_name") == "OXT").cast("int")).alias("oxt"), F.sum((F.coalesce("occupancy", F.lit(1.0)) <= 0).cast("long")).alias("zero"),
        F.sum((F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).cast("long")).alias("lost"),
        F.count_distinct("atom_name").alias("names"),
    )
    per_chain = per_residue.groupBy("structure_id", "model_num", "label_asym_id").agg(
        F.count(F.lit(1)).alias("residues"), *[F.sum(c).alias(c) for c in ("n", "heavy", "zero", "lost", "oxt", "names")],
        F.sum((~F.col("bb")).cast("long")).alias("no_bb"),
    )
    out = per_chain.groupBy("structure_id").agg(
        F.sum("n").alias("atom_count"), F.sum("heavy").alias("heavy_atom_count"), (F.sum("n") - F.sum("heavy")).alias("hydrogen_count"),
        F.count_distinct("model_num").alias("model_count"), F.count_distinct("label_asym_id").alias("chain_count"),
        F.sum("residues").alias("residue_count"), F.sum("no_bb").alias("missing_backbone_count"), F.sum("oxt").alias("terminal_oxt_count"),
        F.sum("zero").alias("zero_occupancy_count"), F.sum("lost").alias("bad_coordinate_count"),
        (F.sum("n") == F.sum("names")).alias("atom_names_unique"),
    )
    if expected is None:
        return out
    return out.join(expected, "structure_id", "left").withColumn("coverage", F.try_divide(F.col("residue_count"), F.col("expected_residues")))


def bond_pairs(atoms: DataFrame, lo: float, hi: float, atom: str = "SG", comp: str = "CYS") -> DataFrame:
    """Pairs of bonding atoms of one structure no farther apart than ``hi``, numbered."""
    ends = atoms.filter((F.col("comp_id") == comp) & (F.col("atom_name") == atom)).select("structure_id", "label_seq_id", "x", "y", "z")
    pairs = range_pairs(ends, ends, ["structure_id"], ["x", "y", "z"], hi, ["label_seq_id"], ["label_seq_id"])
    pairs = pairs.filter(F.col("label_seq_id_a") < F.col("label_seq_id_b")).select(
        "structure_id", F.col("label_seq_id_a").alias("p1_label_seq_id"), F.col("label_seq_id_b").alias("p2_label_seq_id"),
        F.col("distance").alias("distance_a"), (F.col("distance") >= lo).alias("in_range"),
    )
    w = Window.partitionBy("structure_id").orderBy("p1_label_seq_id", "p2_label_seq_id")
    return pairs.withColumn("conn_id", F.concat(F.lit("disulf"), F.row_number().over(w).cast("string")))


def bond_rules(bonds: DataFrame, residues: DataFrame, canonical: tuple[str, str]) -> DataFrame:
    """Rule rows for bonds other than the canonical pair: hard inside a design region, else soft."""
    def side(n: int) -> DataFrame:
        return residues.select("structure_id", F.col("label_seq_id").alias(f"p{n}_label_seq_id"),
                               F.col("position").alias(f"position_{n}"), F.col("region").alias(f"region_{n}"))

    both = bonds.join(side(1).hint("merge"), ["structure_id", "p1_label_seq_id"]).join(side(2).hint("merge"), ["structure_id", "p2_label_seq_id"])
    is_canonical = F.col("position_1").isin(*canonical) & F.col("position_2").isin(*canonical)
    inside = F.col("region_1").startswith("CDR") | F.col("region_2").startswith("CDR")
    return both.filter(~is_canonical).select(
        "structure_id", F.when(inside, "extra_disulfide_involves_design_region").otherwise("extra_framework_disulfide").alias("rule_id"),
        F.when(inside, "hard").otherwise("soft").alias("severity"),
        F.array_join(F.array_sort(F.array("position_1", "position_2")), "|").alias("detail"),
    )


def identify_chain(chains: DataFrame, known: str, name: str = "target_chain") -> DataFrame:
    """The chain whose sequence is exactly the known one; none or several is reported."""
    return chains.groupBy("structure_id").agg(
        F.sum((F.col("sequence") == known).cast("long")).alias("matches"), F.min(F.when(F.col("sequence") == known, F.col("label_asym_id"))).alias("_c"),
        F.count(F.lit(1)).alias("chain_count"),
    ).select(
        "structure_id", "chain_count", F.when(F.col("matches") == 1, F.col("_c")).alias(name),
        F.when(F.col("matches") == 1, "OK").when(F.col("matches") == 0, "MISSING").otherwise("AMBIGUOUS").alias("status"),
    )


def chain_sequences(residues: DataFrame) -> DataFrame:
    """One-letter sequence per chain in residue order; a chain is bounded by its numbering."""
    parts = F.array_sort(F.collect_list(F.struct("label_seq_id", "one_letter")))
    return residues.groupBy("structure_id", "label_asym_id").agg(
        F.array_join(F.transform(parts, lambda p: p["one_letter"]), "").alias("sequence"), F.count(F.lit(1)).alias("residue_count")
    )


def hotspot_contacts(atoms: DataFrame, targets: DataFrame, design: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Smallest heavy-atom and CA distances of each target residue to the design residues.

    ``targets`` and ``design`` name residues by (structure_id, label_asym_id, label_seq_id). The
    few named target atoms of a structure travel as an array to its design atoms, which stay where
    they are; the minima are combined before the shuffle.
    """
    heavy = atoms.filter(is_heavy() & (F.coalesce("occupancy", F.lit(1.0)) > 0))
    keys = ["structure_id", "label_asym_id", "label_seq_id"]
    is_ca = (F.col("atom_name") == "CA").alias("ca")
    spots = heavy.join(targets.select(*keys), keys, "left_semi").groupBy("structure_id").agg(
        F.collect_list(F.struct("label_asym_id", "label_seq_id", is_ca, "x", "y", "z")).alias("_spots")
    )
    near = heavy.join(design.select(*keys), keys, "left_semi").select("structure_id", is_ca, "x", "y", "z").join(spots, "structure_id")
    squared = lambda s: (s["x"] - F.col("x")) ** 2 + (s["y"] - F.col("y")) ** 2 + (s["z"] - F.col("z")) ** 2
    scored = near.select("structure_id", "ca", F.inline(F.transform("_spots", lambda s: F.struct(
        s["label_asym_id"].alias("label_asym_id"), s["label_seq_id"].alias("label_seq_id"), s["ca"].alias("spot_ca"), squared(s).alias("d")
    ))))
    out = scored.groupBy(*keys).agg(
        F.sqrt(F.min("d")).alias("min_heavy_atom_distance"), F.sqrt(F.min(F.when(F.col("ca") & F.col("spot_ca"), F.col("d")))).alias("min_ca_distance")
    )
    return out.withColumns({
        "heavy_atom_covered": F.col("min_heavy_atom_distance") < cutoff, "ca_covered": F.coalesce(F.col("min_ca_distance") < cutoff, F.lit(False)),
    })


def hotspot_coverage(contacts: DataFrame) -> DataFrame:
    """Covered share of the target residues per structure."""
    return contacts.groupBy("structure_id").agg(
        F.avg(F.col("heavy_atom_covered").cast("double")).alias("heavy_coverage"), F.avg(F.col("ca_covered").cast("double")).alias("ca_coverage")
    )


def contact_count(atoms: DataFrame, target_chain: str, binder_chain: str, n: int = 2, cutoff: float = 5.0) -> DataFrame:
    """How many of the first n target residues have a binder heavy atom within the cutoff.

    0 for a structure with fewer than n target residues or without binder atoms.
    """
    heavy = atoms.filter(~F.col("atom_name").startswith("H"))
    chain, point = F.col("label_asym_id"), F.struct("x", "y", "z")
    placed = lambda p: (F.abs(p["x"].cast("double")) < float("inf")) & (F.abs(p["y"].cast("double")) < float("inf")) & (F.abs(p["z"].cast("double")) < float("inf"))
    residues = heavy.filter(chain == target_chain).groupBy("structure_id", "label_seq_id").agg(
        F.min(F.struct("line_order")).alias("_first"), F.collect_list(F.when(placed(point), point)).alias("_points")
    )
    w = Window.partitionBy("structure_id").orderBy("_first", "label_seq_id")
    lead = residues.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= n).groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("_n"), F.collect_list(F.when(F.col("label_seq_id").isNotNull(), F.struct("_no", "_points"))).alias("_lead")
    ).filter(F.col("_n") >= n)
    # The few lead residues of a structure travel to its binder atoms, which are moved once and never copied.
    binder = heavy.filter((chain == binder_chain) & placed({c: F.col(c) for c in "xyz"})).select("structure_id", "x", "y", "z")
    squared = lambda p: (p["x"] - F.col("x")) ** 2 + (p["y"] - F.col("y")) ** 2 + (p["z"] - F.col("z")) ** 2
    touched = F.transform(F.filter("_lead", lambda r: F.exists(r["_points"], lambda p: squared(p) <= cutoff**2)), lambda r: r["_no"])
    hits = binder.join(lead.select("structure_id", "_lead").hint("merge"), "structure_id").select("structure_id", F.explode(touched).alias("_no"))
    hits = hits.distinct().groupBy("structure_id").agg(F.count(F.lit(1)).alias("_hits"))
    every = atoms.select("structure_id").distinct()
    return every.join(hits, "structure_id", "left").select("structure_id", F.coalesce("_hits", F.lit(0)).cast("long").alias("contact_count"))


def max_coordinate_error(a: DataFrame, b: DataFrame, keys: Sequence[str], tol: float = 5e-4) -> DataFrame:
    """Largest coordinate difference per structure, and whether both hold the same atoms."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_l") for c in "xyz"], F.lit(1).alias("_l"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_r") for c in "xyz"], F.lit(1).alias("_r"))
    both = left.join(right, list(keys), "full_outer")
    worst = F.greatest(*[F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")) for c in "xyz"])
    return both.groupBy("structure_id").agg(
        F.max(worst).alias("max_error"), F.sum((F.col("_l").isNull() | F.col("_r").isNull()).cast("long")).alias("unpaired_atoms")
    ).withColumn("agrees", F.coalesce((F.col("max_error") <= tol) & (F.col("unpaired_atoms") == 0), F.lit(False)))


@dataclass(frozen=True)
class DomainSpec:
    """Numbering and thresholds of one domain type; all values come from configuration."""

    first: int = 1
    last: int = 128
    regions: dict = field(default_factory=dict)
    required_anchors: tuple[int, ...] = ()
    canonical: tuple[int, int] = (23, 104)
    canonical_distance: tuple[float, float] = (1.8, 2.5)
    peptide_bond: tuple[float, float] = (1.0, 1.8)
    allowed_residues: tuple[str, ...] = tuple(RESIDUE_LETTERS)
    length_range: tuple[int, int] = (0, 10_000)
    max_first: int = 10_000
    min_last: int = -10_000
    occupancy_hard: float = 0.5
    occupancy_soft: float = 0.7


def choose_chain(atoms: DataFrame, wanted: DataFrame, spec: DomainSpec) -> DataFrame:
    """The chain of each structure that carries the domain; ties are ambiguous.

    ``wanted``: structure_id, chain. Order: exact author name, anchors present, residues in range.
    """
    base = parse_position("auth_seq_id", "ins_code")["base"]
    rows = atoms.join(wanted.hint("merge"), "structure_id").filter((F.col("label_asym_id") == F.col("chain")) | (F.col("auth_asym_id") == F.col("chain")))
    inside = rows.withColumn("_base", base).withColumn("_in", F.coalesce(F.col("_base").between(spec.first, spec.last), F.lit(False)))
    anchors = F.lit(0)
    for a in spec.required_anchors:
        anchors = anchors + F.max((F.col("_in") & (F.col("_base") == a)).cast("int"))
    score = inside.groupBy("structure_id", "label_asym_id", "auth_asym_id").agg(
        F.max((F.col("auth_asym_id") == F.col("chain")).cast("int")).alias("_exact"), anchors.alias("_anchors"),
        F.count_distinct(F.when(F.col("_in"), F.col("label_seq_id"))).alias("_residues"),
    )
    w = Window.partitionBy("structure_id").orderBy(F.desc("_exact"), F.desc("_anchors"), F.desc("_residues"))
    top = score.withColumn("_rank", F.rank().over(w)).filter("_rank = 1")
    found = top.groupBy("structure_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("label_asym_id", "auth_asym_id")).alias("_c"))
    out = wanted.join(found.hint("merge"), "structure_id", "left")
    status = F.when(F.col("_n").isNull(), "hchain_not_found").when(F.col("_n") > 1, "ambiguous_hchain_mapping").otherwise("OK")
    return out.select("structure_id", F.when(F.col("_n") == 1, F.col("_c.label_asym_id")).alias("label_asym_id"), status.alias("status"))


def _domain_rows(atoms: DataFrame, chains: DataFrame, model: int) -> DataFrame:
    """Polymer atoms of the chosen chains in one model, with their parsed positions."""
    picked = chains.filter("status = 'OK'").select("structure_id", "label_asym_id")
    # An absent group or model number does not exclude an atom.
    polymer = F.coalesce(F.col("group_PDB"), F.lit("ATOM")) == "ATOM"
    in_model = F.coalesce(F.col("model_num"), F.lit(model)) == model
    rows = atoms.filter(polymer & in_model & F.col("label_seq_id").isNotNull()).join(picked.hint("merge"), ["structure_id", "label_asym_id"])
    return rows.withColumn("_pos", parse_position("auth_seq_id", "ins_code"))


def _identities(rows: DataFrame) -> DataFrame:
    """Per residue: its position, and whether component and position are unique."""
    return rows.groupBy(*RESIDUE).agg(
        F.min("_pos").alias("_p"), ((F.min("comp_id") == F.max("comp_id")) & (F.min("_pos") == F.max("_pos"))).alias("_unique")
    )


def identity_problems(atoms: DataFrame, chains: DataFrame, model: int = 1) -> DataFrame:
    """Rule rows for residues with several components or positions, or none."""
    bad = _identities(_domain_rows(atoms, chains, model)).filter(~F.coalesce("_unique", F.lit(False)))
    return bad.select(
        "structure_id", F.lit("residue_identity_ambiguous").alias("rule_id"), F.lit("hard").alias("severity"),
        F.concat(F.lit("label_seq="), F.col("label_seq_id").cast("string")).alias("detail"),
    )


def normalize_domain(atoms: DataFrame, chains: DataFrame, spec: DomainSpec, model: int = 1) -> tuple[DataFrame, DataFrame]:
    """Domain atoms with one conformer and 1..N numbering, and the residue map.

    The residue map also carries the C, N and SG points of each residue, which the rules need.
    """
    rows = _domain_rows(atoms, chains, model)
    inside = _identities(rows).filter("_unique").select(*RESIDUE, F.col("_p.base").alias("base"), F.col("_p.insertion").alias("insertion"))
    inside = inside.filter(F.col("base").between(spec.first, spec.last))
    filled = rows.drop("_pos").join(inside.hint("merge"), list(RESIDUE)).withColumns({
        "occupancy_missing": F.col("occupancy").isNull(), "occupancy": F.coalesce("occupancy", F.lit(1.0)), "b_factor": F.coalesce("b_factor", F.lit(0.0)),
    })
    one = choose_conformer(filled)
    lost = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    origin = (F.abs("x") < 1e-8) & (F.abs("y") < 1e-8) & (F.abs("z") < 1e-8)
    point = lambda name: F.max(F.when(F.col("atom_name") == name, F.struct("x", "y", "z"))).alias(f"point_{name}")
    residues = one.groupBy(*RESIDUE, "label_asym_id", "base", "insertion", "selected_altloc").agg(
        F.min("comp_id").alias("comp_id"), _has_all(BACKBONE).alias("backbone_complete"), F.avg("occupancy").alias("mean_occupancy"),
        F.max("occupancy_missing").alias("occupancy_missing"), F.avg("b_factor").alias("mean_b_factor"),
        F.sum(is_heavy().cast("long")).alias("kept_atom_count"), F.max("repeated_name").alias("repeated_name"),
        F.max(lost | origin).alias("bad_coordinate"), point("C"), point("N"), point("SG"),
    ).withColumns({
        "position": F.concat(F.col("base").cast("string"), F.col("insertion")), "region": bucket("base", spec.regions, "OUTSIDE_VARIABLE"),
        "one_letter": letters("comp_id"),
    })
    w = Window.partitionBy("structure_id").orderBy("label_seq_id")  # at most one residue per position and insertion
    residue_map = residues.withColumn("ordinal", F.row_number().over(w))
    numbers = residue_map.select(*RESIDUE, F.col("ordinal").alias("normalized_label_seq_id"), "position", "region")
    return one.filter(is_heavy()).join(numbers.hint("merge"), list(RESIDUE)), residue_map


def structure_qc(residues: DataFrame, spec: DomainSpec) -> DataFrame:
    """Rule rows (structure_id, rule_id, severity, detail) of every structure.

    Neighbours are compared in one window and all rules of a structure come from one aggregation;
    its lists hold at most the residues of one domain.
    """
    w = Window.partitionBy("structure_id").orderBy("label_seq_id")
    rows = residues.withColumns({
        "_seq": F.lag("label_seq_id").over(w), "_pos": F.lag("position").over(w), "_c": F.lag("point_C").over(w),
        "_same": F.count(F.lit(1)).over(Window.partitionBy("structure_id", "position")),
    })
    gap = F.coalesce(F.col("label_seq_id") != F.col("_seq") + 1, F.lit(False))
    d = distance3("_c.x", "_c.y", "_c.z", "point_N.x", "point_N.y", "point_N.z")
    broken = F.col("_seq").isNotNull() & ~gap & F.coalesce(~d.between(*spec.peptide_bond), F.lit(False))
    arrow = F.concat("_pos", F.lit("->"), "position")
    framework, design, occ = F.col("region").startswith("FR"), F.col("region").startswith("CDR"), F.col("mean_occupancy")
    low, soft = spec.occupancy_hard, spec.occupancy_soft

    def listed(cond: Column, text: Column, limit: int, key: str = "label_seq_id") -> Column:
        """First members in residue order as text, NULL when there is none."""
        few = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.when(cond, F.struct(F.col(key).alias("k"), text.alias("t")))))), 1, limit)
        return F.when(F.size(few) > 0, F.array_join(F.transform(few, lambda e: e["t"]), ","))

    lists = {
        ("duplicate_imgt_position", "hard"): listed(F.col("_same") > 1, F.col("position"), 12, "base"),
        ("framework_backbone_incomplete", "hard"): listed(framework & ~F.col("backbone_complete"), F.col("position"), 12),
        ("design_region_backbone_incomplete", "hard"): listed(design & ~F.col("backbone_complete"), F.col("position"), 12),
        (f"residue_mean_occupancy_below_{low:g}", "hard"): listed(occ < low, F.col("position"), 12),
        (f"residue_mean_occupancy_below_{soft:g}", "soft"): listed((occ >= low) & (occ < soft), F.col("position"), 12),
        ("unresolved_sequence_gap", "hard"): listed(gap, arrow, 8),
        ("peptide_bond_break", "hard"): listed(broken, F.concat(arrow, F.lit(":"), F.format_string("%.3f", d)), 8),
        ("nonstandard_variable_residue", "hard"): listed(~F.col("comp_id").isin(*spec.allowed_residues), F.col("comp_id"), 1 << 20, "comp_id"),
    }
    flags = {
        ("invalid_or_zero_coordinates", "hard"): F.max("bad_coordinate"),
        ("duplicate_atom_name_resolved_by_occupancy", "soft"): F.max("repeated_name"),
        ("atom_occupancy_missing_assumed_1.0", "soft"): F.max("occupancy_missing"),
        ("altloc_residue_conformer_selected", "soft"): F.max(F.col("selected_altloc") != ""),
        ("struct_conn_reconstructed_from_geometry", "soft"): F.count(F.lit(1)) > 0,
    }
    anchors = F.array_sort(F.array_except(F.array(*[F.lit(a) for a in spec.required_anchors]).cast("array<int>"), F.collect_set("base")))
    ends = []
    for i, b in enumerate(spec.canonical):
        there = (F.col("base") == b) & (F.col("insertion") == "")
        ends += [F.max(F.when(there, F.col("comp_id"))).alias(f"c{i}"), F.max(F.when(there, F.col("point_SG"))).alias(f"s{i}")]
    stats = rows.groupBy("structure_id").agg(
        *[c.alias(f"_l{i}") for i, c in enumerate(lists.values())], *[c.alias(f"_f{i}") for i, c in enumerate(flags.values())],
        anchors.alias("_anchors"), F.count(F.lit(1)).alias("_length"), F.min("base").alias("_first"), F.max("base").alias("_last"), *ends,
    )
    ss = distance3("s0.x", "s0.y", "s0.z", "s1.x", "s1.y", "s1.z")
    bond = (
        F.when(F.col("c0").isNull() | F.col("c1").isNull(), "canonical_disulfide_positions_missing")
        .when((F.col("c0") != "CYS") | (F.col("c1") != "CYS"), "canonical_imgt_23_104_not_cysteine")
        .when(ss.isNull(), "canonical_disulfide_sg_missing").when(~ss.between(*spec.canonical_distance), "canonical_disulfide_distance_invalid")
    )
    bond_detail = F.when(bond == "canonical_disulfide_distance_invalid", F.format_string("%.3f", ss)).otherwise("")
    text = lambda c: c.cast("string")
    n, first, last = F.col("_length"), F.col("_first"), F.col("_last")

    def rule(cond: Column, name, severity: str, detail: Column) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        return F.when(cond, F.struct(label.alias("rule_id"), F.lit(severity).alias("severity"), detail.alias("detail")))

    found = [rule(F.col(f"_l{i}").isNotNull(), name, sev, F.col(f"_l{i}")) for i, (name, sev) in enumerate(lists)]
    found += [rule(F.col(f"_f{i}"), name, sev, F.lit("")) for i, (name, sev) in enumerate(flags)]
    found += [
        rule(F.size("_anchors") > 0, "missing_imgt_anchors", "hard", F.array_join(F.col("_anchors").cast("array<string>"), ",")),
        rule(~n.between(*spec.length_range), "variable_length_out_of_range", "hard", text(n)),
        rule(first > spec.max_first, "n_terminal_framework_truncated", "hard", F.concat(F.lit("first_imgt="), text(first))),
        rule(last < spec.min_last, "c_terminal_framework_truncated", "hard", F.concat(F.lit("last_imgt="), text(last))),
        rule(bond.isNotNull(), bond, "hard", bond_detail),
    ]
    return stats.select("structure_id", F.inline(F.array_compact(F.array(*found))))


# Limits of the soft flags on a framework sequence.
PI_RANGE, HYDROPATHY_LIMIT, MOTIF_LIMIT = (5.5, 9.5), 0.2, 5


def sequence_flags(residues: DataFrame, pi: str | None = None) -> DataFrame:
    """Soft rule rows from the framework sequence of each structure.

    ``pi``: a column with the predicted isoelectric point, if there is one. A sequence with an
    unknown letter, or none, has no hydropathy and is flagged for that.
    """
    framework = F.col("region").startswith("FR")
    part = F.when(framework, F.struct(F.col("label_seq_id").alias("k"), F.col("one_letter").alias("t")))
    point = F.max(pi) if pi else F.lit(None).cast("double")
    stats = residues.groupBy("structure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda e: e["t"]), "").alias("_seq"), point.alias("_pi"))
    stats = stats.withColumns({"_gravy": hydropathy("_seq"), "_motifs": motif_count("_seq")})

    def flag(cond: Column, name: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("rule_id"), F.lit("soft").alias("severity"), detail.alias("detail")))

    extreme = F.coalesce(F.abs("_pi") < float("inf"), F.lit(False)) & ~F.col("_pi").between(*PI_RANGE)
    found = [
        flag(F.col("_gravy").isNull(), "developability_sequence_metrics_failed", F.lit("")),
        flag(extreme, "framework_predicted_pi_extreme", F.format_string("%.2f", "_pi")),
        flag(F.col("_gravy") > HYDROPATHY_LIMIT, "framework_gravy_high", F.format_string("%.3f", "_gravy")),
        flag(F.col("_motifs") >= MOTIF_LIMIT, "framework_liability_motif_count", F.col("_motifs").cast("string")),
    ]
    return stats.select("structure_id", F.inline(F.array_compact(F.array(*found))))


def reason_lists(qc: DataFrame, chains: DataFrame) -> DataFrame:
    """Hard and soft reasons of each structure, sorted and joined, with its status.

    ``chains``: structure_id and status of the chain choice; a status other than OK is a hard
    reason, and a chosen chain without any rule row has no residues in the domain.
    """
    detailed = F.when(F.col("detail") == "", F.col("rule_id")).otherwise(F.concat("rule_id", F.lit(":"), "detail"))
    lists = qc.withColumn("_t", detailed).groupBy("structure_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("_t")))).alias(s) for s in ("hard", "soft")
    ])
    out = chains.select("structure_id", "status").join(lists.hint("merge"), "structure_id", "left")
    empty = F.array().cast("array<string>")
    alone = F.when(F.col("status") != "OK", F.array("status")).when(F.col("hard").isNull(), F.array(F.lit("no_variable_domain_residues"))).otherwise(empty)
    out = out.withColumns({"hard": F.array_sort(F.concat(F.coalesce("hard", empty), alone)), "soft": F.coalesce("soft", empty)})
    return out.select(
        "structure_id", F.when(F.size("hard") == 0, "PASS").otherwise("FAIL").alias("hard_status"), F.size("hard").alias("hard_reason_count"),
        F.array_join("hard", " | ").alias("hard_reasons"), F.size("soft").alias("soft_flag_count"), F.array_join("soft", " | ").alias("soft_flags"),
    )
