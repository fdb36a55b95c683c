"""Structure operators on small hand-made structures."""

from pyspark.sql import functions as F

from siftline.operators import structure
from siftline.session import stage_table

SCHEMA = ("structure_id string, line_order long, label_seq_id int, atom_name string, x double, y double, z double, group_PDB string, model_num int, element string, "
          "comp_id string, label_asym_id string, auth_asym_id string, auth_seq_id string, ins_code string, alt_id string, occupancy double, b_factor double")


def atom(order, seq, name, xyz=(0.0, 0.0, 1.0), comp="ALA", alt=".", occ=1.0, chain="H", auth=None, sid="s", element=None, model=1, ins="?"):
    return (sid, order, seq, name, *map(float, xyz), "ATOM", model, element or name[0], comp, chain, chain, auth or str(seq), ins, alt, occ, 10.0)


def frame(spark, *atoms):
    return spark.createDataFrame(list(atoms), SCHEMA)


def residue(order, seq, comp="ALA", auth=None, start=0.0, sid="s", names=("N", "CA", "C", "O"), **kw):
    return [atom(order + k, seq, n, (start + 1.3 * k, 0.0, 1.0), comp, auth=auth, sid=sid, **kw) for k, n in enumerate(names)]


def test_conformer_prefers_complete_then_occupancy_then_a(spark, rows):
    df = frame(
        spark,
        atom(1, 1, "N"), atom(2, 1, "CA", alt="A", occ=0.2), atom(3, 1, "C", alt="A", occ=0.2), atom(4, 1, "O", alt="A", occ=0.2), atom(5, 1, "CA", alt="B", occ=0.9),
        atom(6, 2, "CA", alt="A", occ=0.5), atom(7, 2, "CA", alt="B", occ=0.5), atom(8, 3, "CA", alt="B", occ=0.5), atom(9, 3, "CA", alt="C", occ=0.5),
        atom(10, 4, "CA", occ=0.3), atom(11, 4, "CA", occ=0.6),
    )
    got = structure.choose_conformer(df).groupBy("label_seq_id").agg(F.max("selected_altloc"), F.count("*"), F.max("occupancy"))
    assert rows(got) == [(1, "A", 4, 1.0), (2, "A", 1, 0.5), (3, "C", 1, 0.5), (4, "", 1, 0.6)]


def test_rollup(spark):
    df = frame(spark, *residue(1, 1), atom(9, 2, "CA", comp="TRP", occ=None), atom(10, 2, "CB", comp="GLY"))
    a, b = structure.residue_rollup(df).orderBy("label_seq_id").collect()
    assert (a["backbone_complete"], a["one_letter"], a["mean_occupancy"], a["identity_ambiguous"]) == (True, "A", 1.0, False)
    assert (b["backbone_complete"], b["occupancy_missing"], b["identity_ambiguous"]) == (False, True, True)


def test_profile(spark):
    df = frame(spark, *residue(1, 1), atom(5, 1, "OXT"), atom(6, 1, "H1", element="H"), atom(7, 2, "CA", occ=0.0), atom(8, 1, "CA", chain="L", model=2))
    row = structure.structure_profile(df, spark.createDataFrame([("s", 4)], "structure_id string, expected_residues int")).first()
    assert (row["atom_count"], row["heavy_atom_count"], row["hydrogen_count"], row["model_count"], row["chain_count"], row["residue_count"]) == (8, 7, 1, 2, 2, 3)
    assert (row["missing_backbone_count"], row["terminal_oxt_count"], row["zero_occupancy_count"], row["coverage"]) == (2, 1, 1, 0.75)
    assert row["atom_names_unique"]


def test_contacts_use_strict_and_inclusive_limits(spark, rows):
    df = frame(spark, atom(1, 1, "CA", (0, 0, 0), chain="A"), atom(2, 2, "CA", (0, 10, 0), chain="A"), atom(3, 1, "CA", (5, 0, 0), chain="B"), atom(4, 1, "H1", (0.1, 0, 0), chain="B", element="H"))
    assert structure.contact_count(df, "A", "B", 2, 5.0).first()["contact_count"] == 1
    assert structure.contact_count(df, "A", "B", 2, 4.9).first()["contact_count"] == 0
    assert structure.contact_count(df, "A", "B", 3, 5.0).first()["contact_count"] == 0
    t = spark.createDataFrame([("s", "A", 1), ("s", "A", 2)], "structure_id string, label_asym_id string, label_seq_id int")
    d = spark.createDataFrame([("s", "B", 1)], "structure_id string, label_asym_id string, label_seq_id int")
    got = structure.hotspot_contacts(df, t, d, 5.0)
    assert rows(got, "label_seq_id", "min_heavy_atom_distance", "heavy_atom_covered") == [(1, 5.0, False), (2, 125 ** 0.5, False)]
    assert structure.hotspot_coverage(structure.hotspot_contacts(df, t, d, 5.1)).first()["heavy_coverage"] == 0.5


def test_contact_count_moves_no_copies(spark, rows):
    inf, nan = float("inf"), float("nan")
    df = frame(
        spark, atom(1, 1, "CA", (0, 0, 0), chain="A"), atom(2, 1, "CB", (inf, 0, 0), chain="A"), atom(3, 2, "CA", (0, 10, 0), chain="A"), atom(4, 3, "CA", (0, 20, 0), chain="A"),
        atom(5, 1, "CA", (0, 5, 0), chain="B"), atom(6, 1, "CB", (nan, 0, 0), chain="B"), atom(7, 2, "CA", (inf, 0, 0), chain="B"), atom(8, 2, "CB", (0, 20, 0), chain="B"),
        atom(1, 1, "CA", (0, 0, 0), chain="A", sid="t"), atom(2, 2, "CA", (nan, 0, 0), chain="A", sid="t"), atom(3, 1, "CA", (0, 0, 0), chain="B", sid="t"),
        atom(1, 1, "CA", (0, 0, 0), chain="A", sid="u"), atom(2, 2, "CA", (0, 0, 0), chain="A", sid="u"))
    got = structure.contact_count(df, "A", "B", 2, 5.0)
    assert rows(got) == [("s", 2), ("t", 1), ("u", 0)]
    # One generator, of the touched residues: no point is copied to the cells around it.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_bonds(spark, rows):
    df = frame(spark, atom(1, 1, "SG", (0, 0, 0), "CYS"), atom(2, 5, "SG", (2.0, 0, 0), "CYS"), atom(3, 9, "SG", (0, 2.4, 0), "CYS"), atom(4, 7, "SG", (1, 1, 0), "ALA"))
    bonds = structure.bond_pairs(df, 2.2, 2.5)
    assert rows(bonds, "p1_label_seq_id", "p2_label_seq_id", "in_range", "conn_id") == [(1, 5, False, "disulf1"), (1, 9, True, "disulf2")]
    res = spark.createDataFrame([("s", 1, "23", "FR1"), ("s", 5, "104", "FR3"), ("s", 9, "30", "CDR1")], "structure_id string, label_seq_id int, position string, region string")
    assert rows(structure.bond_rules(bonds, res, ("23", "104")), "rule_id", "severity", "detail") == [("extra_disulfide_involves_design_region", "hard", "23|30")]


def test_joins_on_structures_are_not_broadcast(spark, tmp_path):
    # Files of repeated labels look small, and points copied to cells look like points.
    put = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    a = put(frame(spark, *sound(spark)), "atoms")
    wanted = put(spark.createDataFrame([("s", "H")], "structure_id string, chain string"), "wanted")
    chains = put(structure.choose_chain(a, wanted, SPEC), "chains")
    residues = put(structure.normalize_domain(a, chains, SPEC)[1], "residues")
    bonds = structure.bond_rules(structure.bond_pairs(a, 1.8, 2.5), residues, ("23", "104"))
    for df, few in ((structure.choose_chain(a, wanted, SPEC), 0), (structure.identity_problems(a, chains), 0), (residues, 0), (bonds, 2)):
        # Only the lists of crowded cells, which are empty but for cells of very many points.
        assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= few


def test_chain_identity(spark, rows):
    c = spark.createDataFrame([("a", "A", "HAEG"), ("a", "B", "QV"), ("b", "A", "HAEG"), ("b", "B", "HAEG"), ("c", "A", "X")], "structure_id string, label_asym_id string, sequence string")
    assert rows(structure.identify_chain(c, "HAEG"), "structure_id", "target_chain", "status") == [("a", "A", "OK"), ("b", None, "AMBIGUOUS"), ("c", None, "MISSING")]


def test_coordinate_error(spark, rows):
    a = frame(spark, atom(1, 1, "N"), atom(2, 1, "CA"), atom(3, 1, "N", sid="t"))
    b = a.withColumn("x", F.col("x") + F.when(F.col("structure_id") == "s", 0.0004).otherwise(0.001))
    got = structure.max_coordinate_error(a, b, ["structure_id", "line_order"])
    assert rows(got, "structure_id", "agrees") == [("s", True), ("t", False)]
    assert not structure.max_coordinate_error(a, b.filter("line_order <> 2"), ["structure_id", "line_order"]).filter("structure_id = 's'").first()["agrees"]


SPEC = structure.DomainSpec(
    regions={"FR1": (1, 26), "CDR1": (27, 38), "FR2": (39, 55), "FR3": (66, 104)}, required_anchors=(23, 104), canonical_distance=(1.8, 2.5), peptide_bond=(1.0, 1.8), min_last=104)


def sound(spark, change=None, sid="s"):
    """Three residues with a bond between the first and the last; ``change`` edits the atom list."""
    rows = residue(1, 1, "CYS", "23", 0.0, sid) + residue(11, 2, "ALA", "30", 3.9, sid) + residue(21, 3, "CYS", "104", 7.8, sid)
    rows += [atom(30, 1, "SG", (0, 5, 5), "CYS", auth="23", sid=sid), atom(31, 3, "SG", (0, 5, 7), "CYS", auth="104", sid=sid)]
    return change(rows) if change else rows


def edit(field, value, match):
    at = SCHEMA.split(", ").index(next(f for f in SCHEMA.split(", ") if f.startswith(field + " ")))
    return lambda rows: [tuple(value if k == at and match(r) else v for k, v in enumerate(r)) for r in rows]


BASE = "struct_conn_reconstructed_from_geometry"
CASES = [
    (None, "", ""),
    (lambda r: [a for a in r if not (a[2] == 1 and a[3] == "O")], "framework_backbone_incomplete:23", ""),
    (lambda r: [a for a in r if not (a[2] == 2 and a[3] == "O")], "design_region_backbone_incomplete:30", ""),
    (edit("occupancy", 0.4, lambda r: r[2] == 2), "residue_mean_occupancy_below_0.5:30", ""),
    (edit("occupancy", 0.6, lambda r: r[2] == 2), "", "residue_mean_occupancy_below_0.7:30"),
    (edit("occupancy", None, lambda r: r[1] == 11), "", "atom_occupancy_missing_assumed_1.0"),
    (edit("alt_id", "A", lambda r: r[1] == 12), "", "altloc_residue_conformer_selected"),
    (edit("label_seq_id", 4, lambda r: r[2] == 3), "unresolved_sequence_gap:30->104", ""),
    (edit("x", 9.0, lambda r: r[1] == 21), "peptide_bond_break:30->104:2.500", ""),
    (edit("z", 9.0, lambda r: r[1] == 31), "canonical_disulfide_distance_invalid:4.000", ""),
    (lambda r: [a for a in r if a[1] != 31], "canonical_disulfide_sg_missing", ""),
    (edit("comp_id", "SER", lambda r: r[2] == 3), "canonical_imgt_23_104_not_cysteine", ""),
    (edit("comp_id", "MSE", lambda r: r[2] == 2), "nonstandard_variable_residue:MSE", ""),
    (edit("auth_seq_id", "23", lambda r: r[2] == 2), "duplicate_imgt_position:23", ""),
    (edit("auth_seq_id", "103", lambda r: r[2] == 3), "c_terminal_framework_truncated:last_imgt=103 | canonical_disulfide_positions_missing | missing_imgt_anchors:104", ""),
    (lambda r: r + [atom(50, 2, "CA", (5.2, 0, 1), auth="30", occ=0.3)], "", "duplicate_atom_name_resolved_by_occupancy"),
    (lambda r: r + [atom(50, 9, "CA", comp="ALA", auth="60"), atom(51, 9, "CB", comp="GLY", auth="60")], "residue_identity_ambiguous:label_seq=9", ""),
    (lambda r: r + [atom(50, 2, "CB", (0, 0, 0), auth="30")], "invalid_or_zero_coordinates", ""),
    (edit("auth_seq_id", "300", lambda r: True), "no_variable_domain_residues", None),
    (edit("label_asym_id", "Q", lambda r: True), "", ""),
]


def test_one_change_one_reason(spark):
    """Every case is one structure; all go through the rules together."""
    data = []
    for i, (change, _, _) in enumerate(CASES):
        made = sound(spark, change)
        data += [(f"c{i:02d}",) + a[1:] for a in made]
    df = frame(spark, *data).cache()
    wanted = df.select("structure_id").distinct().withColumn("chain", F.lit("H"))
    chains = stage_table(structure.choose_chain(df, wanted, SPEC))
    _, res = structure.normalize_domain(df, chains, SPEC)
    qc = structure.structure_qc(res, SPEC).unionByName(structure.identity_problems(df, chains))
    got = {r["structure_id"]: r for r in structure.reason_lists(qc, chains).collect()}
    for i, (_, hard, soft) in enumerate(CASES):
        row = got[f"c{i:02d}"]
        want = "" if soft is None else " | ".join(sorted(x for x in (soft, BASE) if x))
        assert (row["hard_reasons"], row["soft_flags"]) == (hard, want), i
        assert row["hard_status"] == ("FAIL" if hard else "PASS")


def test_domain(spark, rows):
    extra = [atom(40, 9, "CA", auth="200"), atom(41, 1, "HA", auth="23", comp="CYS", element="H"), atom(42, 8, "CA", auth="60", comp="ALA"), atom(43, 8, "CB", auth="60", comp="GLY")]
    df = frame(spark, *sound(spark, lambda r: r + extra))
    wanted = spark.createDataFrame([("s", "H"), ("none", "H")], "structure_id string, chain string")
    chains = structure.choose_chain(df, wanted, SPEC)
    assert rows(chains, "structure_id", "status") == [("none", "hchain_not_found"), ("s", "OK")]
    kept, res = structure.normalize_domain(df, chains, SPEC)
    assert rows(res, "ordinal", "position", "region", "kept_atom_count") == [(1, "23", "FR1", 5), (2, "30", "CDR1", 4), (3, "104", "FR3", 5)]
    assert kept.count() == 14 and kept.select("normalized_label_seq_id").distinct().count() == 3


def test_ambiguous_chain(spark, rows):
    twin = lambda r: r + [a[:11] + ("I", "H") + a[13:] for a in r]
    wanted = spark.createDataFrame([("s", "H")], "structure_id string, chain string")
    assert rows(structure.choose_chain(frame(spark, *sound(spark, twin)), wanted, SPEC), "status") == [("ambiguous_hchain_mapping",)]


def test_sequence_flags(spark, rows):
    data = [("sticky", i, "FR1", "I", 9.9) for i in range(5)] + [("sticky", 9, "CDR1", "D", 9.9)]
    data += [("motifs", i, "FR2", c, 7.0) for i, c in enumerate("NGDSMWMKR")] + [("odd", 0, "FR1", "X", None), ("loops", 0, "CDR1", "A", float("nan"))]
    df = spark.createDataFrame(data, "structure_id string, label_seq_id int, region string, one_letter string, pi double")
    assert rows(structure.sequence_flags(df, "pi"), "structure_id", "rule_id", "detail") == [
        ("loops", "developability_sequence_metrics_failed", ""), ("motifs", "framework_liability_motif_count", "5"), ("odd", "developability_sequence_metrics_failed", ""),
        ("sticky", "framework_gravy_high", "4.500"), ("sticky", "framework_predicted_pi_extreme", "9.90")]
    assert rows(structure.sequence_flags(df), "structure_id") == [("loops",), ("motifs",), ("odd",), ("sticky",)]
