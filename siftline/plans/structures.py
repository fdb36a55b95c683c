"""Structure tables made from the vectors: atoms, residues, contacts, bonds, parsers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.operators import structure
from siftline.plans.registry import query
from siftline.session import stage_table
from siftline.sources.structures import atom_site, npz_tables, parse_atom_lines, parse_loops

REGIONS = {"FR1": (1, 26), "CDR1": (27, 38), "FR2": (39, 55), "CDR2": (56, 65), "FR3": (66, 104)}
SPEC = structure.DomainSpec(regions=REGIONS, required_anchors=(10, 23, 104), canonical_distance=(0.1, 0.3), peptide_bond=(0.05, 0.4))

# Atoms of a vector: five residues with N, CA, C, O, and an SG in residues 2 and 5.
_ATOMS = """SELECT vec_id AS structure_id, i AS line_order, CASE WHEN i = 20 THEN 2 WHEN i = 21 THEN 5 ELSE i // 4 + 1 END AS label_seq_id,
  CASE WHEN i >= 20 THEN 'SG' ELSE ['N', 'CA', 'C', 'O'][i % 4 + 1] END AS atom_name, embedding[k + 1]::DOUBLE AS x, embedding[k + 2]::DOUBLE AS y, embedding[k + 3]::DOUBLE AS z, label
  FROM (SELECT vec_id, label, embedding, i, CASE WHEN i = 20 THEN 60 WHEN i = 21 THEN 1 ELSE 3 * i END AS k FROM embeddings, range(22) r(i))"""
_FULL = f"""SELECT *, CASE WHEN label_seq_id IN (2, 5) THEN 'CYS' ELSE ['ALA', 'GLY', 'SER'][(label + label_seq_id) % 3 + 1] END AS comp_id,
  CASE WHEN label_seq_id <= 2 THEN 'A' ELSE 'B' END AS chain, CASE WHEN z <= 0.25 THEN round(least(1.0, abs(x) * 8), 2) END AS occupancy, round(abs(y) * 100, 2) AS b_factor,
  CASE WHEN atom_name IN ('CA', 'C') AND x > 0.1 THEN 'B' WHEN atom_name IN ('CA', 'C') AND x < -0.1 THEN 'A' ELSE '' END AS alt FROM ({_ATOMS})"""


def atoms(t, one_chain: bool = False):
    i = F.col("i")
    start = F.when(i == 20, 60).when(i == 21, 1).otherwise(3 * i)
    at = lambda d: F.element_at("embedding", start + d).cast("double")
    rows = t.embeddings.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("i"))
    seq = F.when(i == 20, 2).when(i == 21, 5).otherwise((F.floor(i / 4) + 1).cast("int"))
    name = F.when(i >= 20, "SG").otherwise(F.element_at(F.array(*[F.lit(n) for n in structure.BACKBONE]), i % 4 + 1))
    base = rows.select(F.col("vec_id").alias("structure_id"), i.cast("long").alias("line_order"), seq.alias("label_seq_id"), name.alias("atom_name"),
                       at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), "label")
    loose = F.col("atom_name").isin("CA", "C")
    plain = F.element_at(F.array(F.lit("ALA"), F.lit("GLY"), F.lit("SER")), F.pmod(F.col("label") + F.col("label_seq_id"), F.lit(3)) + 1)
    numbers = F.create_map(*[F.lit(v) for kv in {1: "10", 2: "23", 3: "30", 4: "50", 5: "104"}.items() for v in kv])
    chain = F.lit("H") if one_chain else F.when(F.col("label_seq_id") <= 2, "A").otherwise("B")
    return base.select(
        "structure_id", "line_order", "label_seq_id", "atom_name", "x", "y", "z", F.lit("ATOM").alias("group_PDB"), F.lit(1).alias("model_num"),
        F.substring("atom_name", 1, 1).alias("element"), F.when(F.col("label_seq_id").isin(2, 5), "CYS").otherwise(plain).alias("comp_id"),
        chain.alias("label_asym_id"), chain.alias("auth_asym_id"), numbers[F.col("label_seq_id")].alias("auth_seq_id"), F.lit("?").alias("ins_code"),
        F.when(loose & (F.col("x") > 0.1), "B").when(loose & (F.col("x") < -0.1), "A").otherwise(".").alias("alt_id"),
        F.when(F.col("z") <= 0.25, F.round(F.least(F.lit(1.0), F.abs("x") * 8), 2)).alias("occupancy"), F.round(F.abs("y") * 100, 2).alias("b_factor"),
    )


@query("residue_rollup", f"""
SELECT structure_id, label_seq_id, min(comp_id) AS comp_id, count(*) AS atom_count, count(DISTINCT atom_name) FILTER (atom_name <> 'SG') = 4 AS backbone_complete, round(avg(coalesce(occupancy, 1.0)), 6) AS mean_occupancy,
  bool_or(occupancy IS NULL) AS occupancy_missing, round(avg(b_factor), 6) AS mean_b_factor, CASE min(comp_id) WHEN 'CYS' THEN 'C' WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' ELSE 'S' END AS one_letter FROM ({_FULL}) GROUP BY 1, 2""")
def residue_rollup(spark, t):
    out = structure.residue_rollup(atoms(t)).drop("identity_ambiguous")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_occupancy", "mean_b_factor")})


@query("structure_profile", f"""
SELECT structure_id, count(*) AS atom_count, count(*) AS heavy_atom_count, 0::BIGINT AS hydrogen_count, 1::BIGINT AS model_count, count(DISTINCT chain) AS chain_count, count(DISTINCT label_seq_id) AS residue_count,
  0::BIGINT AS missing_backbone_count, 0::BIGINT AS terminal_oxt_count, count(*) FILTER (occupancy <= 0) AS zero_occupancy_count, 0::BIGINT AS bad_coordinate_count, true AS atom_names_unique, round(count(DISTINCT label_seq_id) / 8.0, 6) AS coverage FROM ({_FULL}) GROUP BY 1""")
def structure_profile(spark, t):
    expected = t.embeddings.select(F.col("vec_id").alias("structure_id"), F.lit(8).alias("expected_residues"))
    return structure.structure_profile(atoms(t), expected).drop("expected_residues").withColumn("coverage", F.round("coverage", 6)).withColumn(
        "terminal_oxt_count", F.col("terminal_oxt_count").cast("long"))


@query("conformer", f"""
WITH a AS (SELECT *, coalesce(occupancy, 1.0) AS occ FROM ({_FULL})), k AS (SELECT DISTINCT structure_id, label_seq_id, alt FROM a WHERE alt <> ''),
s AS (SELECT k.structure_id, k.label_seq_id, k.alt, count(DISTINCT atom_name) FILTER (atom_name <> 'SG') = 4 AS complete, sum(occ) AS total FROM k JOIN a ON a.structure_id = k.structure_id AND a.label_seq_id = k.label_seq_id AND a.alt IN ('', k.alt) GROUP BY 1, 2, 3),
b AS (SELECT structure_id, label_seq_id, alt FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, label_seq_id ORDER BY complete DESC, round(total, 6) DESC, (alt = 'A') DESC, alt DESC) rn FROM s) WHERE rn = 1)
SELECT a.structure_id, a.label_seq_id, a.atom_name, coalesce(b.alt, '') AS selected_altloc FROM a LEFT JOIN b ON a.structure_id = b.structure_id AND a.label_seq_id = b.label_seq_id WHERE a.alt = '' OR a.alt = b.alt""")
def conformer(spark, t):
    filled = atoms(t).withColumn("occupancy", F.coalesce("occupancy", F.lit(1.0)))
    return structure.choose_conformer(filled).select("structure_id", "label_seq_id", "atom_name", "selected_altloc")


def _sites(t):
    ids = t.embeddings.select(F.col("vec_id").alias("structure_id"))
    targets = ids.select("structure_id", F.lit("A").alias("label_asym_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("label_seq_id"))
    design = ids.select("structure_id", F.lit("B").alias("label_asym_id"), F.explode(F.array(F.lit(3), F.lit(5))).alias("label_seq_id"))
    return targets, design


_CONTACTS = f"""
WITH a AS (SELECT * FROM ({_FULL}) WHERE coalesce(occupancy, 1.0) > 0),
d AS (SELECT t.structure_id, t.label_seq_id, t.atom_name AS an, b.atom_name AS bn, sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2 + (t.z - b.z) ** 2) AS d FROM a t JOIN a b ON t.structure_id = b.structure_id AND t.label_seq_id IN (1, 2) AND b.label_seq_id IN (3, 5)),
c AS (SELECT structure_id, label_seq_id, min(d) AS h, min(d) FILTER (an = 'CA' AND bn = 'CA') AS ca FROM d GROUP BY 1, 2)"""


@query("hotspot_contacts", _CONTACTS + """
SELECT structure_id, label_seq_id, round(h, 5) AS min_heavy_atom_distance, round(ca, 5) AS min_ca_distance, h < 0.12 AS heavy_atom_covered, coalesce(ca < 0.12, false) AS ca_covered FROM c""")
def hotspot_contacts(spark, t):
    targets, design = _sites(t)
    out = structure.hotspot_contacts(atoms(t), targets, design, 0.12).drop("label_asym_id")
    return out.withColumns({c: F.round(c, 5) for c in ("min_heavy_atom_distance", "min_ca_distance")})


@query("hotspot_coverage", _CONTACTS + """
SELECT structure_id, avg((h < 0.12)::INT::DOUBLE) AS heavy_coverage, avg(coalesce(ca < 0.12, false)::INT::DOUBLE) AS ca_coverage FROM c GROUP BY 1""")
def hotspot_coverage(spark, t):
    targets, design = _sites(t)
    return structure.hotspot_coverage(structure.hotspot_contacts(atoms(t), targets, design, 0.12))


@query("contact_count", f"""
WITH a AS ({_FULL}) SELECT structure_id, count(DISTINCT label_seq_id) FILTER (near) AS contact_count FROM (
  SELECT t.structure_id, t.label_seq_id, (t.x - b.x) ** 2 + (t.y - b.y) ** 2 + (t.z - b.z) ** 2 <= 0.1 ** 2 AS near FROM a t JOIN a b ON t.structure_id = b.structure_id AND t.chain = 'A' AND b.chain = 'B') GROUP BY 1""")
def contact_count(spark, t):
    return structure.contact_count(atoms(t), "A", "B", 2, 0.1)


@query("disulfides", f"""
WITH s AS (SELECT * FROM ({_FULL}) WHERE atom_name = 'SG')
SELECT a.structure_id, 2 AS p1_label_seq_id, 5 AS p2_label_seq_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 5) AS distance_a, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) >= 0.1 AS in_range, 'disulf1' AS conn_id
FROM s a JOIN s b ON a.structure_id = b.structure_id AND a.label_seq_id < b.label_seq_id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.2 ** 2""")
def disulfides(spark, t):
    return structure.bond_pairs(atoms(t), 0.1, 0.2).withColumn("distance_a", F.round("distance_a", 5))


@query("identify_chain", f"""
WITH r AS (SELECT DISTINCT structure_id, chain, label_seq_id, CASE comp_id WHEN 'CYS' THEN 'C' WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' ELSE 'S' END AS l FROM ({_FULL})),
c AS (SELECT structure_id, chain, string_agg(l, '' ORDER BY label_seq_id) AS s FROM r GROUP BY 1, 2)
SELECT structure_id, count(*) AS chain_count, CASE WHEN count(*) FILTER (s = 'GC') = 1 THEN min(chain) FILTER (s = 'GC') END AS target_chain, CASE count(*) FILTER (s = 'GC') WHEN 1 THEN 'OK' WHEN 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END AS status FROM c GROUP BY 1""")
def identify_chain(spark, t):
    residues = structure.residue_rollup(atoms(t), ["structure_id", "label_asym_id", "label_seq_id"])
    return structure.identify_chain(structure.chain_sequences(residues), "GC")


@query("max_coord_error", f"""
SELECT structure_id, round(max(greatest(abs(x - round(x, 3)), abs(y - round(y, 3)), abs(z - round(z, 3)))) FILTER (NOT (label_seq_id = 5 AND occupancy <= 0.1 AND occupancy IS NOT NULL)), 9) AS max_error, count(*) FILTER (label_seq_id = 5 AND occupancy <= 0.1) AS unpaired_atoms,
  max(greatest(abs(x - round(x, 3)), abs(y - round(y, 3)), abs(z - round(z, 3)))) FILTER (NOT (label_seq_id = 5 AND occupancy <= 0.1 AND occupancy IS NOT NULL)) <= 4.9e-4 AND count(*) FILTER (label_seq_id = 5 AND occupancy <= 0.1) = 0 AS agrees FROM ({_FULL}) GROUP BY 1""")
def max_coord_error(spark, t):
    a = atoms(t)
    kept = a.filter(~F.coalesce((F.col("label_seq_id") == 5) & (F.col("occupancy") <= 0.1), F.lit(False)))
    rounded = kept.withColumns({c: F.round(c, 3) for c in "xyz"})
    out = structure.max_coordinate_error(a, rounded, ["structure_id", "line_order"], 4.9e-4)
    return out.withColumn("max_error", F.round("max_error", 9))


def domain(t):
    a = stage_table(atoms(t, one_chain=True), "atoms")
    wanted = t.embeddings.select(F.col("vec_id").alias("structure_id"), F.lit("H").alias("chain"))
    chains = stage_table(structure.choose_chain(a, wanted, SPEC), "chains")
    return a, chains, *structure.normalize_domain(a, chains, SPEC)


@query("normalize_domain", f"""
WITH r AS (SELECT DISTINCT structure_id, label_seq_id, comp_id FROM ({_FULL}))
SELECT structure_id, label_seq_id AS ordinal, label_seq_id, ['10', '23', '30', '50', '104'][label_seq_id] AS position, ['FR1', 'FR1', 'CDR1', 'FR2', 'FR3'][label_seq_id] AS region, CASE comp_id WHEN 'CYS' THEN 'C' WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' ELSE 'S' END AS one_letter FROM r""")
def normalize_domain(spark, t):
    return domain(t)[3].select("structure_id", "ordinal", "label_seq_id", "position", "region", "one_letter")


@query("structure_qc")
def structure_qc(spark, t):
    a, chains, _, residues = domain(t)
    residues = stage_table(residues, "residues")
    sulfur = residues.filter("point_SG IS NOT NULL").select("structure_id", "label_seq_id", "comp_id", F.lit("SG").alias("atom_name"), "point_SG.*")
    bonds = structure.bond_rules(structure.bond_pairs(sulfur, 0.1, 0.3), residues, ("23", "104"))
    qc = structure.structure_qc(residues, SPEC).unionByName(bonds).unionByName(structure.identity_problems(a, chains)).unionByName(structure.sequence_flags(residues))
    return structure.reason_lists(qc, chains)


# ---- parsers on texts written from the same atoms ----

_PARSED = f"SELECT structure_id, line_order, atom_name, comp_id, chain, label_seq_id, round(x * 100, 3) AS x, round(y * 100, 3) AS y, round(z * 100, 3) AS z, b_factor FROM ({_FULL})"


def _texts(t, line, head: str):
    lines = atoms(t).select("structure_id", F.struct("line_order", line.alias("line")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda r: r["line"]), "\n")
    return lines.groupBy("structure_id").agg(F.concat(F.lit(head), text, F.lit("\n#\n")).alias("text"))


@query("pdb_atoms", _PARSED)
def pdb_atoms(spark, t):
    line = F.format_string(
        "ATOM  %5d  %-3s%1s%3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("line_order") + 1, "atom_name", F.translate("alt_id", ".", " "), "comp_id",
        "label_asym_id", "label_seq_id", F.col("x") * 100, F.col("y") * 100, F.col("z") * 100, F.coalesce("occupancy", F.lit(1.0)), "b_factor", "element")
    parsed = parse_atom_lines(_texts(t, line, "MODEL        1\n"), "structure_id", "text")
    return parsed.select("structure_id", (F.col("line_order") % (1 << 32) - 1).alias("line_order"), "atom_name", "comp_id", F.col("auth_asym_id").alias("chain"),
                         F.col("auth_seq_id").cast("int").alias("label_seq_id"), "x", "y", "z", "b_factor")


_ITEMS = ("group_PDB", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv")


@query("mmcif_atoms", _PARSED)
def mmcif_atoms(spark, t):
    line = F.format_string("ATOM %s '%s' %s %s %d %.3f %.3f %.3f %.2f", "element", "atom_name", "comp_id", "label_asym_id", "label_seq_id",
                           F.col("x") * 100, F.col("y") * 100, F.col("z") * 100, "b_factor")
    head = "data_x\n_entry.id x\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in _ITEMS)
    parsed = atom_site(_texts(t, line, head), "structure_id", "text")
    return parsed.select("structure_id", F.col("line_order").cast("long").alias("line_order"), "atom_name", "comp_id", F.col("label_asym_id").alias("chain"), "label_seq_id", "x", "y", "z", "b_factor")


@query("mmcif_sequences", """
SELECT doc_id, lang AS entity_id, ' ' || replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || ';', chr(10) || ' ;') AS seq FROM documents""")
def mmcif_sequences(spark, t):
    # A line of a text field can't start with a semicolon.
    body = F.concat(F.lit("data_d\n_Entity_Poly.entity_id "), "lang", F.lit(" # note\n_entity_poly.seq\n; "), F.regexp_replace("text", "(\r\n|\r|\n);", "$1 ;"), F.lit("\n;\n#\n"))
    return parse_loops(t.documents.select("doc_id", body.alias("cif")), "doc_id", "cif", "_entity_poly", ["entity_id", "seq"]).drop("row_order")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 1000):
            part, out = batch.slice(low, 1000), []
            for v in part.column("v"):
                v, buffer = np.asarray(v.values, dtype="float32"), io.BytesIO()
                np.savez(buffer, iptm=v, coords=v[:63].reshape(1, 21, 3))
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([part.column("file"), pa.array(out, pa.binary())], names=["file", "content"])


@query("npz_values", """
SELECT file, name, dtype, shape, n, round(total, 5) AS total FROM (
  SELECT vec_id::VARCHAR AS file, 'iptm' AS name, 'float32' AS dtype, len(embedding)::VARCHAR AS shape, len(embedding)::BIGINT AS n, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS total FROM embeddings
  UNION ALL SELECT vec_id::VARCHAR, 'coords', 'float32', '1x21x3', 63, list_sum(list_transform(embedding[1:63], lambda v: v::DOUBLE)) FROM embeddings)""")
def npz_values(spark, t):
    packed = t.embeddings.select(F.col("vec_id").cast("string").alias("file"), F.col("embedding").alias("v")).mapInArrow(_pack, "file string, content binary")
    schema, values = npz_tables(packed)
    sums = values.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"))
    shape = F.array_join(F.col("shape").cast("array<string>"), "x")
    return schema.select("file", "name", "dtype", shape.alias("shape")).join(sums, ["file", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
