"""Readers and writers on files made in the test."""

import hashlib
import io
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.sources import files, structures, tables


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_csv_keeps_empty_strings_and_bom(spark, tmp_path):
    path = put(tmp_path, "a.csv", '﻿id,name\n1,\n2,"x, ""y"""\n')
    df = tables.read_table(spark, path, ["id"])
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [("1", ""), ("2", 'x, "y"')]
    with pytest.raises(ValueError):
        tables.read_table(spark, path, ["other"])
    with pytest.raises(ValueError):
        tables.read_table(spark, put(tmp_path, "b.csv", "id,id\n1,2\n"))


def test_contract_tsv(spark, tmp_path):
    good = put(tmp_path, "a.tsv", "id\tv\n1\t2.5\n")
    assert [tuple(r) for r in tables.read_contract_tsv(spark, good, "id INT, v DOUBLE").collect()] == [(1, 2.5)]
    for name, text in {"order.tsv": "v\tid\n2.5\t1\n", "bad.tsv": "id\tv\nx\t2.5\n"}.items():
        with pytest.raises(Exception):
            tables.read_contract_tsv(spark, put(tmp_path, name, text), "id INT, v DOUBLE").collect()


def test_json(spark, tmp_path):
    doc = put(tmp_path, "d.json", '{\n "items": [{"a": 1}, {"a": 2}]\n}')
    assert [r["a"] for r in tables.read_json(spark, doc, "items ARRAY<STRUCT<a: INT>>", "items").collect()] == [1, 2]
    lines = put(tmp_path, "e.jsonl", '{"a": 1}\n\n{"a": 2}{"a": 3}\nnope\n{"a": "x"}\n')
    good, bad = tables.read_jsonl(spark, lines, "a INT")
    assert [r["a"] for r in good.collect()] == [1]
    assert sorted(r["value"] for r in bad.collect()) == ['nope', '{"a": "x"}', '{"a": 2}{"a": 3}']


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, "")], "id int, s string")
    path = str(tmp_path / "out")
    tables.write_table(df, path, ["s", "id", "new"], ["id"])
    assert rows(tables.read_table(spark, path, sep="\t")) == [("", "2", ""), ("a", "1", "")]
    with pytest.raises(Exception):
        tables.write_table(df, path)
    reg = str(tmp_path / "reg")
    with pytest.raises(ValueError):
        tables.write_registry({"t": df.unionAll(df)}, {"t": ["id"]}, {"v": "1"}, reg)
    tables.write_registry({"t": df}, {"t": ["id"]}, {"v": "1"}, reg)
    assert tables.check_published(df, f"{reg}/t").count() == 0
    assert rows(tables.check_published(df.filter("id = 1").unionAll(df.filter("id = 1")), f"{reg}/t")) == [(1, "a", "new", 1), (2, "", "stale", 1)]
    assert rows(tables.read_registry(spark, reg, "metadata")) == [("v", "1")]


def test_sql(spark, tmp_path):
    path = put(tmp_path, "q.csv", "a,b\n1,x\n2,y\n")
    tables.read_queryable(spark, path, "report_rows")
    assert spark.sql("SELECT sum(a) AS n FROM report_rows").first()["n"] == 3


def test_manifest(spark, tmp_path, rows):
    h = "a" * 64
    path = put(tmp_path, "m.txt", f"{h}  ok.txt\n{h}  /abs\n{h}  a/../b\n{h}  twice\n{h}  twice\nshort  x\n{h} one-space\n")
    good, bad = files.read_manifest(spark, path)
    assert rows(good) == [(h, "ok.txt")]
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate_path", "duplicate_path", "malformed", "malformed", "unsafe_path", "unsafe_path"]
    relaxed, _ = files.read_manifest(spark, put(tmp_path, "n.txt", f"{h.upper()} *x\n"), strict=False)
    assert rows(relaxed) == [(h, "x")]


def test_inventory(spark, tmp_path, rows):
    (tmp_path / "d" / "__pycache__").mkdir(parents=True)
    put(tmp_path, "d/a.TXT", "hello")
    put(tmp_path, "d/b", "hello")
    put(tmp_path, "d/__pycache__/c.pyc", "x")
    inv = files.file_inventory(spark, str(tmp_path / "d"))
    digest = hashlib.sha256(b"hello").hexdigest()
    assert rows(inv, "file_name", "suffix", "bytes", "sha256") == [("a.TXT", ".txt", 5, digest), ("b", "", 5, digest)]
    objects, refs = files.content_store(inv)
    assert rows(objects, "object_bytes", "reference_count", "size_conflict") == [(5, 2, False)] and refs.count() == 2
    assert "sha256" not in files.file_inventory(spark, str(tmp_path / "d"), with_hash=False).columns


def test_logs_and_counts(spark, rows):
    lines = spark.createDataFrame([("✓ Step fold completed successfully in 12.5s",), ("✓ Step x y completed successfully in 3 s",), ("failed in 3s",)], "value string")
    assert rows(files.extract_stage_timings(lines)) == [("fold", 12.5), ("x y", 3.0)]
    f = spark.createDataFrame([("a", ">1"), ("a", "ACD "), ("a", "EF"), ("a", ">2"), ("b", ">3")], "file string, value string")
    assert rows(files.record_stats(f, "fasta")) == [("a", 2, 5), ("b", 1, 0)]
    s = spark.createDataFrame([("a", "x"), ("a", "$$$$"), ("a", "$$$$ ")], "file string, value string")
    assert rows(files.record_stats(s, "sdf"), "file", "record_count") == [("a", 2)]
    t = spark.createDataFrame([("a", "h1\th2"), ("a", "1\t2"), ("a", "")], "file string, value string")
    assert rows(files.record_stats(t, "tsv"), "record_count") == [(1,)]


def test_telemetry(spark, tmp_path):
    path = put(tmp_path, "t.csv", "timestamp, memory.used [MiB], memory.total [MiB]\nt1, 10 MiB, 100 MiB\nt2, 20, 100 mib\nt3, x, -5 MiB\n")
    got = [(r["used_mib"], r["total_mib"]) for r in files.read_telemetry(spark, path).collect()]
    assert got == [(10.0, 100.0), (20.0, 100.0), (None, None)]
    with pytest.raises(ValueError):
        files.read_telemetry(spark, put(tmp_path, "u.csv", "memory.used,memory.used [x],memory.total\n1,2,3\n"))


PDB = """HEADER    TEST
MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 10.00           N
HETATM    2  CA BGLY B  12A     -1.000   2.000   3.500  0.50 20.00           C
TER
ENDMDL
MODEL        2
ATOM      3  N   ALA A   1       0.000   0.000   0.000  1.00 10.00           N
ENDMDL
"""


def test_fixed_width_atoms(spark, tmp_path, rows):
    put(tmp_path, "one.pdb", PDB)
    df = structures.read_pdb_atoms(spark, str(tmp_path / "one.pdb"))
    cols = ("structure_id", "model_num", "group_PDB", "atom_name", "alt_id", "comp_id", "auth_asym_id", "auth_seq_id", "ins_code", "x", "occupancy", "element")
    assert rows(df.orderBy("line_order"), *cols) == sorted([
        ("one", 1, "ATOM", "N", "", "ALA", "A", "1", "", 11.104, 1.0, "N"), ("one", 1, "HETATM", "CA", "B", "GLY", "B", "12", "A", -1.0, 0.5, "C"),
        ("one", 2, "ATOM", "N", "", "ALA", "A", "1", "", 0.0, 1.0, "N")], key=str)


CIF = """data_X
_entry.id X
loop_
_entity_poly.entity_id
_entity_poly.type
_entity_poly.pdbx_seq_one_letter_code
1 'poly peptide'
;ACD
EFG
;
2 "it's" 'a''b c'
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y _ignored
ATOM 1 "O5'" 7
1.5 2.5
#
_struct_conn.id disulf1
_struct_conn.details 'two words'
"""


def test_loops(spark, tmp_path, rows):
    put(tmp_path, "x.cif", CIF.replace("_atom_site.Cartn_y _ignored\n", "_atom_site.Cartn_y\n"))
    put(tmp_path, "y.cif", "data_Y\n")
    out = structures.read_mmcif(
        spark, str(tmp_path / "*.cif"),
        {"_entity_poly": ["entity_id", "type", "pdbx_seq_one_letter_code", "absent"], "_atom_site": [], "_struct_conn": ["id", "details"]})
    assert rows(out["_entity_poly"], "row_order", "entity_id", "type", "pdbx_seq_one_letter_code", "absent") == [
        (0, "1", "poly peptide", "ACD\nEFG", None), (1, "2", "it's", "a''b c", None)]
    assert rows(out["_atom_site"], "structure_id", "atom_name", "label_seq_id", "x", "y", "z") == [("x", "O5'", 7, 1.5, 2.5, None)]
    assert rows(out["_struct_conn"], "id", "details") == [("disulf1", "two words")]
    wanted = spark.createDataFrame([("y",)], "structure_id string")
    assert structures.read_mmcif(spark, str(tmp_path / "*.cif"), {"_atom_site": []}, wanted)["_atom_site"].count() == 0


def test_archives(spark, tmp_path, rows):
    put(tmp_path, "m.cif", CIF.replace("_atom_site.Cartn_y _ignored\n", "_atom_site.Cartn_y\n"))
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as out:
        out.add(tmp_path / "m.cif", "deep/one.cif")
        out.add(tmp_path / "m.cif", "two.cif")
    texts = structures.read_archives(spark, str(tmp_path / "a.tar.gz"), spark.createDataFrame([("one",)], "structure_id string"))
    assert rows(texts, "structure_id", "member") == [("one", "deep/one.cif")]
    assert rows(structures.atom_site(texts, "structure_id", "value"), "structure_id", "atom_name") == [("one", "O5'")]


def test_plain_archives_are_read_in_splits(spark, tmp_path):
    want = {}
    with tarfile.open(tmp_path / "inner.tar", "w") as out:  # its headers must not count as those of the outer one
        put(tmp_path, "x.cif", "inner")
        out.add(tmp_path / "x.cif", "hidden.cif")
    for name, form in (("pax.tar", tarfile.PAX_FORMAT), ("gnu.tar", tarfile.GNU_FORMAT)):
        with tarfile.open(tmp_path / name, "w", format=form) as out:
            for i in range(60):
                body = f"data_{i}\n" + "é line\n" * (i * 37 % 400)
                put(tmp_path, "m.cif", body)
                member = f"d{i % 7}/" + ("long/" * 40 if i % 9 == 0 else "") + f"same{i % 3}_{i // 3}.cif"
                out.add(tmp_path / "m.cif", member)
                want[name, member] = body
                if i % 20 == 0:
                    out.add(tmp_path / "inner.tar", f"d/{i}.tar")
                    out.add(tmp_path, f"folder{i}", recursive=False)
    conf, key = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "16384")
    try:
        for name in ("pax.tar", "gnu.tar"):
            path = str(tmp_path / name)
            assert spark.sparkContext.binaryRecords(path, structures.BLOCK).getNumPartitions() > 5
            got = structures.read_plain_archive(spark, path).collect()
            assert {r["member"]: r["value"] for r in got} == {m: v for (n, m), v in want.items() if n == name} and len(got) == 60
            assert all(r["structure_id"] + ".cif" == r["member"] for r in got)
            one = structures.read_plain_archive(spark, path, spark.createDataFrame([("same1_5",)], "structure_id string"), by_path=False)
            assert [r["member"] for r in one.collect()] == ["d2/same1_5.cif"]
    finally:
        conf.unset(key)
    paths = structures.read_archives(spark, str(tmp_path / "pax.tar"), by_path=True)
    assert paths.select("structure_id").distinct().count() == 60


def test_npz(spark, tmp_path, rows):
    np.savez(tmp_path / "a.npz", iptm=np.array([0.5, 0.25]), coords=np.zeros((2, 3, 3), dtype="float32"), flag=np.array([True]))
    schema, values = structures.read_npz(spark, str(tmp_path / "a.npz"))
    assert rows(schema, "name", "dtype", F.col("shape").cast("string").alias("s")) == [("coords", "float32", "[2, 3, 3]"), ("flag", "bool", "[1]"), ("iptm", "float64", "[2]")]
    assert rows(values.filter("name <> 'coords'"), "name", "sample_index", "value") == [("flag", 0, 1.0), ("iptm", 0, 0.5), ("iptm", 1, 0.25)]
    places = values.filter("name = 'coords'").select("sample_index", "position").collect()
    assert {tuple(r["position"]): r["sample_index"] for r in places} == {(i, j, k): i * 9 + j * 3 + k for i in range(2) for j in range(3) for k in range(3)}


def test_npz_batches_are_bounded():
    def packed(**arrays):
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        return buffer.getvalue()

    files = [packed(v=np.arange(64.0), point=np.array(2.5), text=np.array(["a"])) for _ in range(3000)] + [packed(v=np.arange(150_000.0).reshape(3, 50_000), none=np.zeros((0, 2)))]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(files))]), pa.array(files, pa.binary())], names=["file", "content"])
    found = list(structures._npz_values(iter([batch])))
    # Few batches, none of many more numbers than a chunk, whatever the sizes of the arrays are.
    assert len(found) <= 7 and max(len(b) for b in found) < 2 * structures.NPZ_CHUNK
    table = pa.Table.from_batches(found)
    assert len(table) == 3000 * 65 + 150_000
    last = table.filter(pa.compute.equal(table["file"], "3000")).to_pydict()
    assert last["value"] == [float(i) for i in range(150_000)] == last["sample_index"] and last["position"][50_001] == [1, 1]
    assert table.filter(pa.compute.equal(table["name"], "point")).slice(0, 1).to_pylist() == [{"file": "0", "name": "point", "sample_index": 0, "position": [], "value": 2.5}]
    schema = list(structures._npz_schema(iter([batch])))
    assert max(len(b) for b in schema) <= structures.NPZ_ARRAYS and sum(len(b) for b in schema) == 9002


def test_loop_tokens(spark, rows):
    long = "q" * 100_000
    good = f"data_x # note\nLOOP_\n_A.id\n_a.Text # tag\n1\n;first\n#no note\n_no.tag\n;\n# a note\n2 '{long}'\n3 \"it's\"\n_b.c 'x y'\nloop_\n_a.other\n9\n"
    frame = spark.createDataFrame([(1, good), (2, "loop_\n_a.id\n_a.text\n1 2 3\n"), (3, "_a.id 'open\n"), (4, "_a.id\n;open\n"), (5, None), (6, "_a.id 5\n_a.text ?\n")], "id long, text string")
    assert rows(structures.parse_loops(frame, "id", "text", "_a", ["id", "text"])) == [
        (1, 0, "1", "first\n#no note\n_no.tag"), (1, 1, "2", long), (1, 2, "3", "it's"), (1, 3, None, None), (6, 0, "5", "?")]
    assert rows(structures.loop_rejects(frame, "id", "text", "_a"), "id") == [(2,), (3,), (4,)]


def test_structure_ids_below_a_root(spark, tmp_path, rows):
    for folder in ("a", "b c"):
        (tmp_path / folder).mkdir()
        put(tmp_path / folder, "m.v1.cif", "_t.id 1\n")
    texts = structures.structure_texts(spark, str(tmp_path / "*" / "*.cif"), str(tmp_path))
    assert rows(texts, "structure_id") == [("a/m.v1",), ("b c/m.v1",)]
