"""Structure and array files: fixed-width atom lines, tagged loops, NPZ archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.clean import finite, null_token
from siftline.operators.cluster import closure
from siftline.session import stage_table

# Fields of an atom line as (name, first column, width), columns counted from 1.
ATOM_FIELDS = (
    ("group_PDB", 1, 6), ("atom_name", 13, 4), ("alt_id", 17, 1), ("comp_id", 18, 3), ("auth_asym_id", 22, 1),
    ("auth_seq_id", 23, 4), ("ins_code", 27, 1), ("x", 31, 8), ("y", 39, 8), ("z", 47, 8),
    ("occupancy", 55, 6), ("b_factor", 61, 6), ("element", 77, 2),
)
_NUMBERS = ("x", "y", "z", "occupancy", "b_factor")


def parse_atom_lines(files: DataFrame, id_col: str, text: str) -> DataFrame:
    """Atom rows of whole fixed-width texts with their MODEL number.

    A text is split at its MODEL lines, so the model number is a position and not a running count.
    """
    blocks = files.select(id_col, F.posexplode(F.split(text, r"(?m)^(?=MODEL )")).alias("_block", "_text"))
    lines = blocks.select(
        id_col, "_block", F.coalesce(F.regexp_extract("_text", r"^MODEL\s+(\d+)", 1).try_cast("int"), F.lit(1)).alias("model_num"),
        F.posexplode(F.split("_text", r"\r?\n")).alias("_line", "_row"),
    )
    atoms = lines.filter(F.substring("_row", 1, 6).isin("ATOM  ", "HETATM") & (F.length("_row") >= 54))
    cols = []
    for name, start, width in ATOM_FIELDS:
        cell = F.trim(F.substring("_row", start, width))
        cols.append((finite(cell) if name in _NUMBERS else cell).alias(name))
    order = F.col("_block").cast("long") * F.lit(1 << 32) + F.col("_line")
    return atoms.select(id_col, "model_num", order.alias("line_order"), *cols)


def structure_texts(spark: SparkSession, paths, root: str | None = None) -> DataFrame:
    """(structure_id, value): whole files. The id is the path below ``root`` without its suffix.

    Without ``root`` it is the bare file name, which must then be unique.
    """
    files = spark.read.text(paths, wholetext=True)
    if root is None:
        name = F.col("_metadata.file_name")
    else:
        name = F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), root.rstrip("/") + "/", -1)
    return files.select(F.regexp_replace(name, r"\.[^./]*$", "").alias("structure_id"), "value")


def read_pdb_atoms(spark: SparkSession, paths, root: str | None = None) -> DataFrame:
    """Atoms of fixed-width structure files, one file per input row."""
    files = structure_texts(spark, paths, root)
    return parse_atom_lines(files, "structure_id", "value")


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, bare) of a tagged text, line by line; quoted values and text fields are not bare.

    Raises ValueError on a quote or text field that is still open at its end.
    """
    field: list[str] | None = None
    for number, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), start=1):
        if field is not None:
            if not line.startswith(";"):
                field.append(line)
                continue
            yield "\n".join(field), False
            field, line = None, line[1:]
        elif line.startswith(";"):
            field = [line[1:]]
            continue
        at = 0
        while at < len(line):
            if line[at].isspace():
                at += 1
            elif line[at] == "#":
                break
            elif line[at] in "'\"":
                end = line.find(line[at], at + 1)
                while 0 <= end < len(line) - 1 and not line[end + 1].isspace():
                    end = line.find(line[at], end + 1)
                if end < 0:
                    raise ValueError(f"open quote in line {number}")
                yield line[at + 1 : end], False
                at = end + 1
            else:
                word = line[at:].split(None, 1)[0]
                yield word, True
                at += len(word)
    if field is not None:
        raise ValueError("open text field")


def cif_rows(text: str, category: str, columns: Sequence[str]) -> list[list[str | None]]:
    """Rows of one category, a loop or single items, in the order of ``columns``; names ignore case."""
    prefix, wanted = category.lower() + ".", [c.lower() for c in columns]
    rows: list[list[str | None]] = []
    single: dict[str, str] = {}
    tags: list[str] = []
    values: list[str] = []
    state, tag = "", ""  # state: "" between items, "tags" and "values" of a loop, "item" after a lone tag

    def close() -> None:
        if tags and tags[0].startswith(prefix):
            if len(values) % len(tags):
                raise ValueError(f"incomplete row in {category}")
            at = {t.removeprefix(prefix): k for k, t in enumerate(tags)}
            for k in range(0, len(values), len(tags)):
                rows.append([values[k + at[c]] if c in at else None for c in wanted])
        tags.clear()
        values.clear()

    for token, bare in cif_tokens(text):
        word = token.lower() if bare else ""
        if bare and (word.startswith(("data_", "save_", "loop_", "global_", "stop_")) or (word.startswith("_") and state != "item")):
            if state == "item":
                raise ValueError(f"no value for {tag}")
            if word.startswith("_"):
                if state == "tags":
                    tags.append(word)
                    continue
                close()
                state, tag = "item", word
            else:
                close()
                state = "tags" if word == "loop_" else ""
        elif state == "item":
            if tag.startswith(prefix):
                single[tag.removeprefix(prefix)] = token
            state = ""
        elif state in ("tags", "values"):
            state = "values"
            values.append(token)
        else:
            raise ValueError(f"value without a tag: {token[:40]}")
    if state == "item":
        raise ValueError(f"no value for {tag}")
    close()
    return rows + ([[single.get(c) for c in wanted]] if single else [])


def _looped(files: DataFrame, id_col: str, text: str, category: str, columns: Sequence[str]) -> DataFrame:
    """(id, row_order, values, reject): a text that can't be read gives one row, with the reason."""
    names = list(columns)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body in enumerate(batch.column(1).to_pylist()):
                try:
                    rows, reject = cif_rows(body or "", category, names), None
                except ValueError as e:
                    rows, reject = [[]], str(e)
                if rows:
                    ids = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(rows)) if len(rows) < 2 else batch.column(0).take(pa.array([k] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string())), pa.array([reject] * len(rows), pa.string())], names=["id", "row_order", "row", "reject"])

    return files.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(parse, f"id {dict(files.dtypes)[id_col]}, row_order int, row array<string>, reject string")


def parse_loops(files: DataFrame, id_col: str, text: str, category: str, columns: Sequence[str]) -> DataFrame:
    """Rows of one category of whole texts as string columns.

    Absent columns are NULL; ``?`` and ``.`` stay as written. A text with an open quote, an
    incomplete row or a value out of place gives no rows; ``loop_rejects`` lists it.
    """
    found = _looped(files, id_col, text, category, columns).filter("reject IS NULL")
    return found.select(F.col("id").alias(id_col), "row_order", *[F.get("row", k).alias(c) for k, c in enumerate(columns)])


def loop_rejects(files: DataFrame, id_col: str, text: str, category: str) -> DataFrame:
    """Texts whose category can't be read, with the reason."""
    return _looped(files, id_col, text, category, []).filter("reject IS NOT NULL").select(F.col("id").alias(id_col), "reject")


# atom_site items read, as (item, column).
ATOM_ITEMS = (
    ("group_PDB", "group_PDB"), ("type_symbol", "element"), ("label_atom_id", "atom_name"), ("label_alt_id", "alt_id"),
    ("label_comp_id", "comp_id"), ("label_asym_id", "label_asym_id"), ("auth_asym_id", "auth_asym_id"),
    ("label_entity_id", "entity_id"), ("label_seq_id", "label_seq_id"), ("auth_seq_id", "auth_seq_id"),
    ("pdbx_PDB_ins_code", "ins_code"), ("pdbx_PDB_model_num", "model_num"), ("Cartn_x", "x"), ("Cartn_y", "y"),
    ("Cartn_z", "z"), ("occupancy", "occupancy"), ("B_iso_or_equiv", "b_factor"),
)


def atom_site(files: DataFrame, id_col: str, text: str) -> DataFrame:
    """Typed atom rows of structure texts."""
    raw = parse_loops(files, id_col, text, "_atom_site", [i for i, _ in ATOM_ITEMS])
    cols = []
    for item, name in ATOM_ITEMS:
        if name in _NUMBERS:
            cols.append(finite(item).alias(name))
        elif name in ("label_seq_id", "model_num"):
            cols.append(finite(item).cast("int").alias(name))
        else:
            cols.append(null_token(item).alias(name))
    return raw.select(id_col, F.col("row_order").alias("line_order"), *cols)


def read_mmcif(spark: SparkSession, paths, categories: dict[str, Sequence[str]], wanted: DataFrame | None = None, root: str | None = None) -> dict[str, DataFrame]:
    """Tables of the named categories; ``wanted`` ids are selected before anything is parsed."""
    files = structure_texts(spark, paths, root)
    if wanted is not None:
        files = files.join(wanted.select("structure_id").distinct(), "structure_id", "left_semi")
    return {
        c: atom_site(files, "structure_id", "value") if c == "_atom_site" else parse_loops(files, "structure_id", "value", c, cols)
        for c, cols in categories.items()
    }


def _members(suffix: str):
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for item in archive:
                        if item.isfile() and item.name.endswith(suffix):
                            yield pd.DataFrame({"member": [item.name], "value": [archive.extractfile(item).read().decode("utf-8", "replace")]})

    return members


def _named(texts: DataFrame, wanted: DataFrame | None, suffix: str, by_path: bool) -> DataFrame:
    path = F.substring(F.col("member"), F.lit(1), F.length("member") - len(suffix))
    named = texts.select((path if by_path else F.substring_index(path, "/", -1)).alias("structure_id"), "member", "value")
    return named if wanted is None else named.join(wanted.select("structure_id").distinct(), "structure_id", "left_semi")


def read_archives(spark: SparkSession, paths, wanted: DataFrame | None = None, suffix: str = ".cif", by_path: bool = False) -> DataFrame:
    """Structure texts inside compressed tar archives as (structure_id, member, value).

    A compressed archive cannot be split and is one row: many of moderate size spread well; a large plain
    one is for ``read_plain_archive``. The id is the bare name of the member, which must then be unique,
    or its path in the archive ``by_path``. Wanted members are kept before anything is parsed.
    """
    files = spark.read.format("binaryFile").load(paths).select("content")
    return _named(files.mapInPandas(_members(suffix), "member string, value string"), wanted, suffix, by_path)


BLOCK = 512  # bytes of a tar block
_LONG_NAME, _EXTENDED = "L", "x"


def _header(record: tuple[bytes, int]) -> list[tuple[int, int, str, str, int]]:
    """(place, place after the data, type, name, size) of a block that reads as a member header."""
    block, at = record
    try:
        item = tarfile.TarInfo.frombuf(bytes(block), "utf-8", "surrogateescape")
    except tarfile.HeaderError:
        return []
    kind = item.type.decode("latin-1")
    size = item.size if item.isreg() or kind in (_LONG_NAME, "K", _EXTENDED, "g", "X") else 0
    return [(at, at + 1 + -(-size // BLOCK), kind, item.name, size)]


def _joined(table: pa.Table) -> pa.Table:
    """The data blocks of one member, in order, without the filling of the last."""
    table = table.sort_by("block")
    data = b"".join(table.column("content").to_pylist())[: table.column("size")[0].as_py()]
    return pa.table({"at": table.column("at").slice(0, 1), "data": pa.array([data], pa.binary())})


def _real_name(kind, data):
    """The name that an extra header gives the member after it."""
    if kind == _LONG_NAME:
        return data.rstrip(b"\0").decode("utf-8", "surrogateescape")
    while data:
        length = int(data.split(b" ", 1)[0])
        key, _, value = data[:length].split(b" ", 1)[1].partition(b"=")
        if key == b"path":
            return value[:-1].decode("utf-8", "surrogateescape")
        data = data[length:]
    return None


def read_plain_archive(spark: SparkSession, path: str, wanted: DataFrame | None = None, suffix: str = ".cif", by_path: bool = True) -> DataFrame:
    """Structure texts inside one uncompressed tar of any size, read in splits.

    The archive is a row of 512-byte blocks, which Hadoop's fixed-length reader splits. Any block may
    look like a header, also inside a member, but only those that lie on the chain from the first block
    on are; the chain is followed by ``closure``, in rounds in the order of its logarithm. Data blocks
    are moved for members of the wanted suffix only. A member's text is one cell.
    """
    blocks = spark.sparkContext.binaryRecords(path, BLOCK).zipWithIndex()
    found = spark.createDataFrame(blocks.flatMap(_header), "at long, next long, kind string, name string, size long")
    found = stage_table(found, "headers")
    first = spark.range(1).select(F.col("id").alias("node"))
    chain = closure(found.select("at", "next"), first, "at", "next")
    headers = stage_table(found.join(chain, F.col("at") == F.col("node")).drop("node"), "chain")
    rows = spark.createDataFrame(blocks.map(lambda x: (x[1], bytearray(x[0]))), "block long, content binary")

    def data(members: DataFrame) -> DataFrame:
        """(at, data) of members with any data."""
        parts = members.filter("size > 0").select("at", "size", F.explode(F.sequence(F.col("at") + 1, F.col("next") - 1)).alias("block"))
        return parts.join(rows, "block").groupBy("at").applyInArrow(_joined, "at long, data binary")

    extra = headers.filter(F.col("kind").isin(_LONG_NAME, _EXTENDED))
    given = F.udf(_real_name, "string")  # one short row for each long name
    names = extra.join(data(extra), "at").select(given("kind", "data").alias("_given"), (F.col("depth") + 1).alias("depth"))
    named = headers.join(names, "depth", "left").withColumn("member", F.coalesce("_given", "name"))
    members = named.filter(F.col("kind").isin("0", "\0", "7") & F.col("member").endswith(suffix))
    body = members.join(data(members), "at", "left")
    texts = body.select("member", F.coalesce(F.decode("data", "UTF-8"), F.lit("")).alias("value"))
    return _named(texts, wanted, suffix, by_path)


NPZ_CHUNK, NPZ_ARRAYS = 65_536, 4096  # numbers, and arrays, of one batch
NPZ_SCHEMA_ROWS = "file string, name string, dtype string, shape array<int>"
NPZ_VALUE_ROWS = "file string, name string, sample_index long, position array<int>, value double"


def _npz_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, np.ndarray]]:
    """File, name and array, one array at a time."""
    for batch in batches:
        for path, content in zip(batch.column("file"), batch.column("content")):
            with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as arrays:
                for k in arrays.files:
                    yield path.as_py(), k, arrays[k]


def _npz_schema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ((path, k, str(a.dtype), list(a.shape)) for path, k, a in _npz_arrays(batches))
    types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))
    while rows := list(islice(found, NPZ_ARRAYS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "name", "dtype", "shape"])


def _npz_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "name", "sample_index", "position", "value"]
    parts, held = [], 0
    for path, k, a in _npz_arrays(batches):
        if a.dtype.kind not in "fiub":
            continue
        flat = a.reshape(-1)
        for low in range(0, flat.size, NPZ_CHUNK):
            at = np.arange(low, min(low + NPZ_CHUNK, flat.size))
            places = np.stack(np.unravel_index(at, a.shape), axis=1) if a.ndim else np.zeros((len(at), 0))
            position = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * a.ndim, pa.int32()), pa.array(places.reshape(-1).astype("int32")))
            value = pa.array(flat[low : low + len(at)].astype("float64"), from_pandas=True)
            parts.append([pa.repeat(path, len(at)), pa.repeat(k, len(at)), pa.array(at, pa.int64()), position, value])
            held += len(at)
            if held >= NPZ_CHUNK:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=names)
                parts, held = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=names)


def npz_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Array schema rows, and one row per number of every numeric array of any rank.

    ``position`` has the place along each axis, ``sample_index`` the place in row-major order.
    """
    return files.mapInArrow(_npz_schema, NPZ_SCHEMA_ROWS), files.mapInArrow(_npz_values, NPZ_VALUE_ROWS)


def read_npz(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """``npz_tables`` over NPZ files."""
    files = spark.read.format("binaryFile").load(paths)
    return npz_tables(files.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "content"))
