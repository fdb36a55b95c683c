"""Table readers and writers with contracts: CSV/TSV, JSON, JSON lines, registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.checks import require_columns, unique_violations
from siftline.operators.ranking import order_total
from siftline.session import literal_rows

_BOM = "﻿"


def read_table(spark: SparkSession, path, required: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """All-string scan that keeps empty strings; BOM, duplicate and missing columns are handled."""
    head = spark.read.options(header=False, sep=sep, inferSchema=False, emptyValue="", quote='"', escape='"').csv(path).limit(1).first()
    names = [(v or "").lstrip(_BOM) for v in (head or [])]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate columns: {sorted({n for n in names if names.count(n) > 1})}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(header=True, sep=sep, emptyValue="", quote='"', escape='"').schema(schema).csv(path)
    # The scan reads an empty cell as NULL; a string table has no NULLs.
    return require_columns(df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names]), required)


def read_contract_tsv(spark: SparkSession, path, schema, sep: str = "\t") -> DataFrame:
    """Scan with an exact ordered header; a malformed row fails the job."""
    return spark.read.options(header=True, sep=sep, enforceSchema=False, mode="FAILFAST", emptyValue="", nullValue="\x00").schema(schema).csv(path)


def read_json(spark: SparkSession, path, schema, explode: str | None = None, per_line: bool = False) -> DataFrame:
    """JSON documents, one per file or one per line; one array may be exploded to rows (S3)."""
    df = spark.read.options(multiLine=not per_line, mode="FAILFAST").schema(schema).json(path)
    return df if explode is None else df.select(F.explode(explode).alias("item")).select("item.*")


def read_jsonl(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and rejected lines with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn(
        "_e", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    # The parser ignores text after the first object; as a list member it is malformed.
    single = F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1
    bad = F.col("_e").isNull() | F.col("_e._corrupt_record").isNotNull() | ~F.coalesce(single, F.lit(False))
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    return parsed.filter(~bad).select(*[F.col(f"_e.{f}").alias(f) for f in fields]), parsed.filter(bad).select("file", "value")


def read_queryable(spark: SparkSession, path, view: str) -> DataFrame:
    """Typed CSV scan registered as a view for SQL text."""
    df = spark.read.options(header=True, inferSchema=True).csv(path)
    df.createOrReplaceTempView(view)
    return df


def run_sql(spark: SparkSession, views: dict[str, DataFrame], text: str) -> DataFrame:
    """SQL text over named tables."""
    return spark.sql(text, **views)


def fit_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones become NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence = (), fmt: str = "csv", sep: str = "\t") -> None:
    """Delimited sink with fixed columns and a stable sort, kept as many sorted files."""
    out = df if columns is None else fit_columns(df, columns)
    out = order_total(out, order) if order else out
    # Quoted, so that an empty string and a missing value stay apart when read back.
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": ""} if fmt == "csv" else {}
    out.write.mode("errorifexists").format(fmt).options(**options).save(path)


def write_registry(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], meta: dict[str, str], path: str) -> None:
    """Parquet table per name after its key is proven unique, and a key/value table."""
    for name, key in keys.items():
        if not unique_violations(tables[name], key).isEmpty():
            raise ValueError(f"table {name}: key {list(key)} is not unique")
    for name, df in tables.items():
        write_new(df, f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    write_new(literal_rows(spark, sorted(meta.items()), ["key", "value"]), f"{path}/metadata")


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Refuse to replace existing output."""
    df.write.mode("errorifexists").format(fmt).save(path)


def check_published(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows that differ from the published table, labelled by side; empty means current."""
    published = df.sparkSession.read.schema(df.schema).format(fmt).load(path).select(*df.columns)
    # Counting both sides in one aggregation keeps duplicates exact, as a bag difference.
    marks = df.select("*", F.lit(1).alias("_n")).unionAll(published.select("*", F.lit(-1).alias("_n")))
    net = marks.groupBy(*df.columns).agg(F.sum("_n").alias("_net")).filter(F.col("_net") != 0)
    return net.select(*df.columns, F.when(F.col("_net") > 0, "new").otherwise("stale").alias("side"), F.abs("_net").alias("row_count"))


def read_registry(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def typed(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Columns coerced one by one; text that does not fit becomes NULL."""
    cols: dict[str, Column] = {c: F.col(c).try_cast(t) for c, t in casts.items()}
    return df.withColumns(cols)
