"""File inventories, checksum manifests, logs, record statistics and telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.clean import logical_path


def read_manifest(spark: SparkSession, path, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``<64 hex>  <relative path>`` lines as (sha256, path), and refused lines with a reason."""
    # One or more blanks and an optional star are allowed in the relaxed form.
    pattern = r"^([0-9a-f]{64})  (.+)$" if strict else r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(
        "value", F.lower(F.regexp_extract("value", pattern, 1)).alias("sha256"), F.regexp_extract("value", pattern, 2).alias("path")
    )
    counts = rows.filter(F.col("sha256") != "").groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = rows.join(counts, "path", "left")
    reason = (
        F.when(F.col("sha256") == "", "malformed").when(logical_path("path").isNull(), "unsafe_path")
        .when(F.col("_n").isNotNull(), "duplicate_path")
    )
    judged = marked.withColumn("reason", reason)
    return judged.filter("reason IS NULL").select("sha256", "path"), judged.filter("reason IS NOT NULL").select("value", "reason")


# Cache files that no inventory lists.
CACHE_PATTERN = r"(^|/)(__pycache__/.*|\.DS_Store|.*\.pyc)$"


def file_inventory(spark: SparkSession, roots: Sequence[str] | str, with_hash: bool = True) -> DataFrame:
    """Path, name, suffix, bytes, mtime and SHA-256 of every file below the roots.

    ``with_hash=False`` lists without reading contents. Files are hashed whole, one row each, so
    files above the 2 GB row limit of binaryFile must be listed without a hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    path = F.regexp_replace("path", "^file:/+", "/")
    name = F.element_at(F.split("path", "/"), -1)
    cols = [
        path.alias("path"), name.alias("file_name"), F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)).alias("suffix"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"),
    ]
    if with_hash:
        cols.append(F.sha2("content", 256).alias("sha256"))
    return files.filter(~F.col("path").rlike(CACHE_PATTERN)).select(*cols)


def content_store(inventory: DataFrame, digest: str = "sha256", size: str = "bytes", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """One object per digest, and the path references; one digest with two sizes is flagged."""
    objects = inventory.groupBy(digest).agg(
        F.min(path).alias("stored_path"), F.min(size).alias("object_bytes"), F.count(F.lit(1)).alias("reference_count"),
        (F.min(size) != F.max(size)).alias("size_conflict"),
    )
    return objects, inventory.select(path, digest)


# Wording of a finished stage in a run log.
STAGE_PATTERN = r"✓ Step (.+?) completed successfully in ([0-9]+(?:\.[0-9]+)?)\s*s"


def extract_stage_timings(lines: DataFrame, text: str = "value", keep: Sequence[str] = (), pattern: str = STAGE_PATTERN) -> DataFrame:
    """(stage, seconds) of every finished stage in a log."""
    return lines.filter(F.col(text).rlike(pattern)).select(
        *keep, F.regexp_extract(text, pattern, 1).alias("stage"), F.regexp_extract(text, pattern, 2).cast("double").alias("seconds")
    )


def record_stats(lines: DataFrame, fmt: str, file: str = "file", text: str = "value") -> DataFrame:
    """Records and payload length per file for FASTA, SDF and TSV lines."""
    value = F.col(text)
    starts = {"fasta": value.startswith(">"), "sdf": F.trim(value) == "$$$$", "tsv": F.trim(value) != ""}[fmt]
    payload = {"fasta": ~value.startswith(">"), "sdf": F.lit(False), "tsv": F.trim(value) != ""}[fmt]
    count = F.sum(starts.cast("long"))
    if fmt == "tsv":
        count = F.greatest(count - 1, F.lit(0))  # the header is no record
    length = F.coalesce(F.sum(F.when(payload, F.length(F.trim(value)))), F.lit(0))
    return lines.groupBy(file).agg(count.alias("record_count"), length.cast("long").alias("payload_length"))


def json_list_sizes(docs: DataFrame, file: str, text: str) -> DataFrame:
    """Members of a top-level JSON list per file."""
    return docs.select(file, F.coalesce(F.json_array_length(text), F.lit(0)).cast("long").alias("record_count"))


def mib_value(col) -> Column:
    """``1024 MiB`` or ``1024`` as a number; NULL for any other shape."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.when(text.rlike(r"(?i)^(\d+(\.\d*)?|\.\d+)\s*(mib)?$"), F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double"))


def read_telemetry(spark: SparkSession, path) -> DataFrame:
    """Telemetry CSV with padded headers; memory columns become MiB numbers."""
    df = spark.read.options(header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("telemetry has duplicate columns")
    df = df.toDF(*names)
    found = {}
    for wanted, name in (("memory.used", "used_mib"), ("memory.total", "total_mib")):
        cols = [c for c in names if c.lower().startswith(wanted)]
        if len(cols) != 1:
            raise ValueError(f"telemetry needs exactly one {wanted} column")
        found[name] = mib_value(F.col(f"`{cols[0]}`"))
    rest = [c for c in names if not c.lower().startswith(("memory.used", "memory.total"))]
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in rest], *[v.alias(k) for k, v in found.items()])
