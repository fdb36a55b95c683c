"""Secret scans with an incremental ledger of content-addressed blobs, in DataFrame functions only.

Every version of a file is a blob, named by the SHA-256 of its text. A rule has a version; the ledger
holds which (blob, rule version) pairs were scanned and what they gave. A run scans only pairs the
ledger lacks, one carrier row per blob, appends them, and joins findings back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,end:bigint,rank:int,kind:string>>"


@dataclass(frozen=True)
class SecretRule:
    """All leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    ``hint``: a plain pattern that every text with a match contains; it only saves work.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEYS = "(?i:password|passwd|secret|token|api_?key)"
RULES = (
    SecretRule("assign", 1, f"{_KEYS}[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 1),
    SecretRule("access", 1, "AKIA[A-Z0-9]+", 18, hint="AKIA"),
    SecretRule("hex", 1, "[0-9a-f]{16,}", 16),
    SecretRule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+(-----END [A-Z ]*PRIVATE KEY-----)?", 40, hint="-----BEGIN "),
)


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Spans of one rule in code points: gaps and matches alternate, so their lengths add up to places."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda x: F.length(x).cast("long")).alias("size"), F.transform(value, F.length).alias("value"))
    parts = F.filter(parts, lambda p: p["size"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("found"))
    begin = lambda s, p: s["at"] + p["gap"]
    step = lambda s, p: F.struct(
        (begin(s, p) + p["size"]).alias("at"),
        F.when(p["value"] >= rule.least, F.array_append(s["found"], F.struct(
            begin(s, p).alias("start"), (begin(s, p) + p["size"]).alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
        ))).otherwise(s["found"]).alias("found"),
    )
    spans = F.aggregate(parts, start, step, lambda s: s["found"])
    likely = text.rlike(rule.pattern) if rule.hint is None else text.contains(rule.hint)
    return F.when(likely, spans).otherwise(F.array().cast(SPANS))


def scan_blobs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[SecretRule] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings by path, new ledger rows).

    ``ledger`` rows: ``blob``, ``rule`` (kind@version), ``spans``; one row per scanned pair. Findings
    have one row per row of ``docs``: id, ``blob``, ``spans`` sorted by start, then by order of the
    rules. A null text is the blob of the empty text. Equal texts are scanned once, whatever their ids,
    and share their findings; null and repeated ids are fine. Texts of any length are whole; other
    columns are not looked at.
    """
    versions = _versions(docs, doc_id, text)
    new = _unseen(versions, rules, ledger)
    names = [r.name for r in rules]
    known = new if ledger is None else ledger.filter(F.col("rule").isin(names)).select("blob", "rule", "spans").unionByName(new)
    return _by_path(versions, known, doc_id), new


def _versions(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("_path"), body.alias("_text"), F.sha2(body, 256).alias("_blob"))


def _unseen(versions: DataFrame, rules: Sequence[SecretRule], ledger: DataFrame | None) -> DataFrame:
    """(blob, rule, spans) of the pairs that the ledger doesn't have. Copies are put together in map tasks first."""
    names = [r.name for r in rules]
    blobs = versions.groupBy("_blob").agg(F.first("_text").alias("_text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        blobs = blobs.join(seen, F.col("_blob") == F.col("blob"), "left").drop("blob").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
        blobs = blobs.filter(F.size("_seen") < len(names))
    fresh = lambda rule: F.lit(True) if ledger is None else ~F.array_contains("_seen", rule.name)
    scans = F.array(*[F.when(fresh(r), F.struct(F.lit(r.name).alias("rule"), _spans(F.col("_text"), r, k).alias("spans"))) for k, r in enumerate(rules)])
    return blobs.select(F.col("_blob").alias("blob"), F.inline(F.array_compact(scans)))


def _by_path(versions: DataFrame, known: DataFrame, doc_id: str) -> DataFrame:
    # Only blobs with a finding go back to paths; a path without one has no spans.
    found = known.filter(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    paths = versions.select(F.col("_path").alias(doc_id), F.col("_blob").alias("_at"))
    joined = paths.join(found, F.col("_at") == F.col("blob"), "left")
    return joined.select(doc_id, F.col("_at").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


LEDGER = "blob string, rule string, spans " + SPANS


def scan_version(docs: DataFrame, ledger_path: str, doc_id: str = "doc_id", text: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """Findings by path, as ``scan_blobs`` gives them, from a ledger kept at ``ledger_path``.

    Pairs of blob and rule version that the ledger has are not scanned; the others are, and are appended
    to it. The first version of a history makes the ledger. One run at a time may append. A run that
    dies leaves the ledger as it was.
    """
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if there else None
    versions = _versions(docs, doc_id, text)
    _unseen(versions, rules, ledger).write.mode("append").parquet(ledger_path)
    return _by_path(versions, spark.read.schema(LEDGER).parquet(ledger_path).filter(F.col("rule").isin([r.name for r in rules])), doc_id)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each union of touching or overlapping spans replaced; ``spans`` sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda s, x: F.when(
        (x["start"] < s["at"]) | ((x["start"] == s["at"]) & (s["at"] > 0)), F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts")),
    ).otherwise(F.struct(
        x["end"].alias("at"),
        F.concat(s["parts"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).alias("parts"),
    ))
    rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns, with secrets in ``text`` masked.

    Each blob is scanned once and its findings go to all rows that hold it. A null text stays null.
    Repeated rows and null ids are fine; columns may have any names.
    """
    found, _ = scan_blobs(docs, doc_id, text, rules)
    hit = found.filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    keyed = docs.select(F.struct(*docs.columns).alias("own"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("at"))
    joined = keyed.join(hit, F.col("at") == F.col("blob"), "left")
    body = F.col("own")[text]
    clean = F.when(F.col("spans").isNotNull(), masked(body, F.col("spans"))).otherwise(body)
    return joined.select(*[clean.alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns])
