"""Cleaning and scalar functions (null tokens, numbers, booleans, text, paths, time)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that mean "missing" in the source tables.
MISSING_TOKENS = ("", ".", "?", "NA", "N/A", "NULL", "NONE")

# Spellings read as true / false.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

# Three-letter residue names and their one-letter codes.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}

# Kyte-Doolittle hydropathy (J. Mol. Biol. 157, 1982).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5,
    "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8,
    "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# Sequence motifs counted as liabilities.
LIABILITY_MOTIFS = ("N[GST]", "D[GST]", "M", "W")

# Identifier and digest patterns.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{7,127}$"
TASK_ID = r"^T(?:-1|[0-9]|1[01])$"
ATTEMPT_ID = r"^attempt_[0-9]{3}$"
STATUS_CODE = r"^[A-Z][A-Z0-9_:-]{2,127}$"
SHA256_HEX = r"^[0-9a-f]{64}$"
DATE_TOKEN = r"20\d{6}"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a plain column would be inlined at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def null_token(col, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Trimmed text, or NULL for any missing-value spelling."""
    text = F.trim(_c(col).cast("string"))
    return F.when(~F.upper(text).isin(*tokens), text)


def null_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    return df.withColumns({c: null_token(c, tokens) for c in cols})


def finite(col) -> Column:
    """Double, with text that is no number, NaN and infinities as NULL."""
    number = null_token(col).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def finite_of(df: DataFrame, name: str) -> Column:
    """``finite`` that leaves out the text steps when the column already is a number."""
    if not isinstance(df.schema[name].dataType, T.NumericType):
        return finite(name)
    number = F.col(name).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def to_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_of(df, c) for c in cols})


def parse_bool(col, strict: bool = False) -> Column:
    """Lenient: anything but a true word is false. Strict: unknown words are NULL."""
    word = F.lower(F.trim(_c(col).cast("string")))
    yes = word.isin(*TRUE_WORDS)
    if not strict:
        return F.coalesce(yes, F.lit(False))
    return F.when(yes, True).when(word.isin(*FALSE_WORDS), False)


def to_bool(df: DataFrame, cols: Sequence[str], strict: bool = False):
    """Parsed table; with ``strict`` also the rows whose words are not booleans."""
    if not strict:
        return df.withColumns({c: parse_bool(c) for c in cols})
    bad = F.lit(False)
    for c in cols:
        bad = bad | parse_bool(c, True).isNull()
    return df.filter(~bad).withColumns({c: parse_bool(c, True) for c in cols}), df.filter(bad)


def any_literal(col, literals: Sequence[str]) -> Column:
    """Case-insensitive "contains any of these" as one escaped alternation (P5)."""
    pattern = "|".join(re.escape(x) for x in literals)
    return F.coalesce(_c(col).rlike(f"(?i){pattern}"), F.lit(False))


def is_member(col, values: Sequence) -> Column:
    """Membership flag; NULL is not a member."""
    return F.coalesce(_c(col).isin(*values), F.lit(False))


def overlaps(lo, hi, start, end) -> Column:
    """Closed intervals [lo, hi] and [start, end] meet; a missing bound never does."""
    return F.coalesce((_c(end) >= _c(lo)) & (_c(start) <= _c(hi)), F.lit(False))


def text_sha256(col) -> Column:
    return F.sha2(_c(col).cast("string"), 256)


def canonical_json(cols: Sequence[str]) -> Column:
    """JSON object with keys in alphabetical order, so equal content gives equal text (F1)."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def parse_position(auth, ins) -> Column:
    """Struct(base, insertion) from ``12``, ``12A`` or ``12`` + insertion code (F2)."""
    text = null_token(auth)
    base = F.regexp_extract(text, r"^(-?\d+)[A-Za-z]*$", 1)
    suffix = F.regexp_extract(text, r"^-?\d+([A-Za-z]*)$", 1)
    code = F.upper(F.when(suffix != "", suffix).otherwise(F.coalesce(null_token(ins), F.lit(""))))
    return F.when(base != "", F.struct(base.cast("int").alias("base"), code.alias("insertion")))


def bucket(position, regions: dict[str, tuple[int, int]], default: str) -> Column:
    """Name of the first closed range that holds ``position``."""
    value = _c(position)
    out = None
    for name, (start, end) in regions.items():
        hit = value.between(start, end)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def motif_count(col, motifs: Sequence[str] = LIABILITY_MOTIFS) -> Column:
    """Sum of non-overlapping matches over all motifs."""
    return let(_c(col), lambda text: sum((F.regexp_count(text, F.lit(m)) for m in motifs), F.lit(0)))


def clamp(col, lo: float, hi: float) -> Column:
    """Value held inside [lo, hi]; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    value = _c(col)
    return F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), value)))


def quality_score(resolution, r_free, integrity, developability, mapping) -> Column:
    """Weighted template quality; a missing resolution scores 0, a missing r_free 0.5."""
    res = F.coalesce(clamp((3.0 - _c(resolution)) / 2.0, 0.0, 1.0), F.lit(0.0))
    rfree = F.coalesce(clamp((0.35 - _c(r_free)) / 0.20, 0.0, 1.0), F.lit(0.5))
    # Weights 0.7/0.3 inside structure quality, then 0.35/0.30/0.20/0.15.
    structure = 0.7 * res + 0.3 * rfree
    return 0.35 * structure + 0.30 * _c(integrity) + 0.20 * _c(developability) + 0.15 * _c(mapping)


def developability(liabilities, isoelectric) -> Column:
    """Penalty score; 0.5 when the isoelectric point is unknown."""
    drift = F.greatest(F.lit(0.0), F.abs(_c(isoelectric) - 7.4) - 2.0) * 0.08
    score = clamp(1.0 - 0.05 * _c(liabilities) - drift, 0.0, 1.0)
    return F.when(_c(isoelectric).isNull(), 0.5).otherwise(score)


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def hydropathy(seq) -> Column:
    """Mean hydropathy per residue; NULL on an empty text or an unknown letter."""

    def mean(text: Column) -> Column:
        # Letters are counted by what is left without them, not one lambda call per character.
        known = F.length(text) - F.length(F.translate(text, "".join(HYDROPATHY), ""))
        total = F.lit(0.0)
        for letter, value in HYDROPATHY.items():
            total = total + (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))) * F.lit(value)
        return F.when((known == F.length(text)) & (known > 0), total / known)

    return let(_c(seq), mean)


def letters(residue_name) -> Column:
    """One-letter code, ``X`` when the three-letter name is unknown."""
    return F.coalesce(F.try_element_at(_literal_map(RESIDUE_LETTERS), F.upper(_c(residue_name))), F.lit("X"))


def parse_ranges(text) -> Column:
    """``"1..3,7"`` as array<struct<lo,hi>>; NULL unless well formed, ordered and disjoint (F8)."""
    value = F.regexp_replace(_c(text), r"\s", "")
    shape = r"^[1-9]\d*(\.\.[1-9]\d*)?(,[1-9]\d*(\.\.[1-9]\d*)?)*$"
    parts = F.transform(
        F.split(value, ","),
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\d+)", 1).try_cast("int").alias("lo"),
            F.regexp_extract(p, r"(\d+)$", 1).try_cast("int").alias("hi"),
        ),
    )
    rising = F.forall(parts, lambda r: r["lo"] <= r["hi"])
    apart = F.forall(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda i: (F.size(parts) < 2)
        | (F.try_element_at(parts, i - 1)["hi"] < F.try_element_at(parts, i)["lo"]),
    )
    return F.when(value.rlike(shape) & rising & apart, parts)


def expand_ranges(text) -> Column:
    """All positions named by a range text, in order (F8)."""
    return F.flatten(F.transform(parse_ranges(text), lambda r: F.sequence(r["lo"], r["hi"])))


def slice_regions(seq, text) -> Column:
    """The pieces of ``seq`` at each range, in order (F8)."""
    return F.transform(
        parse_ranges(text), lambda r: F.substring(_c(seq), r["lo"], r["hi"] - r["lo"] + 1)
    )


def mask_unchanged(a, b, ranges) -> Column:
    """True when both texts have one length and agree outside the ranges."""
    mask = parse_ranges(ranges)

    def blank(text: Column) -> Column:
        return F.aggregate(
            mask,
            text,
            lambda acc, r: F.concat(
                F.substring(acc, F.lit(1), r["lo"] - 1),
                F.repeat(F.lit("_"), r["hi"] - r["lo"] + 1),
                F.substring(acc, r["hi"] + 1, F.length(acc)),
            ),
        )

    return (F.length(_c(a)) == F.length(_c(b))) & (blank(_c(a)) == blank(_c(b)))


def logical_path(col) -> Column:
    """The path itself when it is a canonical relative POSIX path, else NULL."""
    text = _c(col)
    unsafe = (
        text.isNull() | (text == "") | text.startswith("/") | text.contains("\\")
        | text.rlike(r"(^|/)\.{1,2}(/|$)") | text.contains("//") | text.endswith("/")
    )
    return F.when(~unsafe, text)


def uri_path(col, schemes: Sequence[str] = ("workspace", "repo")) -> Column:
    """Struct(scheme, path) of ``scheme://relative``; NULL for other forms."""
    pattern = rf"^({'|'.join(schemes)})://(.+)$"
    path = logical_path(F.regexp_extract(_c(col), pattern, 2))
    return F.when(
        path.isNotNull(),
        F.struct(F.regexp_extract(_c(col), pattern, 1).alias("scheme"), path.alias("path")),
    )


def head_before_last(col, sep: str = "_") -> Column:
    """Everything before the last separator."""
    text = _c(col)
    n = F.size(F.split(text, re.escape(sep))) - 1
    return F.when(n == 0, text).otherwise(
        F.substring(text, F.lit(1), F.length(text) - F.length(last_token(text, sep)) - len(sep))
    )


def last_token(col, sep: str = "_") -> Column:
    return F.substring_index(_c(col), sep, -1)


def padded_id(prefix: str, number, width: int = 4) -> Column:
    """``PREFIX0007``; numbers wider than ``width`` keep all digits, as ``%04d`` does."""
    text = _c(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def property_lookup(pairs, label: str, name: str | None = None) -> Column:
    """First value in array<struct<label,name,value>> for a label and optional name."""
    hits = F.filter(
        _c(pairs),
        lambda p: (p["label"] == label) & (F.lit(True) if name is None else p["name"].eqNullSafe(F.lit(name))),
    )
    return F.try_element_at(hits, F.lit(1))["value"]


def utc_second(col) -> Column:
    """Timestamp of a strict ``YYYY-MM-DDTHH:MM:SSZ`` text, else NULL."""
    text = _c(col)
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def duration_text(seconds) -> Column:
    """``H hours, M minutes, S seconds``."""
    s = F.floor(_c(seconds))
    return F.format_string(
        "%d hours, %d minutes, %d seconds",
        F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)),
    )


def kib_to_gib(col) -> Column:
    return _c(col) / (1024.0 * 1024.0)


def half_even(col, digits: int) -> Column:
    """Round to fixed digits, halves to the even neighbour."""
    return F.bround(_c(col), digits)


def pretty_bytes(col) -> Column:
    """Whole bytes below 1 KiB, then three decimals of the largest fitting unit."""
    n = _c(col).cast("double")
    out = F.when(F.abs(n) < 1024, F.format_string("%.0f B", n))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), start=1):
        out = out.when(F.abs(n) < 1024.0 ** (power + 1), F.format_string(f"%.3f {unit}", half_even(n / 1024.0**power, 3)))
    return out.otherwise(F.format_string("%.3f TiB", half_even(n / 1024.0**4, 3)))


# Tolerances of the field comparison.
RELATIVE_TOLERANCE = 1e-7
ABSOLUTE_TOLERANCE = 1e-5


def semantic_equal(a, b, rel: float = RELATIVE_TOLERANCE, absolute: float = ABSOLUTE_TOLERANCE) -> Column:
    """Both missing, both numbers within tolerance, or the same text (F16)."""
    left, right = null_token(a), null_token(b)
    x, y = left.try_cast("double"), right.try_cast("double")
    close = F.abs(x - y) <= F.greatest(rel * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute))
    return F.coalesce(
        F.when(left.isNull() & right.isNull(), True)
        .when(left.isNull() | right.isNull(), False)
        .when(x.isNotNull() & y.isNotNull(), close)
        .otherwise(left == right),
        F.lit(False),
    )


def distance3(ax, ay, az, bx, by, bz) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(
        (_c(ax) - _c(bx)) ** 2 + (_c(ay) - _c(by)) ** 2 + (_c(az) - _c(bz)) ** 2
    )


def truncations(seq, windows: dict[str, tuple[int, int]]) -> Column:
    """Array of struct(variant, start, end, sequence) for 1-based closed windows."""
    text = _c(seq)
    rows = [
        F.struct(
            F.lit(name).alias("variant"), F.lit(lo).alias("start"), F.lit(hi).alias("end"),
            F.substring(text, lo, hi - lo + 1).alias("sequence"),
        )
        for name, (lo, hi) in windows.items()
    ]
    return F.filter(F.array(*rows), lambda r: F.length(r["sequence"]) == r["end"] - r["start"] + 1)
