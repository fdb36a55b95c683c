"""Quality rules: a threshold table compiled into one projection, without user functions.

Each rule names a measure and the range it must lie in. Measures are column expressions over the
words and lines of the whole text; one ``select`` evaluates all of them next to the rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.frames import settled

_SPACE = "\\t\\n\\x0B\\f\\r "
WINDOW = 3
SYMBOLS = "#*$%&|<>"  # none is special inside brackets
#: Letters of the script whose languages STOP_WORDS covers: Latin with its accented forms.
LATIN = "A-Za-z\u00C0-\u024F"
MARKS = "!?"
#: What separates the words that are compared with STOP_WORDS, after A-Z are lower-cased.
STRIPPED = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Function words of languages in Latin script, in lower case: English, German, French, Spanish,
#: Italian, Portuguese, Dutch, Swedish, Polish, Turkish, Indonesian.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "with", "for", "as", "was", "on", "are", "it", "an", "this", "have", "not", "be", "by",
    "der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "auf", "ein", "eine", "im", "nicht", "auch", "sich", "für",
    "le", "la", "les", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pas", "pour",
    "el", "los", "las", "y", "de", "por", "con", "para", "una", "del", "se", "lo", "es",
    "il", "di", "che", "non", "per", "sono", "come", "della", "nel",
    "os", "não", "uma", "com", "como", "mais", "dos", "ao",
    "het", "een", "van", "dat", "niet", "voor", "zijn", "op",
    "och", "att", "det", "som", "är", "inte", "av", "till",
    "nie", "się", "na", "jest", "że", "do", "jak", "od",
    "ve", "bir", "bu", "için", "ile", "da", "çok", "olarak",
    "yang", "dan", "ini", "itu", "dengan", "untuk", "tidak", "dari",
)


@dataclass(frozen=True)
class Threshold:
    """``measure`` must be at least ``low`` and at most ``high``, where these are given.

    A measure is null where it says nothing about a text; the rule then holds.
    """

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Threshold("word_length", "latin_word_chars", 2.0, 15.0),
    Threshold("symbols", "symbols_per_word", None, 0.1),
    Threshold("stop_words", "stop_word_ratio", 0.02, None),
    Threshold("exclamations", "marks_per_word", None, 0.5),
    Threshold("lines_repeated", "dup_line_ratio", None, 0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _measured(docs: DataFrame, text: str, keep: str) -> DataFrame:
    """``keep``, base counts and measures."""
    words, lines, n = F.col("_words"), F.col("_lines"), F.col("n_words")
    split = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumns({
        "_words": F.filter(F.split("_text", f"[{_SPACE}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{_SPACE}]")),
    }).withColumn("n_words", F.size("_words").cast("long"))
    hashes = F.transform(
        F.slice(words, 1, F.greatest(n.cast("int") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    # A window's place in the low bits, its fingerprint above: one sort of longs brings equals together.
    bits = F.greatest(F.ceil(F.log2(n.cast("double"))), F.lit(1)).cast("int")
    placed = split.withColumns({"_hashes": hashes, "_bits": bits})
    packed = F.sort_array(F.transform("_hashes", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i)))
    placed = placed.withColumns({"_packed": packed, "_mask": F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1})
    full = lambda key: F.get(F.col("_hashes"), key.bitwiseAND(F.col("_mask")).cast("int"))
    above = lambda key: F.call_function("shiftright", key, F.col("_bits"))
    same = lambda key, other: (above(key) == above(other)) & (full(key) == full(other))
    repeated = F.filter("_packed", lambda key, i: same(key, F.get("_packed", i - 1)) | same(key, F.get("_packed", i + 1)))
    placed = placed.withColumn("_at", F.sort_array(F.transform(repeated, lambda key: key.bitwiseAND(F.col("_mask")))))
    # Each repeated window adds the words that the next one doesn't start with.
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW).cast("long")))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    counted = placed.withColumns({
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
        "_stops": F.size(F.filter(F.split(F.translate("_text", _UPPER, _LOWER), f"[{STRIPPED}]+"), lambda w: w.isin(*STOP_WORDS))),
        "_marks": F.length("_text") - F.length(F.translate("_text", MARKS, "")),
        "_latin": F.length("_text") - F.length(F.regexp_replace("_text", f"[{LATIN}]+", "")),
    })
    # Word lengths and function words say something only of a text half of which is Latin letters.
    latin = 2 * F.col("_latin") >= F.col("word_chars")
    measured = counted.withColumns({
        "mean_word_chars": _ratio(F.col("word_chars"), n), "symbols_per_word": _ratio(F.col("n_symbols"), n),
        "latin_word_chars": F.when(latin, _ratio(F.col("word_chars"), n)), "marks_per_word": _ratio(F.col("_marks"), n),
        "stop_word_ratio": F.when(latin, _ratio(F.col("_stops"), n)), "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.size(lines)),
    })
    return settled(measured, keep, *COUNTS, *MEASURES)


MEASURES = ("mean_word_chars", "latin_word_chars", "symbols_per_word", "marks_per_word", "stop_word_ratio", "dup_line_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compiled(rules: Sequence[Threshold]) -> Column:
    """The names of the rules that a row fails, from the threshold table."""
    checks = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (F.col(rule.measure) < rule.low)
        if rule.high is not None:
            bad = bad | (F.col(rule.measure) > rule.high)
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """Id, base counts, measures, ``base_failed``, ``failed_rules`` and ``kept`` of each row.

    Words are runs without white space; null and empty texts have none and fail the base rule;
    measures over nothing are 0. Repeated rows give repeated results. Texts of any length are judged
    whole; other columns are not looked at.
    """
    asked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_source"))
    judged = _measured(asked, "_source", "_id").withColumns({"base_failed": base_failed(), "failed_rules": compiled(rules)})
    return judged.select(F.col("_id").alias(doc_id), *COUNTS, *MEASURES, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def drop_rejected(docs: DataFrame, text: str = "text", rules: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs``, all columns, that pass; no join, the rules run in the same projection.

    Null and empty texts fail. Repeated rows stay or go together; columns may have any names.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_source"))
    judged = _measured(packed, "_source", "_row").filter(~base_failed() & (F.size(compiled(rules)) == 0))
    return judged.select("_row.*")
