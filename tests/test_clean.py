"""Scalar functions on hand-made edge values."""

import json

from pyspark.sql import functions as F

from siftline.functions import clean


def one(spark, column, **values):
    """A single value, from a one-row frame of the given values."""
    df = spark.range(1).select(*[v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return df.select(column.alias("v")).first()["v"]


def many(spark, make, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_null_tokens(spark):
    assert many(spark, clean.null_token, [" x ", "", ".", "?", "na", "N/a", "NULL", "none", None, "nan"]) == ["x"] + [None] * 8 + ["nan"]


def test_finite(spark):
    assert many(spark, clean.finite, ["1.5", " -2e3", "nan", "Infinity", "-inf", "?", "1,5", None]) == [1.5, -2000.0] + [None] * 6
    assert many(spark, clean.finite, [1.0, float("nan"), float("inf"), None], "double") == [1.0, None, None, None]


def test_booleans(spark):
    words = ["TRUE", "1", " yes ", "y", "no", "0", "maybe", None]
    assert many(spark, clean.parse_bool, words) == [True] * 4 + [False] * 4
    assert many(spark, lambda c: clean.parse_bool(c, True), words) == [True] * 4 + [False, False, None, None]
    df = spark.createDataFrame([(1, "true"), (2, "maybe")], "id int, flag string")
    good, bad = clean.to_bool(df, ["flag"], strict=True)
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in bad.collect()] == [2]


def test_positions(spark):
    df = spark.createDataFrame([("12", "a"), ("12B", "a"), ("-3", "?"), ("x", ""), (None, None)], "a string, i string")
    got = [tuple(r["p"]) if r["p"] else None for r in df.select(clean.parse_position("a", "i").alias("p")).collect()]
    assert got == [(12, "A"), (12, "B"), (-3, ""), None, None]


def test_ranges(spark):
    shape = lambda c: clean.expand_ranges(c)
    assert many(spark, shape, ["1..3,7", "2", "3..1", "1..3,3..5", "a", "0..2", "1,,2"]) == [[1, 2, 3, 7], [2], None, None, None, None, None]
    assert one(spark, clean.slice_regions(F.lit("ABCDEFGH"), F.lit("1..3, 7"))) == ["ABC", "G"]


def test_mask(spark):
    check = lambda a, b: one(spark, clean.mask_unchanged(F.lit(a), F.lit(b), F.lit("2..3")))
    assert check("ABCD", "AXYD") and not check("ABCD", "AXYE") and not check("ABCD", "AXYDE")


def test_paths(spark):
    paths = ["a/b.txt", "/a", "a/../b", "a\\b", "a//b", "./a", "a/", "", None, "a/..b"]
    assert many(spark, clean.logical_path, paths) == ["a/b.txt"] + [None] * 8 + ["a/..b"]
    got = many(spark, lambda c: clean.uri_path(c)["path"], ["workspace://a/b", "repo://x", "http://x", "workspace:///x"])
    assert got == ["a/b", "x", None, None]


def test_text_helpers(spark):
    assert many(spark, lambda c: clean.padded_id("D", c), [7, 12345], "int") == ["D0007", "D12345"]
    assert many(spark, clean.head_before_last, ["a_b_c", "abc"]) == ["a_b", "abc"]
    assert many(spark, clean.last_token, ["a_b_c", "abc"]) == ["c", "abc"]
    assert many(spark, clean.letters, ["ala", "TRP", "MSE"]) == ["A", "W", "X"]
    assert many(spark, clean.motif_count, ["NGDSMW", "NNG", ""]) == [4, 1, 0]
    assert many(spark, lambda c: F.round(clean.hydropathy(c), 4), ["AR", "AX", ""]) == [-1.35, None, None]


def test_time_and_size(spark):
    good = many(spark, clean.utc_second, ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05", "2026-13-02T03:04:05Z", None])
    assert good[0] is not None and good[1:] == [None, None, None]
    assert many(spark, clean.duration_text, [3725.9, 59.0], "double") == ["1 hours, 2 minutes, 5 seconds", "0 hours, 0 minutes, 59 seconds"]
    sizes = many(spark, clean.pretty_bytes, [0, 1023, 1024, 4160, 1024**2, 5 * 1024**3, 3 * 1024**4], "long")
    assert sizes == [f"{v:.3f} {u}" if u != "B" else f"{v:.0f} B" for v, u in
                     [(0, "B"), (1023, "B"), (1, "KiB"), (4160 / 1024, "KiB"), (1, "MiB"), (5, "GiB"), (3, "TiB")]]


def test_semantic_equal(spark):
    df = spark.createDataFrame(
        [("", "NA"), ("1.0", "1.00000001"), ("1", "1.1"), ("x", "x"), ("x", "y"), (None, "0"), ("100000", "100000.005"), ("nan", "nan")], "a string, b string")
    got = [r["e"] for r in df.select(clean.semantic_equal("a", "b").alias("e")).collect()]
    assert got[:7] == [True, True, False, True, False, False, True]


def test_scores(spark):
    assert abs(one(spark, clean.quality_score(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1.0), F.lit(0.5), F.lit(1.0))) - (0.35 * 0.15 + 0.3 + 0.1 + 0.15)) < 1e-12
    assert one(spark, clean.developability(F.lit(2), F.lit(None).cast("double"))) == 0.5
    assert abs(one(spark, clean.developability(F.lit(2), F.lit(10.4))) - (1 - 0.1 - 0.08)) < 1e-12
    assert one(spark, clean.clamp(F.lit(5.0), 0, 1)) == 1.0


def test_json(spark):
    text = one(spark, clean.canonical_json(["b", "a"]), b=1, a="x")
    assert text == json.dumps({"a": "x", "b": 1}, separators=(",", ":"))
    df = spark.createDataFrame([([("Mass", "Exact", "1"), ("Mass", "Mono", "2")],)], "p array<struct<label:string,name:string,value:string>>")
    assert df.select(clean.property_lookup("p", "Mass", "Mono").alias("v"), clean.property_lookup("p", "Mass").alias("w"), clean.property_lookup("p", "None").alias("n")).first() == ("2", "1", None)


def test_overlap_and_bucket(spark):
    df = spark.createDataFrame([(1, 5), (131, 140), (90, 90), (None, 100), (130, 200)], "s int, e int")
    got = [r["o"] for r in df.select(clean.overlaps(F.lit(91), F.lit(130), "s", "e").alias("o")).collect()]
    assert got == [False, False, False, False, True]
    assert many(spark, lambda c: clean.bucket(c, {"FR1": (1, 26), "CDR1": (27, 38)}, "OUT"), [26, 27, 99], "int") == ["FR1", "CDR1", "OUT"]
    cuts = one(spark, F.transform(clean.truncations(F.lit("ABCDE"), {"a": (1, 3), "b": (4, 9)}), lambda r: r["sequence"]))
    assert cuts == ["ABC"]
