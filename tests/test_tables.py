"""Rules, rankings, summaries, joins, sets and checks on small frames, one change at a time."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import checks, joins, ranking, rules, sets, summary


def test_rules_edges(spark, rows):
    df = spark.createDataFrame([(1, 2.5, 0.0), (2, 2.6, 1.0), (3, float("nan"), None), (4, float("inf"), 0.0)], "id int, a double, b double")
    spec = [rules.Rule(2, "b low", "b", ">=", 0.5), rules.Rule(1, "a cap", "a", "<=", 2.5)]
    long, wide = rules.apply_rules(df, ["id"], spec)
    assert rows(long, "id", "rule_order", "passed") == [(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, True), (3, 1, False), (3, 2, False), (4, 1, False), (4, 2, False)]
    assert rows(wide, "id", "pass_count", "failed_labels", "pass_all_filters")[0] == (1, 1, "b low", False)
    with pytest.raises(ValueError):
        rules.apply_rules(df, ["id"], [rules.Rule(1, "x", "a", "<", 1.0)])


def test_rule_tables(spark):
    table = spark.createDataFrame([(1, "a", "v", "<=", 1.0)], "order int, label string, value_column string, operator string, threshold double")
    assert rules.rules_from_table(table)[0].value_column == "v"
    with pytest.raises(ValueError):
        rules.rules_from_table(table.unionAll(table), limit=1)
    assert len(rules.DEFAULT_FILTERS) == 10 and [r.order for r in rules.DEFAULT_FILTERS] == list(range(1, 11))


def test_prefix_and_never(spark, rows):
    long = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True), (2, 2, False), (2, 3, True)], "id int, rule_order int, passed boolean").withColumn("label", F.lit("x"))
    assert rows(ranking.prefix_pass(long, ["id"], "rule_order", "passed")) == [(1, 1, 2), (2, 1, 2)]
    assert rows(summary.never_passed(long), "rule_order", "evaluated") == [(2, 2)]


def test_first_reason_and_funnel(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, v int")
    out = rules.first_reason(df, [(F.col("v").isNull(), "missing"), (F.col("v") > 10, "large")])
    assert rows(out, "id", "first_exclusion_reason") == [(1, "missing"), (2, "SELECTED"), (3, "large")]
    assert rows(summary.funnel(df, [("all", F.lit(True)), ("known", F.col("v") > 0), ("small", F.col("v") < 10)]), "remaining_count") == [(1,), (2,), (3,)]


def test_policy(spark, rows):
    inv = spark.createDataFrame([("a/runs/x.PT", 10), ("tools/one_off/run.py", 1), ("tools/one_off/run_20240101.py", 9 * 1024 * 1024), ("ok.txt", 1), ("x/.hidden", 1)], "path string, bytes long")
    policy = rules.FilePolicy(blocked_suffixes=rules.DEFAULT_POLICY.blocked_suffixes, blocked_segments=rules.DEFAULT_POLICY.blocked_segments, dated_segment="one_off")
    assert rows(rules.policy_check(inv, policy), "path", "rule") == [
        ("a/runs/x.PT", "blocked_segment"), ("a/runs/x.PT", "blocked_suffix"), ("tools/one_off/run.py", "missing_date"), ("tools/one_off/run_20240101.py", "size_limit")]


def test_sensitive(spark, rows):
    key = "AKIA" + "A" * 16
    df = spark.createDataFrame([(1, "see /Users/me/x"), (2, key), (3, "risk-" + "a" * 30), (4, "x sk-" + "a" * 20), (5, "clean")], "id int, t string")
    assert rows(rules.scan_patterns(df, ["id"], "t")) == [(1, "macOS absolute home path"), (2, "AWS access key"), (4, "OpenAI-style secret")]


def test_intake(spark, rows):
    df = spark.createDataFrame([("AB", 1, 0.5), ("AB", 2, 0.9), ("CX", 3, 0.1), ("DD", 4, 0.3)], "s string, n int, score double")
    out = rules.intake_sequences(df, spark.createDataFrame([("DD",)], "s string"), "s", "score", "C", ["n"])
    assert rows(out) == [("AB", 2, 0.9)]


def test_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 0, 5.0), ("b", 3, 1.0), ("b", 4, 2.0)], "k string, i int, v double")
    assert rows(ranking.argmax_agreement(df, ["k"], "i", F.col("v"), -F.col("v")), "k", "best_a", "best_b", "same_best") == [("a", 0, 0, True), ("b", 4, 3, False)]
    assert rows(ranking.best_or_ambiguous(df, ["k"], [F.col("v").desc()], "i"), "k", "i", "status") == [("a", None, "AMBIGUOUS"), ("b", 4, "OK")]
    assert rows(ranking.keep_last(df, ["k"], "v", ["i"])) == [("a", 0, 5.0), ("b", 4, 2.0)]


def test_contiguity(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 2), ("d", None)], "k string, r int")
    assert rows(ranking.contiguity(df, ["k"], "r"), "k", "contiguous") == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_best_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.best_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_panel(spark):
    data = [("d", "P1", "positive", 0.8), ("d", "P1", "positive", 0.6), ("d", "N1", "negative", 0.3), ("d", "GX", "negative", 0.4)]
    df = spark.createDataFrame(data, "id string, t string, r string, s double").withColumn("c", F.lit(2))
    row = summary.panel_margin(df, "id", "t", "r", "s", "c", 0.6, 0.5, 0.2, 2, "GX").first()
    assert (row["positive_min"], row["negative_max"], row["subset_max"], row["margin"], row["selection_score"], row["passed"]) == (0.7, 0.4, 0.4, 0.3, 0.35, True)
    assert not summary.panel_margin(df, "id", "t", "r", "s", "c", 0.6, 0.5, 0.4, 2).first()["passed"]


def test_peak_gate(spark, rows):
    df = spark.createDataFrame([("a", 90.0, 100.0), ("b", 91.0, 100.0), ("c", 0.0, 100.0), ("d", 5.0, 0.0)], "r string, u double, t double")
    assert rows(summary.peak_gate(df, ["r"], "u", "t"), "r", "within_gate") == [("a", True), ("b", False), ("c", False), ("d", False)]
    raw = summary.peak_gate(df, ["r"], "u", "t")
    told = spark.createDataFrame([("a", 0.5), ("b", 0.91)], "r string, peak double")
    assert rows(summary.forged_peaks(told, raw, ["r"], "peak"), "r") == [("a",)]


def test_weighted_macro(spark):
    df = spark.createDataFrame([("p", "g1", 1.0, 6.0), ("p", "g1", 2.0, 4.0), ("p", "g2", 5.0, 10.0)], "p string, g string, x double, w double")
    assert abs(summary.weighted_macro(df, ["p"], "g", "x", "w").first()["macro_mean"] - (1.4 + 5.0) / 2) < 1e-12


def test_reconcile(spark, rows):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (4, None, 1.0)], "id int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0000000001), (2, "z", 2.5), (3, "q", 0.0), (4, "", 1.0)], "id int, t string, w double")
    assert rows(joins.reconcile(a, b, ["id"], {"s": "t", "v": "w"}), "id", "field", "kind") == [(2, "s", "different"), (2, "v", "different"), (3, "*", "missing_left")]


def test_cross_matrix(spark, rows):
    items = spark.createDataFrame([(i,) for i in range(10)], "c int")
    panel = spark.createDataFrame([(f"s{i:02d}",) for i in range(16)], "s string")
    m = joins.cross_matrix(items, panel, ["s"], F.concat_ws("_", F.col("c").cast("string"), "s"))
    assert m.count() == 160 and m.select("task_id").distinct().count() == 160
    assert "Cartesian" not in m._jdf.queryExecution().executedPlan().toString()
    assert joins.cross_matrix(items, panel.filter("s > 'z'"), ["s"], F.lit("x")).count() == 0


@pytest.mark.parametrize("limit", [1, 20_000])
def test_near_pairs_brute_force(spark, limit):
    vals = [0.0, 0.5, 1.0, 1.0, 1.0, 2.4, 2.5, -0.3, 9.0]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v double")
    want = {(i, j) for i in range(len(vals)) for j in range(i + 1, len(vals)) if abs(vals[i] - vals[j]) <= 1.0}
    got = [tuple(r) for r in joins.near_pairs(df, "id", "v", 1.0, limit=limit).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_longest_prefix(spark, rows):
    df = spark.createDataFrame([(1, "a/b/c"), (2, "ab/c"), (3, "z"), (4, "a")], "id int, p string")
    mounts = spark.createDataFrame([("a", "A"), ("a/b", "AB")], "prefix string, m string")
    assert rows(joins.longest_prefix(df, "id", "p", mounts, "prefix", ["m"]), "id", "m") == [(1, "AB"), (2, None), (3, None), (4, "A")]


def test_globs(spark, rows):
    df = spark.createDataFrame([("a/x.cif",), ("a/b/x.cif",), ("a/x.cifs",)], "p string")
    got = joins.match_patterns(df, "p", {"one": "a/*.cif", "deep": "a/**/*.cif"})
    assert rows(got, "p", "pattern_id") == [("a/b/x.cif", "deep"), ("a/x.cif", "deep"), ("a/x.cif", "one")]


def test_upsert(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    upd = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "id int, v string, n int")
    merged, bad = joins.upsert(base, upd, ["id"], ["v", "n"])
    assert rows(merged) == [(1, "a", None), (2, None, 7)]
    assert rows(bad) == [(3, 1, 0)]


def test_chain(spark, rows):
    r = spark.createDataFrame([("r1", "h1", None), ("r2", "h2", "h1"), ("r3", "h3", "hx"), ("r4", "h1", "h2"), ("r5", "h5", "h3")], "receipt_id string, sha256 string, predecessor_sha256 string")
    assert rows(joins.verify_chain(r)) == [("r1", None, "ROOT"), ("r2", None, "AMBIGUOUS"), ("r3", None, "ORPHAN"), ("r4", "r2", "LINKED"), ("r5", "r3", "LINKED")]


def test_snapshots(spark, rows):
    a = spark.createDataFrame([("p", "1", 5), ("q", "2", 5), ("r", "3", 5)], "path string, sha256 string, bytes long")
    b = spark.createDataFrame([("p", "1", 5), ("q", "9", 6), ("s", "4", 7)], "path string, sha256 string, bytes long")
    assert rows(sets.snapshot_delta(a, b)) == [("q", "modified", 6), ("r", "removed", 0), ("s", "created", 7)]
    assert sets.unchanged(a, a).first()["unchanged"]


def test_stage_sets(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "id string, s string")
    assert rows(sets.stage_sets(df, "id", "s", ["x", "y"])) == [("b", "y")]


def test_cardinality(spark, rows):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("d", 1), ("d", 1), ("e", None), ("e", 0)], "k string, i int")
    assert rows(checks.cardinality(df, ["k"], 2, "i"), "k") == [("b",), ("c",), ("d",), ("e",)]


def test_domain_and_implication(spark, rows):
    df = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.7), (4, None)], "id int, v double")
    assert rows(checks.domain_violations(df, ["id"], "v", [0.0, 0.5, 1.0]), "id") == [(3,), (4,)]
    assert rows(checks.implication(df, F.col("id") > 2, F.col("v") > 0), "id") == [(4,)]


EVENT_KEYS = ["event_id", "outcome", "failure_codes"]


def event_rules():
    return {
        "id_pattern": F.col("event_id").rlike("^[a-z0-9-]{8,}$"), "outcome_enum": F.col("outcome").isin("SUCCESS", "FAILURE", "BLOCKED"),
        "codes": ((F.col("outcome") == "SUCCESS") & (F.size("failure_codes") == 0)) | ((F.col("outcome") != "SUCCESS") & (F.size("failure_codes") > 0)),
    }


@pytest.mark.parametrize("line,reason", [
    ('{"event_id":"evt-00001","outcome":"SUCCESS","failure_codes":[]}', None),
    ('{"event_id":"x","outcome":"SUCCESS","failure_codes":[]}', "id_pattern"),
    ('{"event_id":"evt-00001","outcome":"DONE","failure_codes":["E"]}', "outcome_enum"),
    ('{"event_id":"evt-00001","outcome":"SUCCESS","failure_codes":["E"]}', "codes"),
    ('{"event_id":"evt-00001","outcome":"FAILURE","failure_codes":[]}', "codes"),
    ('{"event_id":"evt-00001","outcome":"SUCCESS","failure_codes":[],"x":1}', "unknown_key"),
    ('{"event_id":"evt-00001","failure_codes":[]}', "missing_key;outcome_enum;codes"),
    ("nope", "not_an_object"),
])
def test_event_validation(spark, line, reason):
    lines = spark.createDataFrame([(line,)], "value string")
    good, bad = checks.validate_events(lines, "value", "event_id string, outcome string, failure_codes array<string>", event_rules(), EVENT_KEYS)
    assert good.count() == (reason is None)
    assert [r["reasons"] for r in bad.collect()] == ([] if reason is None else [reason])


def test_manifest(spark, rows):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, sha256 string")
    inv = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "x"), ("e", "5")], "path string, sha256 string")
    assert rows(checks.manifest_verify(m, inv)) == [("a", "ok"), ("b", "duplicate_entry"), ("c", "hash_mismatch"), ("d", "missing_file"), ("e", "unlisted_file")]


def test_registry(spark, rows):
    batch = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    fresh, refused = checks.new_only(batch, spark.createDataFrame([("c",)], "id string"), "id")
    assert rows(fresh) == [("a",)] and rows(refused) == [("b", "repeated"), ("c", "known")]


def test_arrays_and_maps(spark, rows):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, [1.0, None]), (4, [1.0])], "id int, v array<double>")
    assert rows(checks.array_contracts(df, ["id"], "v", 2), "id", "passed") == [(1, True), (2, False), (3, False), (4, False)]
    m = spark.createDataFrame([(1, {"a": "f" * 64}), (2, {"b": "f" * 64}), (3, {"a": "zz"})], "id int, m map<string,string>")
    assert rows(checks.map_contract(m, ["id"], "m", ["a"], "^[0-9a-f]{64}$")) == [(2, "a", "b", ""), (3, "", "", "a")]


def test_named_checks(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    status = checks.overall_status(checks.run_checks(df, {"two": F.count(F.lit(1)) == 2, "big": F.min("v") > 1})).first()
    assert (status["check_count"], status["failed_checks"], status["status"]) == (2, "big", "FAIL")
    with pytest.raises(ValueError):
        checks.require_columns(df, ["w"])
    with pytest.raises(ValueError):
        checks.require_columns(df.withColumn("w", F.lit(1)), ["w", "v"], exact=True)


def test_readiness(spark, rows):
    want = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "t string")
    tries = spark.createDataFrame([("t1", 1, "ok"), ("t1", 2, "bad"), ("t2", 1, "ok")], "t string, n int, s string")
    assert rows(checks.readiness(want, tries, ["t"], "n", F.col("s") == "ok"), "t", "state") == [("t1", "INCOMPLETE"), ("t2", "READY"), ("t3", "MISSING")]
    assert rows(ranking.latest_complete(tries, ["t"], "n", F.col("s") == "ok"), "t", "n") == [("t1", 1), ("t2", 1)]


def test_salted_join_splits_hot_keys(spark):
    left = spark.range(300).select(F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("l"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (150, "c")], "k long, r string")
    got = joins.salted_join(left, right, ["k"], ["l"], limit=10)
    assert got.count() == left.join(right, "k").count() == 201
    assert got.select("k", "l", "r").distinct().count() == 201


def test_cardinality_needs_the_exact_set(spark, rows):
    data = [("bad", i) for i in (0, 0, 3, 4, 4, 5, 5, 7)] + [("good", i) for i in range(8)] + [("short", 0)]
    df = spark.createDataFrame(data, "k string, i int")
    assert rows(checks.cardinality(df, ["k"], 8, "i")) == [("bad", 8), ("short", 1)]


def test_prefix_pass_counts_rows_not_orders(spark, rows):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 5, False), ("b", 3, True), ("b", 9, True), ("c", 4, False)], "id string, o int, ok boolean")
    assert rows(ranking.prefix_pass(df, ["id"], "o", "ok")) == [("a", 2, 2), ("b", 2, 2), ("c", 0, 0)]


def test_upsert_withholds_repeated_updates(spark, rows):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    updates = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    merged, bad = joins.upsert(base, updates, ["k"], ["v"])
    assert rows(merged) == [(1, "x"), (2, "c")] and rows(bad) == [(1, 2, 1)]


def test_pairs_of_non_finite_and_huge_values(spark, rows):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, inf), (2, nan), (3, None), (4, 1e300), (5, 1e300), (6, -1e300), (7, 1.0), (8, 1.5)], "id int, v double")
    assert rows(joins.near_pairs(df, "id", "v", 1.0), "id_a", "id_b") == [(4, 5), (7, 8)]
    points = df.withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "k": F.lit(1)})
    found = joins.range_pairs(points, points, ["k"], ["v", "y", "z"], 1.0, ["id"], ["id"])
    assert rows(found.filter("id_a < id_b"), "id_a", "id_b") == [(4, 5), (7, 8)]


def test_array_axes_and_tokens(spark, rows):
    shapes = spark.createDataFrame([("a", "x", [2, 3]), ("a", "y", [3]), ("b", "x", [2, 3]), ("b", "y", [4]), ("c", "x", [2, 3]), ("d", "x", [2]), ("d", "y", [3])], "file string, name string, shape array<int>")
    bad = checks.axis_contracts(shapes, ["file"], [("x", 1, "n"), ("y", 0, "n")])
    assert rows(bad, "file", "axis", "arrays") == [("b", "n", 2), ("c", "n", 1), ("d", "n", 1)]
    grid = {"ok": [(0, 0), (1, 1)], "bad": [(0, 0), (0, 1)]}
    cells = [(f, a, t, float((a, t) in on)) for f, on in grid.items() for a in range(3) for t in (0, 1)] + [("gap", 0, 0, 1.0), ("gap", 0, 2, 0.0)]
    resolved = [("ok", 0, True), ("ok", 2, False), ("bad", 0, True), ("bad", 1, True), ("bad", 7, True)]
    found = checks.token_contracts(spark.createDataFrame(cells, "file string, atom int, token int, value double"), spark.createDataFrame(resolved, "file string, atom int, resolved boolean"), ["file"])
    assert rows(found) == [("bad", "resolved_without_one_token", 0), ("bad", "resolved_without_one_token", 1), ("bad", "resolved_without_one_token", 7), ("bad", "several_tokens", 0), ("gap", "empty_token", 2), ("gap", "tokens_not_contiguous", 2)]
