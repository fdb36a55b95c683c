"""Threshold rules, flags, markers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import clean
from siftline.operators import ranking, rules, summary
from siftline.plans.registry import query

LINE_RULES = (
    rules.Rule(1, "quantity", "l_quantity", "<=", 40.0, "count"),
    rules.Rule(2, "price", "l_extendedprice", ">=", 5000.0, "money"),
    rules.Rule(3, "discount", "l_discount", "<=", 0.08, "fraction"),
    rules.Rule(4, "tax", "l_tax", "<=", 0.06, "fraction"),
)
_VALUES = "(VALUES (1,'quantity','<=',40.0::DOUBLE,'count'),(2,'price','>=',5000.0,'money'),(3,'discount','<=',0.08,'fraction'),(4,'tax','<=',0.06,'fraction')) r(rule_order,label,operator,threshold,unit)"
_LONG = f"""SELECT l_orderkey, l_linenumber, l_partkey, rule_order, label, operator, threshold, unit,
  CASE label WHEN 'quantity' THEN l_quantity WHEN 'price' THEN l_extendedprice WHEN 'discount' THEN l_discount ELSE l_tax END AS observed_value
  FROM lineitem, {_VALUES}"""
_JUDGED = f"SELECT *, CASE WHEN operator = '<=' THEN observed_value <= threshold ELSE observed_value >= threshold END AS passed FROM ({_LONG})"
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey"]


def _long(t):
    cols = [*LINE_ID, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rules.apply_rules(t.lineitem.select(*cols), LINE_ID, LINE_RULES)


@query("apply_rules_long", f"SELECT l_orderkey, l_linenumber, l_partkey, rule_order, label, observed_value, operator, threshold, unit, passed FROM ({_JUDGED})")
def apply_rules_long(spark, t):
    return _long(t)[0].drop("value_column")


@query("apply_rules_wide", """
SELECT l_orderkey, l_linenumber, l_partkey,
  (l_quantity <= 40)::BIGINT + (l_extendedprice >= 5000)::BIGINT + (l_discount <= 0.08)::BIGINT + (l_tax <= 0.06)::BIGINT AS pass_count,
  concat_ws(';', CASE WHEN l_quantity > 40 THEN 'quantity' END, CASE WHEN l_extendedprice < 5000 THEN 'price' END,
    CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.06 THEN 'tax' END) AS failed_labels,
  l_quantity <= 40 AND l_extendedprice >= 5000 AND l_discount <= 0.08 AND l_tax <= 0.06 AS pass_all_filters FROM lineitem""")
def apply_rules_wide(spark, t):
    wide = _long(t)[1]
    return wide.select(*LINE_ID, F.col("pass_count").cast("long").alias("pass_count"), "failed_labels", "pass_all_filters")


@query("rules_summary", f"""
SELECT rule_order, label, count(*) AS evaluated, count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count,
  round(count(*) FILTER (NOT passed) / count(*), 6) AS failure_rate FROM ({_JUDGED}) GROUP BY 1, 2""")
def rules_summary(spark, t):
    return summary.rule_summary(_long(t)[0]).withColumn("failure_rate", F.round("failure_rate", 6))


@query("never_passed", f"""
SELECT l_orderkey, rule_order, label, count(*) AS evaluated FROM ({_JUDGED}) GROUP BY 1, 2, 3 HAVING NOT bool_or(passed)""")
def never_passed(spark, t):
    return summary.never_passed(_long(t)[0], ["l_orderkey", "rule_order", "label"])


PART_RULES = (
    rules.Rule(1, "size", "p_size", "<=", 35.0), rules.Rule(2, "price floor", "p_retailprice", ">=", 950.0),
    rules.Rule(3, "price cap", "p_retailprice", "<=", 1050.0),
)


@query("prefix_pass", """
WITH x AS (SELECT p_partkey, p_size <= 35 AS a, p_retailprice >= 950 AS b, p_retailprice <= 1050 AS c FROM part)
SELECT p_partkey, a::BIGINT + (a AND b)::BIGINT + (a AND b AND c)::BIGINT AS prefix_pass_count, a::BIGINT + b::BIGINT + c::BIGINT AS pass_count FROM x""")
def prefix_pass(spark, t):
    long, _ = rules.apply_rules(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"], PART_RULES)
    return ranking.prefix_pass(long, ["p_partkey"], "rule_order", "passed")


@query("flag_reconcile", """
SELECT l_orderkey, l_linenumber, l_partkey, 'returned' AS flag, (l_returnflag = 'R') AS reported, (l_shipdate < TIMESTAMP '1998-06-01') AS recomputed
FROM lineitem WHERE (l_returnflag = 'R') IS DISTINCT FROM (l_shipdate < TIMESTAMP '1998-06-01')""")
def flag_reconcile(spark, t):
    lines = t.lineitem.select(*LINE_ID, "l_shipdate", (F.col("l_returnflag") == "R").alias("returned"))
    return rules.reconcile_flags(lines, LINE_ID, {"returned": F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))})


@query("bounds_overlap", """
SELECT conv_id, lo, hi FROM (SELECT conv_id, min(length(text)) AS lo, max(length(text)) AS hi FROM conversations GROUP BY 1) WHERE hi >= 91 AND lo <= 130""")
def bounds_overlap(spark, t):
    spans = t.conversations.groupBy("conv_id").agg(F.min(F.length("text")).cast("long").alias("lo"), F.max(F.length("text")).cast("long").alias("hi"))
    return spans.filter(clean.overlaps(F.lit(91), F.lit(130), "lo", "hi"))


_TOKENS = """CASE event_type WHEN 'error' THEN ' n/a ' WHEN 'signup' THEN '?' WHEN 'view' THEN 'nan' ELSE ' ' || json_extract_string(props, '$.k') || ' ' END"""


@query("null_tokens", f"""
WITH x AS (SELECT event_id, event_type, {_TOKENS} AS raw FROM events)
SELECT event_id, CASE WHEN upper(trim(raw)) IN ('', '.', '?', 'NA', 'N/A', 'NULL', 'NONE') THEN NULL ELSE trim(raw) END AS cleaned,
  CASE WHEN isfinite(TRY_CAST(trim(raw) AS DOUBLE)) THEN TRY_CAST(trim(raw) AS DOUBLE) END AS number,
  coalesce(lower(trim(raw)) IN ('true', '1', 'yes', 'y'), false) AS lenient_flag,
  CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(raw)) IN ('false', '0', 'no', 'n') THEN false END AS strict_flag,
  event_type IN ('view', 'click') AS is_active
FROM x""")
def null_tokens(spark, t):
    k = F.get_json_object("props", "$.k")
    raw = (F.when(F.col("event_type") == "error", " n/a ").when(F.col("event_type") == "signup", "?")
           .when(F.col("event_type") == "view", "nan").otherwise(F.concat(F.lit(" "), k, F.lit(" "))))
    x = t.events.select("event_id", "event_type", raw.alias("raw"))
    return x.select("event_id", clean.null_token("raw").alias("cleaned"), clean.finite("raw").alias("number"),
                    clean.parse_bool("raw").alias("lenient_flag"), clean.parse_bool("raw", True).alias("strict_flag"),
                    clean.is_member("event_type", ("view", "click")).alias("is_active"))


@query("marker_violations", """
SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text || '|' || source || '|' || lang), 'lorem|src13|confidential|password')""")
def marker_violations(spark, t):
    docs = t.documents.select("doc_id", "source", "lang", "text")
    return rules.forbid_markers(docs, ["text", "source", "lang"], ["Lorem", "SRC13", "confidential", "password"]).select("doc_id", "source")


@query("quality_score", """
WITH x AS (SELECT p_partkey, p_size / 10.0 AS res, CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 5000.0 END AS rf, p_size % 5 AS liab,
  CASE WHEN p_size % 11 <> 0 THEN 4.0 + p_size / 8.0 END AS pi FROM part)
SELECT p_partkey, round(0.35 * (0.7 * coalesce(greatest(0.0, least(1.0, (3.0 - res) / 2.0)), 0.0) + 0.3 * CASE WHEN rf IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, (0.35 - rf) / 0.20)) END)
  + 0.30 * 1.0 + 0.20 * CASE WHEN pi IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - 0.05 * liab - greatest(0.0, abs(pi - 7.4) - 2.0) * 0.08)) END + 0.15 * 0.5, 8) AS quality_score FROM x""")
def quality_score(spark, t):
    size = F.col("p_size")
    x = t.part.select("p_partkey", (size / 10.0).alias("res"), F.when(size % 7 != 0, F.col("p_retailprice") / 5000.0).alias("rf"),
                      (size % 5).alias("liab"), F.when(size % 11 != 0, 4.0 + size / 8.0).alias("pi"))
    dev = clean.developability("liab", "pi")
    return x.select("p_partkey", F.round(clean.quality_score("res", "rf", F.lit(1.0), dev, F.lit(0.5)), 8).alias("quality_score"))


@query("bucketed", """
SELECT CASE WHEN p_size BETWEEN 1 AND 10 THEN 'FR1' WHEN p_size BETWEEN 11 AND 20 THEN 'CDR1' WHEN p_size BETWEEN 21 AND 40 THEN 'FR2' ELSE 'OUTSIDE' END AS region,
  count(*) AS part_count FROM part GROUP BY 1""")
def bucketed(spark, t):
    region = clean.bucket("p_size", {"FR1": (1, 10), "CDR1": (11, 20), "FR2": (21, 40)}, "OUTSIDE")
    return t.part.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("part_count"))


@query("semantic_equal", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_tax AS a, round(l_quantity * l_tax, 4) + CASE WHEN l_linenumber = 3 THEN 0.00002 ELSE 0 END AS b, l_returnflag AS f, CASE WHEN l_returnflag = 'N' THEN 'NONE' ELSE l_returnflag END AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, abs(a - b) <= greatest(1e-7 * greatest(abs(a), abs(b)), 1e-5) AS numbers_equal,
  (g <> 'NONE') AS texts_equal FROM x""")
def semantic_equal(spark, t):
    a = F.col("l_quantity") * F.col("l_tax")
    b = F.round(a, 4) + F.when(F.col("l_linenumber") == 3, 0.00002).otherwise(0.0)
    other = F.when(F.col("l_returnflag") == "N", "NONE").otherwise(F.col("l_returnflag"))
    return t.lineitem.select(*LINE_ID, clean.semantic_equal(a, b).alias("numbers_equal"), clean.semantic_equal("l_returnflag", other).alias("texts_equal"))


@query("intake", """
WITH seen AS (SELECT p_name FROM part WHERE p_size > 48), ok AS (SELECT * FROM part WHERE p_size <= 48 AND NOT regexp_matches(p_name, '[x]') AND p_name NOT IN (SELECT p_name FROM seen))
SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) rn FROM ok) WHERE rn = 1""")
def intake(spark, t):
    parts = t.part.select("p_name", "p_partkey", "p_size", "p_retailprice")
    fresh = rules.intake_sequences(parts.filter("p_size <= 48"), parts.filter("p_size > 48"), "p_name", "p_retailprice", "x", ["p_partkey"])
    return fresh.select("p_name", "p_partkey", "p_retailprice")


@query("round_robin", """
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS item_no,
  ['alpha', 'beta', 'gamma'][1 + ((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) % 3)::INT] AS member FROM customer""")
def round_robin(spark, t):
    return rules.round_robin(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], ["alpha", "beta", "gamma"]).drop("c_acctbal")
