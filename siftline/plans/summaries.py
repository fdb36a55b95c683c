"""Group tables, series, histograms, digests and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import summary
from siftline.operators.ordered import running
from siftline.operators.rules import classify
from siftline.plans.registry import query
from siftline.session import literal_rows


@query("group_summary", """
SELECT l_suppkey, l_returnflag, count(*) AS line_count, count(*) FILTER (l_discount > 0.05) AS discounted, round(max(l_extendedprice), 2) AS max_price,
  round(median(l_quantity), 4) AS median_l_quantity, round(median(l_extendedprice), 4) AS median_l_extendedprice FROM lineitem GROUP BY 1, 2""")
def group_summary(spark, t):
    lines = t.lineitem.select("l_suppkey", "l_returnflag", "l_discount", "l_extendedprice", "l_quantity")
    out = summary.group_summary(lines, ["l_suppkey", "l_returnflag"], {
        "line_count": F.count(F.lit(1)), "discounted": F.count_if(F.col("l_discount") > 0.05), "max_price": F.round(F.max("l_extendedprice"), 2),
    }, ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: F.round(c, 4) for c in ("median_l_quantity", "median_l_extendedprice")})


@query("grain_rollup", """
SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus)::BIGINT AS grain_id, count(*) AS line_count, round(sum(l_quantity), 2) AS quantity, count(*) FILTER (l_tax > 0.04) AS taxed
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def grain_rollup(spark, t):
    lines = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    return summary.grain_rollup(lines, ["l_returnflag", "l_linestatus"], [["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"], []], {
        "line_count": F.count(F.lit(1)), "quantity": F.round(F.sum("l_quantity"), 2), "taxed": F.count_if(F.col("l_tax") > 0.04)})


@query("stage_summary", """
SELECT event_type, count(DISTINCT user_id) AS attempts, round(sum(value), 2) AS total_seconds, max(value) AS max_seconds, round(median(value), 4) AS median_seconds FROM events GROUP BY 1""")
def stage_summary(spark, t):
    out = summary.stage_summary(t.events.select("event_type", "user_id", "value"), ["event_type"], "user_id", "value")
    return out.withColumns({"total_seconds": F.round("total_seconds", 2), "median_seconds": F.round("median_seconds", 4)})


@query("envelope", "SELECT l_linestatus, max(l_quantity) AS max_l_quantity, max(l_extendedprice) AS max_l_extendedprice, min(l_discount) AS min_l_discount FROM lineitem GROUP BY 1")
def envelope(spark, t):
    return summary.envelope(t.lineitem, ["l_linestatus"], ["l_quantity", "l_extendedprice"], ["l_discount"])


@query("series_summary", """
SELECT user_id, event_type, count(*) AS samples, min(value) AS value_min, max(value) AS value_max, arg_min(value, (ts, event_id)) AS value_first, arg_max(value, (ts, event_id)) AS value_last,
  round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 4) AS value_delta, round(max(value) - min(value), 4) AS value_range FROM events GROUP BY 1, 2""")
def series_summary(spark, t):
    ev = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    out = summary.series_summary(ev, ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    return out.withColumns({c: F.round(c, 4) for c in ("value_delta", "value_range")})


@query("peak_gate", """
SELECT user_id, round(max(value) / min(total), 6) AS peak_fraction, count(*) FILTER (total <= 0) AS bad_totals, max(value) / min(total) > 0 AND max(value) / min(total) <= 0.9 AS within_gate
FROM (SELECT user_id, value, 250.0::DOUBLE + (event_id % 7) AS total FROM events) GROUP BY 1""")
def peak_gate(spark, t):
    ev = t.events.select("user_id", "value", (F.lit(250.0) + F.col("event_id") % 7).alias("total"))
    return summary.peak_gate(ev, ["user_id"], "value", "total").withColumn("peak_fraction", F.round("peak_fraction", 6))


@query("forged_peaks", """
WITH raw AS (SELECT user_id, max(value) / 500.0 AS raw_peak FROM events GROUP BY 1), rep AS (SELECT user_id, avg(value) / 100.0 AS reported FROM events GROUP BY 1)
SELECT user_id, round(reported, 6) AS reported, round(raw_peak, 6) AS raw_peak FROM rep JOIN raw USING (user_id) WHERE reported < raw_peak - 1e-9""")
def forged_peaks(spark, t):
    ev = t.events.select("user_id", "value", F.lit(500.0).alias("total"))
    raw = summary.peak_gate(ev, ["user_id"], "value", "total")
    rep = ev.groupBy("user_id").agg((F.avg("value") / 100.0).alias("reported"))
    return summary.forged_peaks(rep, raw, ["user_id"], "reported").withColumns({c: F.round(c, 6) for c in ("reported", "raw_peak")})


@query("table_funnel", """
SELECT 1 AS stage_order, 'customers' AS stage, count(*) AS remaining_count FROM customer UNION ALL
SELECT 2, 'customers with orders', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 3, 'customers with urgent orders', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def table_funnel(spark, t):
    cust = t.customer.select("c_custkey")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return summary.table_funnel([
        ("customers", cust), ("customers with orders", cust.join(orders, "c_custkey", "left_semi")),
        ("customers with urgent orders", cust.join(orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi")),
    ])


_FLAGS = """concat_ws(' | ', CASE WHEN l_quantity > 40 THEN 'quantity:' || l_linenumber END, CASE WHEN l_discount > 0.08 THEN 'discount:' || l_partkey END, CASE WHEN l_tax > 0.06 THEN 'tax' END)"""


@query("exploded_counts", f"""
SELECT item, count(*) AS row_count FROM (SELECT split_part(unnest(string_split({_FLAGS}, ' | ')), ':', 1) AS item FROM lineitem) WHERE item <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def exploded_counts(spark, t):
    flags = F.concat_ws(" | ", F.when(F.col("l_quantity") > 40, F.concat(F.lit("quantity:"), "l_linenumber")),
                        F.when(F.col("l_discount") > 0.08, F.concat(F.lit("discount:"), "l_partkey")), F.when(F.col("l_tax") > 0.06, "tax"))
    return summary.exploded_frequencies(t.lineitem.select(flags.alias("flags")), "flags")


@query("status_histogram", """
SELECT o_orderpriority, string_agg(o_orderstatus || ':' || n, ';' ORDER BY o_orderstatus) AS histogram FROM (SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def status_histogram(spark, t):
    return summary.histogram_text(t.orders, ["o_orderpriority"], "o_orderstatus")


@query("distinct_counts", "SELECT count(DISTINCT l_orderkey) AS distinct_l_orderkey, count(DISTINCT l_partkey) AS distinct_l_partkey, count(DISTINCT l_suppkey) AS distinct_l_suppkey, count(DISTINCT l_returnflag) AS distinct_l_returnflag FROM lineitem")
def distinct_counts(spark, t):
    return summary.distinct_counts(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"])


@query("dup_groups", """
WITH d AS (SELECT doc_id, n_chars, sha256(text) AS text_sha256 FROM documents), g AS (SELECT text_sha256, count(*) AS member_count FROM d GROUP BY 1 HAVING count(*) > 1),
n AS (SELECT *, row_number() OVER (ORDER BY text_sha256) AS gn FROM g)
SELECT doc_id, n_chars, text_sha256, member_count, 'DUP' || CASE WHEN length(gn::VARCHAR) < 4 THEN lpad(gn::VARCHAR, 4, '0') ELSE gn::VARCHAR END AS duplicate_group_id,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) AS member_index FROM d JOIN n USING (text_sha256)""")
def dup_groups(spark, t):
    docs = t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))
    return summary.duplicate_groups(docs, "text_sha256", "doc_id")


@query("dup_keys", "SELECT lower(p_name) AS p_name, lower(p_brand) AS p_brand, count(*) AS row_count FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, t):
    return summary.duplicate_keys(t.part, ["p_name", "p_brand"], casefold=True)


@query("set_digest", """
WITH x AS (SELECT o_orderstatus, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey::VARCHAR) AS rn FROM orders),
l1 AS (SELECT o_orderstatus, (rn - 1) // 4096 AS r1, sha256(string_agg(id, chr(10) ORDER BY rn) || chr(10)) AS d, count(*) AS n FROM x GROUP BY 1, 2)
SELECT o_orderstatus, sum(n)::BIGINT AS n_rows, sha256(string_agg(d, chr(10) ORDER BY r1) || chr(10)) AS digest FROM l1 GROUP BY 1""")
def set_digest(spark, t):
    return summary.set_digest(t.orders, "o_orderkey", ["o_orderstatus"], size=4096)


@query("ordered_fingerprint", """
SELECT conv_id, count(*) AS n_rows, sha256(sha256(string_agg(turn::VARCHAR || chr(9) || coalesce(role, '') || chr(9) || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10)) || chr(10)) AS digest FROM conversations GROUP BY 1""")
def ordered_fingerprint(spark, t):
    return summary.ordered_fingerprint(t.conversations, ["conv_id"], ["turn"], ["turn", "role", "text"])


@query("assemble", """
SELECT conv_id, string_agg(turn::VARCHAR || ':' || role[1], '|' ORDER BY turn) AS numbered, sha256(string_agg(turn::VARCHAR || ':' || role[1], '|' ORDER BY turn)) AS numbered_sha256 FROM conversations GROUP BY 1""")
def assemble(spark, t):
    piece = F.concat(F.col("turn").cast("string"), F.lit(":"), F.substring("role", 1, 1))
    return summary.assemble(t.conversations, ["conv_id"], "turn", piece, "|", "numbered")


@query("crosstab_fixed", """
WITH d AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'ABSENT']) AS c_mktsegment)
SELECT d.c_mktsegment, count(*) FILTER (c_nationkey = 0) AS "0", count(*) FILTER (c_nationkey = 7) AS "7", count(*) FILTER (c_nationkey = 99) AS "99" FROM d LEFT JOIN customer USING (c_mktsegment) GROUP BY 1""")
def crosstab_fixed(spark, t):
    return summary.crosstab_fixed(t.customer, "c_mktsegment", "c_nationkey", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "ABSENT"], [0, 7, 99])


@query("pivot_matrix", """
SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1""")
def pivot_matrix(spark, t):
    return summary.pivot_matrix(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.round(F.sum("o_totalprice"), 2), fill=0.0)


@query("missing_cells", """
WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o, count(*) FILTER (o_orderstatus = 'P') p FROM orders GROUP BY 1)
SELECT o_custkey, 'F' AS missing_column FROM g WHERE f = 0 UNION ALL SELECT o_custkey, 'O' FROM g WHERE o = 0 UNION ALL SELECT o_custkey, 'P' FROM g WHERE p = 0""")
def missing_cells(spark, t):
    m = summary.pivot_matrix(t.orders.select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return summary.missing_cells(m, "o_custkey", ["F", "O", "P"])


@query("panel_margin", """
WITH x AS (SELECT o_custkey, o_orderpriority AS target, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'positive' ELSE 'negative' END AS role, o_totalprice / 500000.0 AS score, o_orderkey % 3 AS contacts FROM orders),
m AS (SELECT o_custkey, target, role, round(avg(score), 4) AS m, max(contacts) AS c FROM x GROUP BY 1, 2, 3),
p AS (SELECT o_custkey, min(m) FILTER (role = 'positive') AS positive_min, max(m) FILTER (role = 'negative') AS negative_max, max(m) FILTER (role = 'negative' AND target LIKE '5%') AS subset_max, max(c) AS contacts FROM m GROUP BY 1)
SELECT o_custkey, positive_min, negative_max, subset_max, round(positive_min - negative_max, 4) AS margin, contacts, round(positive_min - negative_max + 0.025 * contacts, 4) AS selection_score,
  coalesce(positive_min >= 0.5 AND negative_max <= 0.6 AND positive_min - negative_max >= 0.05 AND contacts >= 1, false) AS passed FROM p""")
def panel_margin(spark, t):
    role = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "positive").otherwise("negative")
    x = t.orders.select("o_custkey", F.col("o_orderpriority").alias("target"), role.alias("role"),
                        (F.col("o_totalprice") / 500000.0).alias("score"), (F.col("o_orderkey") % 3).alias("contacts"))
    return summary.panel_margin(x, "o_custkey", "target", "role", "score", "contacts", 0.5, 0.6, 0.05, 1, subset_prefix="5")


@query("weighted_macro", """
WITH x AS (SELECT event_type, user_id % 10 AS source_group, value, [6, 10, 4][1 + event_id % 3] AS w FROM events),
g AS (SELECT event_type, source_group, sum(w * value) / sum(w) AS m FROM x GROUP BY 1, 2)
SELECT event_type, count(*) AS group_count, round(avg(m), 6) AS macro_mean FROM g GROUP BY 1""")
def weighted_macro(spark, t):
    weight = F.element_at(F.array(F.lit(6), F.lit(10), F.lit(4)), (F.col("event_id") % 3 + 1).cast("int"))
    x = t.events.select("event_type", (F.col("user_id") % 10).alias("source_group"), "value", weight.alias("w"))
    return summary.weighted_macro(x, ["event_type"], "source_group", "value", "w").withColumn("macro_mean", F.round("macro_mean", 6))


@query("schema_census", """
WITH r AS (SELECT label::VARCHAR AS role, vec_id::VARCHAR AS file, 'embedding' AS name, len(embedding)::VARCHAR AS shape, 'float32' AS dtype FROM embeddings
  UNION ALL SELECT label::VARCHAR, vec_id::VARCHAR, 'extra', '1x2', 'int64' FROM embeddings WHERE embedding[1] > 0),
f AS (SELECT role, file, string_agg(name || ':' || shape || ':' || dtype, ';' ORDER BY name || ':' || shape || ':' || dtype) AS signature FROM r GROUP BY 1, 2)
SELECT role, signature, count(*) AS file_count, min(file) AS example FROM f GROUP BY 1, 2""")
def schema_census(spark, t):
    base = t.embeddings.select(F.col("label").cast("string").alias("role"), F.col("vec_id").cast("string").alias("file"), F.element_at("embedding", 1).alias("lead"), F.size("embedding").alias("n"))
    main = base.select("role", "file", F.lit("embedding").alias("name"), F.array("n").alias("shape"), F.lit("float32").alias("dtype"))
    extra = base.filter("lead > 0").select("role", "file", F.lit("extra").alias("name"), F.array(F.lit(1), F.lit(2)).alias("shape"), F.lit("int64").alias("dtype"))
    return summary.schema_census(main.unionAll(extra))


@query("fail_counters", """
WITH x AS (SELECT DISTINCT l_orderkey, regexp_replace(f, '^(Average_|1_|2_|3_|4_|5_)', '') AS base_rule FROM (
  SELECT l_orderkey, unnest([CASE WHEN l_quantity > 45 THEN l_linenumber || '_quantity' END, CASE WHEN l_tax > 0.07 THEN 'Average_tax' END, CASE WHEN l_discount > 0.09 THEN 'discount' END]) AS f FROM lineitem) WHERE f IS NOT NULL)
SELECT base_rule, count(*) AS failed_designs FROM x GROUP BY 1""")
def fail_counters(spark, t):
    failed = F.array_compact(F.array(
        F.when(F.col("l_quantity") > 45, F.concat(F.col("l_linenumber").cast("string"), F.lit("_quantity"))),
        F.when(F.col("l_tax") > 0.07, "Average_tax"), F.when(F.col("l_discount") > 0.09, "discount")))
    return summary.failure_counters(t.lineitem.select("l_orderkey", failed.alias("failed")), "l_orderkey", "failed")


@query("target_summary", """
SELECT l_returnflag, l_linenumber, count(*) AS candidate_count, count(*) FILTER (l_quantity < 8) AS covered_count, round(median(l_quantity), 4) AS median_l_quantity FROM lineitem GROUP BY 1, 2""")
def target_summary(spark, t):
    x = t.lineitem.select("l_returnflag", "l_linenumber", "l_quantity", (F.col("l_quantity") < 8).alias("covered"))
    out = summary.hotspot_summary(x, ["l_returnflag", "l_linenumber"], "covered", "l_quantity")
    return out.withColumn("median_l_quantity", F.round("median_l_quantity", 4))


@query("cohort_summary", """
WITH f AS (SELECT source AS cohort, lang AS status, n_chars > 100 AS parse_ok, n_chars BETWEEN 500 AND 5000 AS complete FROM documents),
c AS (SELECT DISTINCT source AS cohort, 50 AS expected_count FROM documents UNION ALL SELECT 'src_absent', 50),
n AS (SELECT cohort, count(*) fc, count(*) FILTER (parse_ok) pc, count(*) FILTER (complete) cc, count(*) FILTER (status IN ('en', 'de')) ac FROM f GROUP BY 1),
h AS (SELECT cohort, string_agg(status || ':' || k, ';' ORDER BY status) AS statuses FROM (SELECT cohort, status, count(*) k FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT cohort, expected_count, coalesce(fc, 0) AS file_count, coalesce(pc, 0) AS parse_pass_count, coalesce(cc, 0) AS complete_count, coalesce(ac, 0) AS active_count, statuses, coalesce(fc, 0) = expected_count AS count_matches
FROM c LEFT JOIN n USING (cohort) LEFT JOIN h USING (cohort)""")
def cohort_summary(spark, t):
    files = t.documents.select(F.col("source").alias("cohort"), F.col("lang").alias("status"), (F.col("n_chars") > 100).alias("parse_ok"),
                               F.col("n_chars").between(500, 5000).alias("complete"))
    cohorts = files.select("cohort").distinct().unionAll(spark.range(1).select(F.lit("src_absent"))).withColumn("expected_count", F.lit(50))
    return summary.cohort_summary(files, cohorts, "cohort", "status", ["en", "de"])


@query("lineage_complete", """
WITH r AS (SELECT conv_id, role, count(*) n, sum(length(text))::BIGINT b FROM conversations GROUP BY 1, 2)
SELECT conv_id, sum(n)::BIGINT AS artefact_count, sum(b)::BIGINT AS total_bytes, count(role) AS role_count, count(role) = 2 AND sum(n) = 2 AS complete FROM r GROUP BY 1""")
def lineage_complete(spark, t):
    x = t.conversations.select("conv_id", "role", F.length("text").alias("size"))
    return summary.lineage_completeness(x, "conv_id", "role", "size", 2)


@query("cohort_compare", """
SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS survivors, round(median(n_chars), 4) AS median_n_chars, CASE lang WHEN 'en' THEN 'main' WHEN 'de' THEN 'probe' END AS profile FROM documents GROUP BY 1""")
def cohort_compare(spark, t):
    config = literal_rows(spark, [("en", "main"), ("de", "probe")], ["lang", "profile"])
    out = summary.compare_cohorts(t.documents.select("lang", "n_chars"), "lang", {"n": F.count(F.lit(1)), "survivors": F.count_if(F.col("n_chars") > 2000)}, ["n_chars"], config)
    return out.withColumn("median_n_chars", F.round("median_n_chars", 4))


@query("symbol_inventory", """
SELECT symbol, sum(n)::BIGINT AS occurrences, count(*) AS source_count, string_agg(source, ';' ORDER BY source) AS sources FROM (
  SELECT source, symbol, count(*) n FROM (SELECT source, unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents) GROUP BY 1, 2) GROUP BY 1""")
def symbol_inventory(spark, t):
    return summary.symbol_inventory(t.documents.select("source", "text"), "source", "text")


@query("symbol_sources", """
SELECT symbol, source, count(*) AS occurrences FROM (SELECT source, unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents) GROUP BY 1, 2""")
def symbol_sources(spark, t):
    return summary.symbol_sources(t.documents.select("source", "text"), "source", "text")


@query("acceptance_rate", """
WITH x AS (SELECT user_id, event_id, ts, sum((event_type = 'purchase')::INT) OVER w AS acc, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, min(n) AS stopped_at FROM x WHERE n >= 20 AND acc / n < 0.2 GROUP BY 1""")
def acceptance_rate(spark, t):
    ev = t.events.select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("accepted"))
    return summary.first_stop(summary.acceptance_rate(ev, ["user_id"], ["ts", "event_id"], "accepted", 20, 0.2), ["user_id"])


@query("running_totals", """
SELECT user_id, event_id, row_number() OVER w AS row_no, round(sum(value) OVER w, 2) AS running_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(spark, t):
    ev = t.events.select("user_id", "event_id", "ts", "value")
    return running(ev, ["user_id"], ["ts", "event_id"], {"running_value": F.col("value")}).select(
        "user_id", "event_id", "row_no", F.round("running_value", 2).alias("running_value"))


@query("summary_json", """
SELECT '{"customers":{"n":' || (SELECT count(*) FROM customer) || ',"segments":' || (SELECT count(DISTINCT c_mktsegment) FROM customer) || '},"orders":{"n":' || (SELECT count(*) FROM orders) || '}}' AS summary""")
def summary_json(spark, t):
    return summary.summary_json({
        "customers": t.customer.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments")),
        "orders": t.orders.agg(F.count(F.lit(1)).alias("n")),
    })


# Role of a page by its address: the first matching pattern names it.
PATH_ROLES = ((r"^https?://m\.", "mobile"), (r"/(en|de|fr|es)/", "language page"), (r"[?]", "query"), (r"#", "anchor"))


@query("path_roles", """
SELECT CASE WHEN regexp_matches(url, '^https?://m[.]') THEN 'mobile' WHEN regexp_matches(url, '/(en|de|fr|es)/') THEN 'language page' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'anchor' ELSE 'other' END AS role, count(*) AS page_count FROM pages GROUP BY 1""")
def path_roles(spark, t):
    return t.pages.groupBy(classify("url", PATH_ROLES, "other").alias("role")).agg(F.count(F.lit(1)).alias("page_count"))
