"""Curation: flags, reasons, best per key, two-level removal of copies, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.clean import any_literal, is_member
from siftline.operators.joins import enrich, missing_keys, only_needed
from siftline.operators.ranking import best_per_key, order_total
from siftline.operators.rules import first_reason, flag_all
from siftline.operators.summary import frequencies, funnel
from siftline.plans.registry import query

STATUS_SCOPE = ("O", "F")
NAME_WORDS = ("widget", "ring")


def _instances(t) -> DataFrame:
    """Line items with their part and supplier attributes: the library under curation."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", "p_retailprice")
    sups = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return enrich(enrich(lines, parts, "l_partkey"), sups, "l_suppkey")


def _conditions() -> dict:
    return {
        "is_named": any_literal("p_name", NAME_WORDS),
        "is_status": is_member("l_linestatus", STATUS_SCOPE),
        "is_small": F.col("p_size") <= 30,
        "is_solvent": F.col("s_acctbal").isNull() | (F.col("s_acctbal") >= 0),
        "is_discounted": F.col("l_discount") >= 0.02,
    }


_INSTANCES_SQL = """
SELECT l.*, p_name, p_size, s_acctbal,
  coalesce(regexp_matches(lower(p_name), 'widget|ring'), false) AS is_named,
  coalesce(l_linestatus IN ('O','F'), false) AS is_status,
  coalesce(p_size <= 30, false) AS is_small,
  (s_acctbal IS NULL OR s_acctbal >= 0) AS is_solvent,
  coalesce(l_discount >= 0.02, false) AS is_discounted
FROM lineitem l LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
"""


@query("curation_funnel", f"""
WITH x AS ({_INSTANCES_SQL}), s AS (SELECT
  count(*) c1, count(*) FILTER (is_named) c2, count(*) FILTER (is_named AND is_status) c3,
  count(*) FILTER (is_named AND is_status AND is_small) c4,
  count(*) FILTER (is_named AND is_status AND is_small AND is_solvent) c5,
  count(*) FILTER (is_named AND is_status AND is_small AND is_solvent AND is_discounted) c6 FROM x)
SELECT 1 AS stage_order, 'all' AS stage, c1 AS remaining_count FROM s UNION ALL
SELECT 2, 'is_named', c2 FROM s UNION ALL SELECT 3, 'is_status', c3 FROM s UNION ALL
SELECT 4, 'is_small', c4 FROM s UNION ALL SELECT 5, 'is_solvent', c5 FROM s UNION ALL
SELECT 6, 'is_discounted', c6 FROM s""")
def curation_funnel(spark, t):
    flagged = flag_all(_instances(t), _conditions())
    return funnel(flagged, [("all", F.lit(True)), *[(k, F.col(k)) for k in _conditions()]])


@query("first_reason", f"""
WITH x AS ({_INSTANCES_SQL}), r AS (SELECT CASE WHEN NOT is_named THEN 'name_out_of_scope'
  WHEN NOT is_status THEN 'status_out_of_scope' WHEN NOT is_small THEN 'part_too_large'
  WHEN NOT is_solvent THEN 'supplier_in_debt' WHEN NOT is_discounted THEN 'no_discount' ELSE 'SELECTED' END AS first_exclusion_reason FROM x),
c AS (SELECT first_exclusion_reason, count(*) AS row_count FROM r GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY row_count DESC, first_exclusion_reason) AS ordinal FROM c""")
def first_reason_counts(spark, t):
    flagged = flag_all(_instances(t), _conditions())
    labels = dict(is_named="name_out_of_scope", is_status="status_out_of_scope", is_small="part_too_large",
                  is_solvent="supplier_in_debt", is_discounted="no_discount")
    reasoned = first_reason(flagged, [(~F.col(k), v) for k, v in labels.items()])
    return frequencies(reasoned, "first_exclusion_reason")


@query("flagged_selection", f"""
SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM ({_INSTANCES_SQL})
WHERE is_named AND is_status AND is_small AND is_solvent AND is_discounted""")
def flagged_selection(spark, t):
    return flag_all(_instances(t), _conditions()).filter("pass_all").select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("best_per_key", """
SELECT l_partkey, l_orderkey, l_linenumber, l_discount, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_extendedprice DESC, coalesce(l_discount, 999), l_orderkey, l_linenumber) rn
  FROM lineitem) WHERE rn = 1""")
def best_line_per_part(spark, t):
    lines = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_returnflag")
    order = ["l_returnflag", F.col("l_extendedprice").desc(), F.coalesce("l_discount", F.lit(999.0)).asc(), "l_orderkey", "l_linenumber"]
    return best_per_key(lines, ["l_partkey"], order).drop("l_returnflag")


@query("two_level_dedup", """
WITH d AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS text_sha256 FROM documents),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, text_sha256 ORDER BY doc_id) rn FROM d) WHERE rn = 1)
SELECT doc_id, source, lang, n_chars, text_sha256 FROM (
  SELECT doc_id, source, lang, n_chars, text_sha256, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, source, lang, doc_id) rn FROM a) WHERE rn = 1""")
def two_level_dedup(spark, t):
    docs = t.documents.select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"))
    first = best_per_key(docs, ["source", "lang", "text_sha256"], ["doc_id"])
    return best_per_key(first, ["text_sha256"], [F.col("n_chars").desc(), "source", "lang", "doc_id"])


@query("enriched", """
SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def enriched(spark, t):
    orders = t.orders.select("o_orderkey", "o_custkey")
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return enrich(enrich(orders, cust, "o_custkey"), nation, "c_nationkey").select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")


@query("missing_keys", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def customers_without_orders(spark, t):
    pending = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return missing_keys(t.customer.select("c_custkey", "c_name"), pending, "c_custkey")


@query("only_needed", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def parts_in_large_lines(spark, t):
    needed = t.lineitem.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return only_needed(t.part.select("p_partkey", "p_name"), needed, "p_partkey")


@query("ordered_total", """
SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey)""")
def ordered_total(spark, t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return order_total(rows, ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"])
