"""Latest, numbering, neighbours, runs, ties and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import ranking
from siftline.plans.registry import query


@query("keep_last", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn = 1""")
def keep_last(spark, t):
    return ranking.keep_last(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("latest_complete", """
WITH a AS (SELECT conv_id, max(turn) AS latest FROM conversations GROUP BY 1), c AS (SELECT conv_id, max(turn) AS latest_complete FROM conversations WHERE role = 'assistant' AND length(text) > 50 GROUP BY 1)
SELECT conv_id, latest, latest_complete FROM a LEFT JOIN c USING (conv_id)""")
def latest_complete(spark, t):
    conv = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("size"))
    complete = (F.col("role") == "assistant") & (F.col("size") > 50)
    last = ranking.latest_attempt(conv, ["conv_id"], "turn").select("conv_id", F.col("turn").alias("latest"))
    good = ranking.latest_complete(conv, ["conv_id"], "turn", complete).select("conv_id", F.col("turn").alias("latest_complete"))
    return last.join(good, "conv_id", "left")


@query("renumber", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents")
def renumber(spark, t):
    return ranking.renumber(t.documents.select("doc_id", "source"), ["source"], ["doc_id"])


@query("adjacent_gaps", """
SELECT l_partkey, from_seq, to_seq, kind, distance FROM (
  SELECT l_partkey, lag(k) OVER w AS from_seq, k AS to_seq, CASE WHEN k <> lag(k) OVER w + 1 THEN 'gap' WHEN abs(q - lag(q) OVER w) NOT BETWEEN 1 AND 40 THEN 'distance' END AS kind,
    CASE WHEN k <> lag(k) OVER w + 1 THEN NULL ELSE abs(q - lag(q) OVER w) END AS distance
  FROM (SELECT l_partkey, l_orderkey // 500 AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_partkey ORDER BY k)) WHERE kind IS NOT NULL AND from_seq IS NOT NULL""")
def adjacent_gaps(spark, t):
    x = t.lineitem.groupBy("l_partkey", F.floor(F.col("l_orderkey") / 500).cast("long").alias("k")).agg(F.max("l_quantity").alias("q"))
    return ranking.adjacent_checks(x, ["l_partkey"], "k", 1.0, 40.0, lambda: F.abs(F.col("q") - F.col("prev_q")), ["q"])


@query("range_compress", """
WITH d AS (SELECT DISTINCT o_custkey, o_orderkey // 100 AS k FROM orders), g AS (SELECT o_custkey, k, k - row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS island FROM d),
r AS (SELECT o_custkey, min(k) AS s, max(k) AS e FROM g GROUP BY o_custkey, island)
SELECT o_custkey, string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE s || '..' || e END, ',' ORDER BY s) AS ranges FROM r GROUP BY 1""")
def range_compress(spark, t):
    x = t.orders.select("o_custkey", F.floor(F.col("o_orderkey") / 100).cast("long").alias("k"))
    return ranking.compress_ranges(x, ["o_custkey"], "k")


@query("contiguity", """
SELECT l_orderkey, count(*) AS row_count, count(DISTINCT l_linenumber) AS distinct_ranks, min(l_linenumber) AS min_rank, max(l_linenumber) AS max_rank,
  min(l_linenumber) = 1 AND count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1""")
def contiguity(spark, t):
    return ranking.contiguity(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("monotonic", """
WITH f AS (SELECT o_orderpriority, o_orderkey // 1000 AS k, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT *, n > lag(n) OVER (PARTITION BY o_orderpriority ORDER BY k) AS up FROM f)
SELECT o_orderpriority, count(*) AS row_count, count(*) FILTER (up) AS rises, count(*) FILTER (up) = 0 AS monotonic FROM x GROUP BY 1""")
def monotonic(spark, t):
    f = t.orders.groupBy("o_orderpriority", F.floor(F.col("o_orderkey") / 1000).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.monotonic(f, ["o_orderpriority"], ["k"], "n")


@query("argmax_agreement", """
WITH x AS (SELECT user_id, event_id, round(0.8 * value + 0.2 * (event_id % 100), 6) AS a, round(0.2 * value + 0.8 * (event_id % 100), 6) AS b FROM events),
p AS (SELECT user_id, arg_max(event_id, (a, -event_id)) AS best_a, arg_max(event_id, (b, -event_id)) AS best_b, max(a) AS score_a, max(b) AS score_b FROM x GROUP BY 1)
SELECT *, best_a = best_b AS same_best FROM p""")
def argmax_agreement(spark, t):
    other = F.col("event_id") % 100
    return ranking.argmax_agreement(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id",
                                    F.round(0.8 * F.col("value") + 0.2 * other, 6), F.round(0.2 * F.col("value") + 0.8 * other, 6))


@query("tie_reject", """
WITH r AS (SELECT l_orderkey, l_suppkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_linestatus DESC) AS rk FROM lineitem), x AS (SELECT l_orderkey, count(*) AS tied, min(l_suppkey) AS m FROM r WHERE rk = 1 GROUP BY 1)
SELECT l_orderkey, tied, CASE WHEN tied = 1 THEN m END AS l_suppkey, CASE WHEN tied = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status FROM x""")
def tie_reject(spark, t):
    x = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return ranking.best_or_ambiguous(x, ["l_orderkey"], [F.col("l_returnflag").desc(), F.col("l_linestatus").desc()], "l_suppkey")


@query("rank_rows", "SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS final_rank FROM part")
def rank_rows(spark, t):
    return ranking.rank_rows(t.part.select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), "p_partkey"])


@query("share_total", "SELECT l_suppkey, n, round(n / sum(n) OVER (), 8) AS share FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def share_total(spark, t):
    n = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return ranking.share(n, "n").withColumn("share", F.round("share", 8))


_FIRST = """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first_at FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at, event_type) AS rn FROM f)
SELECT e.user_id, e.event_type, count(*) AS n FROM events e JOIN r ON e.user_id = r.user_id AND e.event_type = r.event_type WHERE rn {} 2 GROUP BY 1, 2"""


@query("first_n_distinct", _FIRST.format("<="))
def first_n_distinct(spark, t):
    ev = t.events.select("user_id", "event_type", "ts", "event_id")
    return ranking.first_n_distinct(ev, ["user_id"], ["event_type"], ["ts", "event_id"], 2).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("drop_first_n", _FIRST.format(">"))
def drop_first_n(spark, t):
    ev = t.events.select("user_id", "event_type", "ts", "event_id")
    return ranking.first_n_distinct(ev, ["user_id"], ["event_type"], ["ts", "event_id"], 2, drop=True).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("group_ids", """
WITH g AS (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY 1), n AS (SELECT p_brand, 'FWC' || lpad((row_number() OVER (ORDER BY m))::VARCHAR, 4, '0') AS group_id FROM g)
SELECT p_partkey, p_brand, group_id FROM part JOIN n USING (p_brand)""")
def group_ids(spark, t):
    return ranking.number_groups(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", "FWC")


@query("next_number", "SELECT conv_id, max(turn) + 1 AS next_number FROM conversations GROUP BY 1")
def next_number(spark, t):
    return ranking.next_number(t.conversations, ["conv_id"], "turn")


@query("review_top", "SELECT * FROM (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 20)")
def review_top(spark, t):
    return ranking.top_k(t.part.select("p_partkey", "p_size", "p_retailprice"), [F.col("p_size").desc(), "p_retailprice", "p_partkey"], 20)


@query("row_at_max", """
SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) rn FROM events) WHERE rn = 1""")
def row_at_max(spark, t):
    return ranking.row_at_max(t.events.select("event_type", "event_id", "user_id", "value"), ["event_type"], "value", "event_id")


@query("evidence", """
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) rn FROM d)
SELECT l_suppkey, count(*) AS member_count, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 12) AS evidence FROM r GROUP BY 1""")
def evidence(spark, t):
    return ranking.evidence(t.lineitem, ["l_suppkey"], "l_partkey", 12)
