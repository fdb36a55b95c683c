"""Data-contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.clean import SHA256_HEX
from siftline.operators import checks
from siftline.plans.registry import query


@query("named_checks", """
WITH x AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) AS bad FROM orders)
SELECT 'key_unique' AS check_name, n = k AS passed FROM x UNION ALL SELECT 'price_positive', lo > 0 FROM x UNION ALL SELECT 'price_capped', hi <= 400000 FROM x UNION ALL SELECT 'status_known', bad = 0 FROM x""")
def named_checks(spark, t):
    return checks.run_checks(t.orders, {
        "key_unique": F.count(F.lit(1)) == F.count_distinct("o_orderkey"), "price_positive": F.min("o_totalprice") > 0,
        "price_capped": F.max("o_totalprice") <= 400000, "status_known": F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")) == 0})


@query("check_status", """
SELECT 3::BIGINT AS check_count, concat_ws(';', CASE WHEN max(l_quantity) > 45 THEN 'quantity_capped' END, CASE WHEN max(l_tax) > 1 THEN 'tax_fraction' END) AS failed_checks, CASE WHEN max(l_quantity) > 45 OR max(l_tax) > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM lineitem""")
def check_status(spark, t):
    return checks.overall_status(checks.run_checks(t.lineitem, {
        "quantity_capped": F.max("l_quantity") <= 45, "tax_fraction": F.max("l_tax") <= 1, "not_empty": F.count(F.lit(1)) > 0}))


@query("required_columns", """
SELECT column_name, state, filled FROM (SELECT count(c_custkey) a, count(c_name) b, count(c_nationkey) c, count(c_acctbal) d, count(c_mktsegment) e FROM customer),
LATERAL (VALUES ('c_custkey', 'ok', a), ('c_name', 'ok', b), ('c_phone', 'missing', 0), ('c_nationkey', 'unexpected', c), ('c_acctbal', 'unexpected', d), ('c_mktsegment', 'unexpected', e)) v(column_name, state, filled)""")
def required_columns(spark, t):
    return checks.column_report(t.customer, ["c_custkey", "c_name", "c_phone"])


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, t):
    return checks.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("count_gates", """
SELECT 'region' AS table_name, 5::BIGINT AS expected_count, count(*) AS actual_count, count(*) = 5 AS passed FROM region UNION ALL
SELECT 'nation', 25, count(*), count(*) = 25 FROM nation UNION ALL SELECT 'orders', 160, count(*), count(*) = 160 FROM orders""")
def count_gates(spark, t):
    return checks.count_gates({"region": t.region, "nation": t.nation, "orders": t.orders}, {"region": 5, "nation": 25, "orders": 160})


@query("cardinality", """
SELECT l_orderkey, count(*) AS row_count FROM lineitem GROUP BY 1 HAVING count(*) <> 3 OR list_sort(list(l_linenumber)) <> [1, 2, 3]""")
def cardinality(spark, t):
    return checks.cardinality(t.lineitem, ["l_orderkey"], 3, "l_linenumber", start=1)


@query("domain_violations", "SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') OR value > 300")
def domain_violations(spark, t):
    enum = checks.domain_violations(t.events, ["event_id", "value"], "event_type", ["view", "click", "purchase", "signup"])
    rng = checks.domain_violations(t.events, ["event_id", "event_type"], "value", hi=300)
    return enum.unionByName(rng).distinct()


@query("implication", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT (o_totalprice >= 20000)")
def implication(spark, t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return checks.implication(rows, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") >= 20000).drop("o_orderpriority")


# Event lines made from the events table; some break one rule each.
_EVENT_KEYS = ["event_id", "outcome", "failure_codes", "k"]


def event_lines(t):
    outcome = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "signup", "DONE").otherwise("SUCCESS")
    codes = F.when(F.col("event_type").isin("error", "click"), F.array(F.lit("E_LOAD"))).otherwise(F.array().cast("array<string>"))
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.struct(F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("event_id"), outcome.alias("outcome"), codes.alias("failure_codes"), k.alias("k"))
    extra = F.struct(F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("event_id"), outcome.alias("outcome"), codes.alias("failure_codes"), k.alias("k"), F.lit(1).alias("note"))
    return t.events.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 50 == 7, "not json").when(F.col("event_id") % 50 == 8, F.to_json(extra)).otherwise(F.to_json(ok)).alias("value"))


@query("event_validation", """
WITH x AS (SELECT event_id AS line_no, event_type, json_extract_string(props, '$.k')::INT AS k FROM events),
r AS (SELECT line_no, CASE WHEN line_no % 50 = 7 THEN 'not_an_object' ELSE concat_ws(';', CASE WHEN line_no % 50 = 8 THEN 'unknown_key' END, CASE WHEN event_type = 'signup' THEN 'outcome_enum' END,
  CASE WHEN event_type = 'click' THEN 'success_without_codes' END, CASE WHEN event_type = 'signup' THEN 'failure_needs_code' END, CASE WHEN k > 95 THEN 'k_range' END) END AS reasons FROM x)
SELECT line_no, reasons FROM r WHERE reasons <> ''""")
def event_validation(spark, t):
    rules = {
        "id_pattern": F.col("event_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{7,127}$"),
        "outcome_enum": F.col("outcome").isin("SUCCESS", "FAILURE", "BLOCKED"),
        "success_without_codes": (F.col("outcome") != "SUCCESS") | (F.size("failure_codes") == 0),
        "failure_needs_code": (F.col("outcome") == "SUCCESS") | (F.size("failure_codes") > 0),
        "unique_codes": F.size("failure_codes") == F.size(F.array_distinct("failure_codes")),
        "k_range": F.col("k") <= 95,
    }
    schema = "event_id string, outcome string, failure_codes array<string>, k int"
    _, rejects = checks.validate_events(event_lines(t), "value", schema, rules, _EVENT_KEYS)
    return rejects.select("line_no", "reasons")


@query("manifest_verify", """
WITH d AS (SELECT n_chars, lang, source, source || '/' || doc_id AS path, sha256(text) AS h FROM documents),
m AS (SELECT path, CASE WHEN source = 'src11' THEN sha256(h) ELSE h END AS h FROM d WHERE n_chars > 400 UNION ALL SELECT path, h FROM d WHERE n_chars > 400 AND lang = 'es'),
i AS (SELECT path, h FROM d WHERE source <> 'src2'), g AS (SELECT path, count(*) AS n, min(h) AS h FROM m GROUP BY 1)
SELECT coalesce(g.path, i.path) AS path, CASE WHEN n > 1 THEN 'duplicate_entry' WHEN i.path IS NULL THEN 'missing_file' WHEN g.path IS NULL THEN 'unlisted_file' WHEN g.h = i.h THEN 'ok' ELSE 'hash_mismatch' END AS status FROM g FULL JOIN i ON g.path = i.path""")
def manifest_verify(spark, t):
    d = t.documents.select("n_chars", "lang", "source", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    listed = d.filter("n_chars > 400").withColumn("sha256", F.when(F.col("source") == "src11", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    manifest = listed.unionAll(d.filter("n_chars > 400 AND lang = 'es'")).select("path", "sha256")
    return checks.manifest_verify(manifest, d.filter("source <> 'src2'").select("path", "sha256"))


@query("array_contracts", """
SELECT vec_id, len(embedding)::INT AS length, len(list_filter(embedding, lambda v: NOT isfinite(v)))::INT AS non_finite, len(list_filter(embedding, lambda v: v IS NULL))::INT AS null_members, len(embedding) = 64 AND len(list_filter(embedding, lambda v: NOT isfinite(v))) = 0 AS passed FROM embeddings""")
def array_contracts(spark, t):
    return checks.array_contracts(t.embeddings, ["vec_id"], "embedding", 64)


@query("one_hot_contracts", "SELECT user_id, event_type, count(*) AS mapped FROM events WHERE value > 200 GROUP BY 1, 2 HAVING count(*) > 1")
def one_hot_contracts(spark, t):
    return checks.one_hot_contracts(t.events.filter("value > 200"), ["user_id"], "event_type")


@query("unmapped_resolved", "SELECT doc_id FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unmapped_resolved(spark, t):
    docs = t.documents.select("doc_id", (F.col("n_chars") > 3000).alias("resolved"))
    return checks.unmapped_resolved(docs, t.labels, ["doc_id"], "resolved")


@query("axis_contracts", """
WITH s AS (SELECT doc_id, 'text' AS name, length(text)::INT AS size FROM documents UNION ALL SELECT doc_id, 'counted', n_chars::INT - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, 'chars' AS axis, min(size) AS least, max(size) AS most, count(*) AS arrays FROM s GROUP BY 1 HAVING min(size) <> max(size) OR count(*) <> 2""")
def axis_contracts(spark, t):
    text = t.documents.select("doc_id", F.lit("text").alias("name"), F.array(F.length("text")).alias("shape"))
    size = F.col("n_chars").cast("int") - F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    counted = t.documents.filter("doc_id % 11 <> 0").select("doc_id", F.lit("counted").alias("name"), F.array(F.lit(1), size).alias("shape"))
    return checks.axis_contracts(text.unionAll(counted), ["doc_id"], [("text", 0, "chars"), ("counted", 1, "chars")])


@query("token_contracts", """
WITH a AS (SELECT vec_id, unnest(range(0, 64)) AS atom, unnest(embedding) AS e FROM embeddings),
c AS (SELECT vec_id, atom, token, e, ((token = atom // 8 AND e > 0) OR (token = (atom + 1) // 8 AND e > 0.1)) AS hit FROM (SELECT *, unnest(range(0, 9)) AS token FROM a)),
n AS (SELECT vec_id, atom, any_value(e) AS e, count(*) FILTER (hit) AS k FROM c GROUP BY 1, 2)
SELECT vec_id, 'several_tokens' AS reason, atom AS item FROM n WHERE k > 1 UNION ALL SELECT vec_id, 'resolved_without_one_token', atom FROM n WHERE e > -0.05 AND k <> 1
UNION ALL SELECT vec_id, 'empty_token', token FROM c GROUP BY vec_id, token HAVING NOT bool_or(hit)""")
def token_contracts(spark, t):
    atoms = t.embeddings.select("vec_id", F.posexplode("embedding").alias("atom", "e"))
    own, following = F.floor(F.col("atom") / 8), F.floor((F.col("atom") + 1) / 8)
    hit = ((F.col("token") == own) & (F.col("e") > 0)) | ((F.col("token") == following) & (F.col("e") > 0.1))
    cells = atoms.select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("token")).select("vec_id", "atom", "token", hit.cast("int").alias("value"))
    return checks.token_contracts(cells, atoms.select("vec_id", "atom", (F.col("e") > -0.05).alias("resolved")), ["vec_id"])


@query("new_only", """
WITH b AS (SELECT l_orderkey AS id FROM lineitem WHERE l_quantity > 48), r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT id, count(*) AS n FROM b GROUP BY 1)
SELECT id, CASE WHEN id IN (SELECT id FROM r) THEN 'known' WHEN n > 1 THEN 'repeated' ELSE 'new' END AS verdict FROM c""")
def new_only(spark, t):
    batch = t.lineitem.filter("l_quantity > 48").select(F.col("l_orderkey").alias("id"))
    fresh, refused = checks.new_only(batch, t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), "id")
    return fresh.select("id", F.lit("new").alias("verdict")).unionAll(refused.select("id", F.col("reason").alias("verdict")))


@query("current_facts", """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' AND event_id > 3 THEN event_id - 3 END AS supersedes FROM events)
SELECT event_id, user_id FROM e WHERE event_id NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL)""")
def current_facts(spark, t):
    sup = F.when((F.col("event_type") == "error") & (F.col("event_id") > 3), F.col("event_id") - 3)
    ev = t.events.select("event_id", "user_id", sup.alias("supersedes"))
    return checks.current_facts(ev, "event_id", "supersedes").select("event_id", "user_id")


@query("complete_success", """
WITH x AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 9 <> 1 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 15 <> 4 THEN o_orderpriority END AS prio FROM orders)
SELECT o_orderkey, concat_ws(';', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN prio IS NULL THEN 'prio' END) AS missing_values FROM x WHERE o_orderstatus = 'F' AND (price IS NULL OR prio IS NULL)""")
def complete_success(spark, t):
    x = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 9 != 1, F.col("o_totalprice")).alias("price"),
                        F.when(F.col("o_orderkey") % 15 != 4, F.col("o_orderpriority")).alias("prio"))
    return checks.complete_success(x, ["o_orderkey"], F.col("o_orderstatus") == "F", ["price", "prio"])


@query("independent_domains", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM events WHERE value > 250)")
def independent_domains(spark, t):
    return checks.independent_domains(t.events.filter("event_type = 'signup'"), t.events.filter("value > 250"), "user_id")


@query("readiness", """
WITH e AS (SELECT c_custkey AS k FROM customer), a AS (SELECT o_custkey AS k, o_orderkey AS n, o_orderstatus AS s, o_totalprice AS p FROM orders), l AS (SELECT k, max(n) AS n, arg_max(s, n) AS s FROM a WHERE s <> 'P' OR p > 100000 GROUP BY 1)
SELECT e.k, l.n AS latest_attempt, CASE WHEN l.n IS NULL THEN 'MISSING' WHEN s = 'F' THEN 'READY' ELSE 'INCOMPLETE' END AS state FROM e LEFT JOIN l ON e.k = l.k""")
def readiness(spark, t):
    tries = t.orders.filter("o_orderstatus <> 'P' OR o_totalprice > 100000").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("s"))
    return checks.readiness(t.customer.select(F.col("c_custkey").alias("k")), tries, ["k"], "n", F.col("s") == "F")


@query("sources_agree", """
WITH v AS (SELECT doc_id, n_chars::DOUBLE AS v, length(text)::DOUBLE AS e FROM documents UNION ALL SELECT doc_id, length(text) + CASE WHEN doc_id % 20 = 0 THEN 1 ELSE 0 END, length(text) FROM documents)
SELECT doc_id, count(*) AS source_count, max(v) - min(v) AS spread, max(abs(v - e)) AS max_error, max(v) - min(v) <= 1e-9 AND max(abs(v - e)) <= 1e-9 AS agrees FROM v GROUP BY 1""")
def sources_agree(spark, t):
    n = F.length("text").cast("double")
    a = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("v"), n.alias("e"))
    b = t.documents.select("doc_id", (n + F.when(F.col("doc_id") % 20 == 0, 1).otherwise(0)).alias("v"), n.alias("e"))
    return checks.sources_agree(a.unionAll(b), ["doc_id"], "v", "e")


@query("map_contract", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'text' ELSE '' END AS missing_keys, CASE WHEN lang = 'de' THEN 'texte' ELSE '' END AS unknown_keys, CASE WHEN source = 'src3' THEN 'source' ELSE '' END AS bad_values FROM documents WHERE lang = 'de' OR source = 'src3'""")
def map_contract(spark, t):
    digest = F.when(F.col("source") == "src3", "no digest").otherwise(F.sha2("source", 256))
    key = F.when(F.col("lang") == "de", "texte").otherwise("text")
    docs = t.documents.select("doc_id", F.create_map(key, F.sha2("text", 256), F.lit("source"), digest).alias("hashes"))
    return checks.map_contract(docs, ["doc_id"], "hashes", ["source", "text"], SHA256_HEX)
