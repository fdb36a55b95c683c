"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import joins, rules, sets
from siftline.plans.registry import query
from siftline.sources.files import content_store


@query("ranked_merge", """
WITH a AS (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) SELECT c_custkey, best, row_number() OVER (ORDER BY best DESC, c_custkey) AS final_rank FROM customer JOIN a ON c_custkey = o_custkey""")
def ranked_merge(spark, t):
    from siftline.operators.ranking import rank_rows

    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    merged = joins.enrich(t.customer.select("c_custkey"), best, "c_custkey", "inner")
    return rank_rows(merged, [F.col("best").desc(), "c_custkey"])


@query("reconcile_full_outer", """
WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id, CASE WHEN source = 'src7' THEN 'xx' ELSE lang END AS language, length(text) + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS size FROM documents WHERE n_chars > 300),
j AS (SELECT a.doc_id AS ka, b.doc_id AS kb, * FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT coalesce(ka, kb) AS doc_id, '*' AS field, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value, 'missing_right' AS kind FROM j WHERE kb IS NULL UNION ALL
SELECT coalesce(ka, kb), '*', NULL, NULL, 'missing_left' FROM j WHERE ka IS NULL UNION ALL
SELECT ka, 'lang', lang, language, 'different' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND lang <> language UNION ALL
SELECT ka, 'n_chars', n_chars::VARCHAR, size::VARCHAR, 'different' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND n_chars <> size AND abs(n_chars - size) > greatest(1e-7 * greatest(n_chars, size), 1e-5)""")
def reconcile_full_outer(spark, t):
    docs = t.documents
    a = docs.filter("lang <> 'es'").select("doc_id", "lang", "n_chars")
    b = docs.filter("n_chars > 300").select(
        "doc_id", F.when(F.col("source") == "src7", "xx").otherwise(F.col("lang")).alias("language"),
        (F.length("text") + F.when(F.col("source") == "src5", 1).otherwise(0)).alias("size"))
    return joins.reconcile(a, b, ["doc_id"], {"lang": "language", "n_chars": "size"})


@query("cross_matrix", """
SELECT c.c_custkey, r.n_nationkey, r.panel_no, 'T' || lpad(c.c_custkey::VARCHAR, 6, '0') || '_' || r.n_name AS task_id, CASE WHEN c.c_nationkey = r.n_nationkey THEN 'home' ELSE 'abroad' END AS partition_name
FROM customer c, (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS panel_no FROM nation WHERE n_regionkey = 1) r""")
def cross_matrix(spark, t):
    panel = t.nation.filter("n_regionkey = 1").select("n_nationkey", "n_name")
    task = F.concat(F.lit("T"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("_"), F.col("n_name"))
    m = joins.cross_matrix(t.customer.select("c_custkey", "c_nationkey"), panel, ["n_nationkey"], task)
    part = F.when(F.col("c_nationkey") == F.col("n_nationkey"), "home").otherwise("abroad")
    return m.select("c_custkey", "n_nationkey", "panel_no", "task_id", part.alias("partition_name"))


@query("triangular_pairs", """
SELECT a.c_mktsegment, a.c_custkey AS c_custkey_a, b.c_custkey AS c_custkey_b, round(abs(a.c_acctbal - b.c_acctbal), 4) AS difference
FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 2.5""")
def triangular_pairs(spark, t):
    pairs = joins.near_pairs(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", "c_acctbal", 2.5, ["c_mktsegment"])
    return pairs.select("c_mktsegment", "c_custkey_a", "c_custkey_b", F.round("difference", 4).alias("difference"))


_POINTS = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


def points(t):
    e = lambda i: F.element_at("embedding", i).cast("double")
    return t.embeddings.select("vec_id", "label", e(1).alias("x"), e(2).alias("y"), e(3).alias("z"))


@query("range_pairs", f"""
WITH p AS ({_POINTS}) SELECT a.label, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance
FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.06 ** 2""")
def range_pairs(spark, t):
    p = points(t)
    pairs = joins.range_pairs(p, p, ["label"], ["x", "y", "z"], 0.06, ["vec_id"], ["vec_id"])
    return pairs.filter("vec_id_a < vec_id_b").select("label", "vec_id_a", "vec_id_b", F.round("distance", 6).alias("distance"))


@query("longest_prefix", """
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), m AS (
  SELECT DISTINCT string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS prefix, 'host' AS mount FROM pages UNION ALL
  SELECT DISTINCT string_split(regexp_replace(url, '^https?://', ''), '/')[1] || '/' || string_split(regexp_replace(url, '^https?://', ''), '/')[2], 'section' FROM pages WHERE url LIKE 'https:%' AND len(string_split(regexp_replace(url, '^https?://', ''), '/')) > 1)
SELECT page_id, path, arg_max(prefix, length(prefix)) AS prefix, arg_max(mount, length(prefix)) AS mount FROM u LEFT JOIN m ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1, 2""")
def longest_prefix(spark, t):
    u = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    parts = F.split("path", "/")
    hosts = u.select(F.element_at(parts, 1).alias("prefix"), F.lit("host").alias("mount")).distinct()
    deep = t.pages.filter(F.col("url").startswith("https:")).select(F.regexp_replace("url", "^https?://", "").alias("path")).filter(F.size(parts) > 1).select(
        F.concat_ws("/", F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))).alias("prefix"), F.lit("section").alias("mount")).distinct()
    return joins.longest_prefix(u, "page_id", "path", hosts.unionAll(deep), "prefix", ["mount"])


_GLOBS = {"mobile": "m.*/**/*", "english": "*/en/*", "two_levels": "*/*/*"}


@query("pattern_join", """
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), p(pattern_id, re) AS (VALUES ('mobile', '^m\\.[^/]*/([^/]+/)*[^/]*$'), ('english', '^[^/]*/en/[^/]*$'), ('two_levels', '^[^/]*/[^/]*/[^/]*$'))
SELECT page_id, pattern_id FROM u JOIN p ON regexp_matches(path, re)""")
def pattern_join(spark, t):
    u = t.pages.select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return joins.match_patterns(u, "path", _GLOBS).select("page_id", "pattern_id")


@query("pattern_counts", """
WITH u AS (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages), p(pattern_id, re, expected_count) AS (VALUES ('english', '^[^/]*/en/[^/]*$', 10::BIGINT), ('nothing', '^zzz$', 0))
SELECT pattern_id, expected_count, count(path) AS match_count, count(path) = expected_count AS matches FROM p LEFT JOIN u ON regexp_matches(path, re) GROUP BY 1, 2""")
def pattern_counts(spark, t):
    u = t.pages.select(F.regexp_replace("url", "^https?://", "").alias("path"))
    found = joins.match_patterns(u, "path", {"english": "*/en/*", "nothing": "zzz"})
    return joins.match_counts(found, {"english": 10, "nothing": 0}).withColumn("expected_count", F.col("expected_count").cast("long"))


@query("match_endpoints", f"""
WITH p AS ({_POINTS}), e AS (SELECT a.vec_id, CASE WHEN a.vec_id % 4 = 0 THEN a.z ELSE a.x END AS ax, a.y AS ay, CASE WHEN a.vec_id % 4 = 0 THEN a.x ELSE a.z END AS az, a.x AS x1, a.y AS y1, a.z AS z1, a.z AS x2, a.y AS y2, a.x AS z2 FROM p a),
s AS (SELECT vec_id, sqrt((ax - x1) ** 2 + (ay - y1) ** 2 + (az - z1) ** 2) + sqrt((ax + 0.01 - x2) ** 2 + (ay - y2) ** 2 + (az - z2) ** 2) AS direct,
  sqrt((ax - x2) ** 2 + (ay - y2) ** 2 + (az - z2) ** 2) + sqrt((ax + 0.01 - x1) ** 2 + (ay - y1) ** 2 + (az - z1) ** 2) AS swapped FROM e)
SELECT vec_id, round(least(direct, swapped), 6) AS best_distance, least(direct, swapped) <= 0.2 AS matched FROM s""")
def match_endpoints(spark, t):
    p = points(t)
    flip = F.col("vec_id") % 4 == 0
    ax, az = F.when(flip, F.col("z")).otherwise(F.col("x")), F.when(flip, F.col("x")).otherwise(F.col("z"))
    edges = p.select("vec_id", F.lit("a").alias("p1"), F.lit("b").alias("p2"), ax.alias("ax"), F.col("y").alias("ay"), az.alias("az"),
                     (ax + 0.01).alias("bx"), F.col("y").alias("by"), az.alias("bz"))
    first = p.select("vec_id", F.lit("a").alias("label"), "x", "y", "z")
    second = p.select("vec_id", F.lit("b").alias("label"), F.col("z").alias("x"), "y", F.col("x").alias("z"))
    out = joins.match_endpoints(edges, first.unionAll(second), "vec_id", 0.1)
    return out.withColumn("best_distance", F.round("best_distance", 6))


@query("match_rewritten", """
WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'raw/' ELSE 'mirror/' END || source || '/' || (doc_id // 2) AS path, lang FROM documents), r AS (SELECT path, lang, 'mirror/' || substr(path, 5) AS mirror_key FROM d WHERE starts_with(path, 'raw/'))
SELECT r.path, mirror_key, CASE WHEN m.path IS NULL THEN 'missing' WHEN m.lang = r.lang THEN 'same' ELSE 'different' END AS mirror_status FROM r LEFT JOIN d m ON m.path = mirror_key""")
def match_rewritten(spark, t):
    side = F.when(F.col("doc_id") % 2 == 0, "raw/").otherwise("mirror/")
    d = t.documents.select(F.concat(side, "source", F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("path"), "lang")
    return joins.match_rewritten(d, "path", "raw/", "mirror/", "lang")


@query("paired", """
SELECT conv_id, turn // 2 AS pair_no FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2 HAVING count(DISTINCT role) = 2""")
def paired(spark, t):
    x = t.conversations.select(F.struct("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("pair_no")).alias("stem"), "role")
    return joins.paired(x, "stem", "role", ["user", "assistant"]).select("stem.*")


@query("upsert", """
SELECT c_custkey, c_mktsegment, CASE WHEN u.k IS NOT NULL THEN u.bal ELSE c_acctbal END AS c_acctbal, u.n AS order_count
FROM customer LEFT JOIN (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS bal, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) u ON c_custkey = k""")
def upsert(spark, t):
    upd = t.orders.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.max("o_totalprice"), 2).alias("c_acctbal"), F.count(F.lit(1)).alias("order_count"))
    merged, _ = joins.upsert(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), upd, ["c_custkey"], ["c_acctbal", "order_count"])
    return merged


@query("upsert_misses", """
WITH u AS (SELECT l_partkey * 2 AS p_partkey, count(*) AS update_rows FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
SELECT p_partkey, update_rows, (SELECT count(*) FROM part p WHERE p.p_partkey = u.p_partkey) AS base_rows FROM u WHERE update_rows <> 1 OR p_partkey NOT IN (SELECT p_partkey FROM part)""")
def upsert_misses(spark, t):
    upd = t.lineitem.filter("l_quantity > 49").select((F.col("l_partkey") * 2).alias("p_partkey"), F.lit(1).alias("p_size"))
    _, bad = joins.upsert(t.part.select("p_partkey", "p_size"), upd, ["p_partkey"], ["p_size"])
    return bad


@query("overlap_flag", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS in_other FROM part")
def overlap_flag(spark, t):
    other = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.overlap_flag(t.part.select("p_partkey"), other, "p_partkey")


@query("deny_list", """
WITH bad AS (SELECT sha256(text) AS h FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id, source, CASE WHEN sha256(text) IN (SELECT h FROM bad) THEN 'refused' ELSE 'allowed' END AS verdict FROM documents""")
def deny_list(spark, t):
    docs = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    bad = docs.select("sha256", "source").distinct().groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    allowed, refused = joins.deny(docs, bad, "sha256")
    return allowed.withColumn("verdict", F.lit("allowed")).unionAll(refused.withColumn("verdict", F.lit("refused"))).drop("sha256")


_RECEIPTS = """SELECT c.conv_id, c.turn, sha256(c.conv_id || ':' || c.turn || ':' || c.role) AS h,
  CASE WHEN c.turn = 0 THEN NULL WHEN c.turn % 5 = 4 THEN sha256('lost') ELSE sha256(c.conv_id || ':' || (c.turn - 1) || ':' || CASE WHEN c.role = 'user' THEN 'assistant' ELSE 'user' END) END AS prev FROM conversations c"""


@query("hash_chain", f"""
WITH r AS ({_RECEIPTS}), k AS (SELECT h AS prev, count(*) AS n, min(conv_id || '/' || turn) AS pid FROM r GROUP BY 1)
SELECT conv_id || '/' || turn AS receipt_id, CASE WHEN n = 1 THEN pid END AS predecessor_id, CASE WHEN prev IS NULL THEN 'ROOT' WHEN n IS NULL THEN 'ORPHAN' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'LINKED' END AS chain_status FROM r LEFT JOIN k USING (prev)""")
def hash_chain(spark, t):
    c = t.conversations.select("conv_id", "turn", "role")
    digest = lambda turn, role: F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"), role), 256)
    other = F.when(F.col("role") == "user", "assistant").otherwise("user")
    prev = F.when(F.col("turn") == 0, None).when(F.col("turn") % 5 == 4, F.sha2(F.lit("lost"), 256)).otherwise(digest(F.col("turn") - 1, other))
    r = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("receipt_id"),
                 digest(F.col("turn"), F.col("role")).alias("sha256"), prev.alias("predecessor_sha256"))
    return joins.verify_chain(r)


@query("token_match", """
WITH f AS (SELECT s_suppkey, 'Supplier#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') || '_model_' || (s_suppkey % 4) || '.pdb' AS file_name FROM supplier)
SELECT s.s_name, f.file_name FROM supplier s JOIN f ON s.s_name = regexp_extract(f.file_name, '^(.*)_model', 1)""")
def token_match(spark, t):
    s = t.supplier
    key = F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")
    files = s.select(F.concat(F.lit("Supplier#"), key, F.lit("_model_"), (F.col("s_suppkey") % 4).cast("string"), F.lit(".pdb")).alias("file_name"))
    return joins.match_by_token(s.select("s_name"), files, "s_name", "file_name", "^(.*)_model")


@query("with_override", """
SELECT doc_id, source, CASE WHEN quality = 0 THEN 'manual' ELSE coalesce('auto_' || lang, '') END AS use_level FROM documents LEFT JOIN labels USING (doc_id)""")
def with_override(spark, t):
    docs = t.documents.select("doc_id", "source", F.concat(F.lit("auto_"), "lang").alias("use_level"))
    over = t.labels.filter("quality = 0").select("doc_id", F.lit("manual").alias("use_level"))
    return joins.with_override(docs, over, "doc_id", ["use_level"])


@query("allowlist", """
SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'may be used as is' WHEN 'de' THEN 'needs review' END AS condition_text FROM documents WHERE n_chars > 1000 AND lang IN ('en', 'de')""")
def allowlist(spark, t):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return rules.allowlist(docs, F.col("n_chars") > 1000, "lang", {"en": "may be used as is", "de": "needs review"}).drop("n_chars")


@query("union_by_name", "SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return sets.union_all([a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))])


@query("stage_sets", """
WITH g AS (SELECT user_id, bool_or(event_type = 'signup') a, bool_or(event_type = 'view') b, bool_or(event_type = 'purchase') c FROM (SELECT user_id * 100 + event_id % 25 AS user_id, event_type FROM events WHERE event_type IN ('signup', 'view', 'purchase')) GROUP BY 1)
SELECT user_id, concat_ws(';', CASE WHEN NOT a THEN 'signup' END, CASE WHEN NOT b THEN 'view' END, CASE WHEN NOT c THEN 'purchase' END) AS missing_stages FROM g WHERE NOT (a AND b AND c)""")
def stage_sets(spark, t):
    ev = t.events.select((F.col("user_id") * 100 + F.col("event_id") % 25).alias("user_id"), "event_type")
    return sets.stage_sets(ev, "user_id", "event_type", ["signup", "view", "purchase"])


@query("not_subset", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_subset(spark, t):
    return sets.not_subset(t.documents, t.labels, "doc_id")


@query("disjoint", "SELECT count(*) AS shared_count, count(*) = 0 AS disjoint FROM (SELECT 'C' || c_custkey FROM customer INTERSECT SELECT 'S' || s_suppkey FROM supplier)")
def disjoint(spark, t):
    a = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    b = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"))
    return sets.shared(a, b, "id").agg(F.count(F.lit(1)).alias("shared_count")).withColumn("disjoint", F.col("shared_count") == 0)


@query("shared", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def shared(spark, t):
    a = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    return sets.shared(a, t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")), "nationkey")


@query("two_sided_diff", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def two_sided_diff(spark, t):
    side = lambda s: t.orders.filter((F.col("o_orderstatus") == s) & (F.col("o_totalprice") > 300000)).select(F.col("o_custkey").alias("k"))
    return sets.two_sided_diff(side("O"), side("F"), "k")


def _snapshots(t):
    docs = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"), "source", "lang")
    before = docs.filter("bytes > 200").select("path", "sha256", "bytes")
    after = docs.filter("lang <> 'fr'").select("path", F.when(F.col("source") == "src6", F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"), "bytes")
    return before, after


@query("snapshot_delta", """
WITH d AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, n_chars, source, lang FROM documents), a AS (SELECT * FROM d WHERE n_chars > 200), b AS (SELECT path, CASE WHEN source = 'src6' THEN sha256(h) ELSE h END AS h, n_chars FROM d WHERE lang <> 'fr')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change, coalesce(b.n_chars, 0) AS changed_bytes FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_delta(spark, t):
    return sets.snapshot_delta(*_snapshots(t))


@query("unchanged", """
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT count(*) AS changes, count(*) = 0 AS unchanged FROM a FULL JOIN a b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def unchanged(spark, t):
    docs = t.documents.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    return sets.unchanged(docs, docs.repartition("sha256"))


@query("distinct_ordered", "SELECT DISTINCT p_type, p_size FROM part")
def distinct_ordered(spark, t):
    return sets.distinct_ordered(t.part, ["p_type", "p_size"], ["p_size", "p_type"])


@query("content_store", """
SELECT sha256(text) AS sha256, min(source || '/' || doc_id) AS stored_path, min(n_chars) AS object_bytes, count(*) AS reference_count, min(n_chars) <> max(n_chars) AS size_conflict FROM documents GROUP BY 1""")
def content_objects(spark, t):
    docs = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    return content_store(docs)[0]


