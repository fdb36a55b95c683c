"""Text scans, file policy, logs, scalar functions and table round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import clean
from siftline.operators import checks, rules
from siftline.plans.registry import query
from siftline.session import scratch_path
from siftline.sources import files, tables

_MORE = {"quoted token": r'token = "[0-9a-f]{40}"'}
_SCAN_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label FROM documents WHERE regexp_matches(text, '{pattern}')"
    for label, pattern in {
        **rules.SENSITIVE_PATTERNS, "OpenAI-style secret": "(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}", **_MORE,
    }.items()
)


@query("pattern_scan", _SCAN_SQL)
def pattern_scan(spark, t):
    return rules.scan_patterns(t.documents.select("doc_id", "text"), ["doc_id"], "text", {**rules.SENSITIVE_PATTERNS, **_MORE})


_INVENTORY = """SELECT source || '/' || CASE WHEN lang = 'es' THEN 'runs/' WHEN lang = 'de' THEN 'one_off/' ELSE 'main/' END || 'doc_' || CASE WHEN n_chars > 1000 THEN '20240101_' ELSE '' END || doc_id ||
  CASE lang WHEN 'fr' THEN '.NPZ' WHEN 'en' THEN '.txt' WHEN 'de' THEN '.py' ELSE '.pdb' END AS path, n_chars AS bytes,
  'doc_' || CASE WHEN n_chars > 1000 THEN '20240101_' ELSE '' END || doc_id || CASE lang WHEN 'fr' THEN '.NPZ' WHEN 'en' THEN '.txt' WHEN 'de' THEN '.py' ELSE '.pdb' END AS name, source, lang FROM documents"""


def _inventory(t):
    folder = F.when(F.col("lang") == "es", "runs/").when(F.col("lang") == "de", "one_off/").otherwise("main/")
    suffix = F.when(F.col("lang") == "fr", ".NPZ").when(F.col("lang") == "en", ".txt").when(F.col("lang") == "de", ".py").otherwise(".pdb")
    dated = F.when(F.col("n_chars") > 1000, "20240101_").otherwise("")
    path = F.concat("source", F.lit("/"), folder, F.lit("doc_"), dated, F.col("doc_id").cast("string"), suffix)
    return t.documents.select(path.alias("path"), F.col("n_chars").alias("bytes"))


@query("policy_rules", f"""
WITH i AS ({_INVENTORY})
SELECT path, 'size_limit' AS rule, bytes::VARCHAR AS detail FROM i WHERE bytes > 4000 UNION ALL
SELECT path, 'blocked_suffix', '.npz' FROM i WHERE lang = 'fr' UNION ALL
SELECT path, 'blocked_segment', 'runs' FROM i WHERE lang = 'es' UNION ALL
SELECT path, 'outside_allowed_prefix', '.pdb' FROM i WHERE lang = 'es' AND NOT starts_with(path, 'src1') UNION ALL
SELECT path, 'missing_date', name FROM i WHERE lang = 'de' AND bytes <= 1000 AND NOT regexp_matches(name, '20[0-9]{6}')""")
def policy_rules(spark, t):
    policy = rules.FilePolicy(
        max_bytes=4000, blocked_suffixes=rules.DEFAULT_POLICY.blocked_suffixes, blocked_segments=rules.DEFAULT_POLICY.blocked_segments,
        restricted_suffix=".pdb", allowed_prefix="src1", dated_segment="one_off")
    return rules.policy_check(_inventory(t), policy)


@query("report_finder", "SELECT doc_id, lang FROM documents WHERE contains(lower(source || ' ' || text), 'the wh') AND 'en' IN (lang, source)")
def report_finder(spark, t):
    docs = t.documents.select("doc_id", "lang", "source", "text", F.array("lang", "source").alias("groups"))
    return rules.find_reports(docs, ["source", "text"], "  The Wh ", "groups", "en").select("doc_id", "lang")


@query("report_counts", """
WITH x AS (SELECT lang, source FROM documents WHERE contains(lower(source || ' ' || text), 'the wh'))
SELECT g AS group_name, (SELECT count(*) FROM x WHERE g IN (lang, source) OR g = 'all') AS result_count FROM (SELECT unnest(['en', 'src3', 'absent', 'all']) AS g)""")
def report_counts(spark, t):
    docs = t.documents.select("source", "text", F.array("lang", "source").alias("groups"))
    return rules.report_counts(docs, ["source", "text"], "the wh", "groups", ["en", "src3", "absent"])


@query("log_timings", """
SELECT event_type AS stage, count(*) AS runs, round(sum(value), 2) AS total_seconds, max(value) AS max_seconds FROM events WHERE event_type <> 'error' GROUP BY 1""")
def log_timings(spark, t):
    done = F.concat(F.lit("✓ Step "), "event_type", F.lit(" completed successfully in "), F.col("value").cast("string"), F.lit("s"))
    line = F.when(F.col("event_type") == "error", F.lit("Traceback: step failed")).otherwise(done)
    path = scratch_path(spark, "log")
    t.events.select(line).write.text(path)
    found = files.extract_stage_timings(spark.read.text(path))
    return found.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("seconds"), 2).alias("total_seconds"), F.max("seconds").alias("max_seconds"))


@query("record_stats", """
SELECT source AS file, count(*) AS record_count, sum(length(regexp_replace(regexp_replace(text, '^[ ]+', ''), '[ ]+$', '')))::BIGINT AS payload_length
FROM (SELECT source, replace(replace(text, chr(10), ''), '>', '') AS text FROM documents) GROUP BY 1""")
def record_stats(spark, t):
    flat = F.regexp_replace(F.regexp_replace("text", "[\n>]", ""), "^ +| +$", "")
    lines = t.documents.select(F.col("source").alias("file"), F.explode(F.array(F.concat(F.lit(">"), F.col("doc_id").cast("string")), flat)).alias("value"))
    return files.record_stats(lines, "fasta")


@query("json_list_sizes", "SELECT event_type AS file, sum(event_id % 4)::BIGINT AS members FROM events GROUP BY 1")
def json_list_sizes(spark, t):
    members = F.transform(F.sequence(F.lit(0), F.col("event_id") % 4), lambda i: i)
    docs = t.events.select("event_type", F.to_json(F.slice(members, 1, (F.col("event_id") % 4).cast("int"))).alias("doc"))
    return files.json_list_sizes(docs, "event_type", "doc").groupBy(F.col("event_type").alias("file")).agg(F.sum("record_count").alias("members"))


_SEQ = "regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ARNDCQEGHILKMFPSTWYV]', '', 'g')"
_HYDRO = " + ".join(f"(length(s) - length(replace(s, '{k}', ''))) * {v}::DOUBLE" for k, v in clean.HYDROPATHY.items())


@query("sequence_metrics", f"""
SELECT doc_id, (len(regexp_extract_all(s, 'N[GST]')) + len(regexp_extract_all(s, 'D[GST]')) + len(regexp_extract_all(s, 'M')) + len(regexp_extract_all(s, 'W')))::BIGINT AS liabilities,
  CASE WHEN s <> '' THEN round(({_HYDRO}) / length(s), 8) END AS gravy FROM (SELECT doc_id, {_SEQ} AS s FROM documents)""")
def sequence_metrics(spark, t):
    seq = F.regexp_replace(F.upper("text"), "[^ARNDCQEGHILKMFPSTWYV]", "")
    x = t.documents.select("doc_id", seq.alias("s"))
    return x.select("doc_id", clean.motif_count("s").cast("long").alias("liabilities"), F.round(clean.hydropathy("s"), 8).alias("gravy"))


@query("position_parse", """
WITH x AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size || 'a' WHEN 'STANDARD' THEN (-p_size)::VARCHAR WHEN 'PROMO' THEN 'x' || p_size ELSE ' ' || p_size || ' ' END AS auth, CASE WHEN p_size > 25 THEN 'b' ELSE '?' END AS ins, p_type, p_size FROM part)
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN NULL WHEN 'STANDARD' THEN -p_size ELSE p_size END AS base, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'ECONOMY' THEN 'A' WHEN p_size > 25 THEN 'B' ELSE '' END AS insertion FROM x""")
def position_parse(spark, t):
    size = F.col("p_size").cast("string")
    auth = (F.when(F.col("p_type") == "ECONOMY", F.concat(size, F.lit("a"))).when(F.col("p_type") == "STANDARD", (-F.col("p_size")).cast("string"))
            .when(F.col("p_type") == "PROMO", F.concat(F.lit("x"), size)).otherwise(F.concat(F.lit(" "), size, F.lit(" "))))
    ins = F.when(F.col("p_size") > 25, "b").otherwise("?")
    return t.part.select("p_partkey", clean.parse_position(auth, ins).alias("p")).select("p_partkey", "p.base", "p.insertion")


@query("letters", """
WITH x AS (SELECT doc_id, regexp_extract_all(upper(text), '(?s).{3}') AS names FROM documents)
SELECT doc_id, array_to_string(list_transform(names, lambda name: CASE name WHEN 'ALA' THEN 'A' WHEN 'ARG' THEN 'R' WHEN 'THR' THEN 'T' WHEN 'SER' THEN 'S' WHEN 'LEU' THEN 'L' WHEN 'VAL' THEN 'V' WHEN 'PRO' THEN 'P' WHEN 'ASN' THEN 'N' WHEN 'ASP' THEN 'D' WHEN 'CYS' THEN 'C'
  WHEN 'GLN' THEN 'Q' WHEN 'GLU' THEN 'E' WHEN 'GLY' THEN 'G' WHEN 'HIS' THEN 'H' WHEN 'ILE' THEN 'I' WHEN 'LYS' THEN 'K' WHEN 'MET' THEN 'M' WHEN 'PHE' THEN 'F' WHEN 'TRP' THEN 'W' WHEN 'TYR' THEN 'Y' ELSE 'X' END), '') AS letters FROM x""")
def letters(spark, t):
    triplets = F.regexp_extract_all("text", F.lit("(?s).{3}"), F.lit(0))
    return t.documents.select("doc_id", F.array_join(F.transform(triplets, clean.letters), "").alias("letters"))


@query("range_slices", """
SELECT doc_id, substr(text, 2, 4) || '|' || substr(text, 9, 1) || '|' || substr(text, 12, 9) AS pieces, '2,3,4,5,9,12,13,14,15,16,17,18,19,20' AS positions, NULL::VARCHAR AS overlapping,
  (length(text) = length(concat('#', substr(text, 2)))) AND text[1] = '#' AS unchanged_outside_tail, length(text) > 0 AS unchanged_outside_head FROM documents""")
def range_slices(spark, t):
    d = t.documents.select("doc_id", "text")
    ranges = F.lit("2..5, 9, 12..20")
    marked = F.concat(F.lit("#"), F.substring("text", 2, 1 << 30))
    return d.select(
        "doc_id", F.array_join(clean.slice_regions("text", ranges), "|").alias("pieces"),
        F.array_join(clean.expand_ranges(ranges).cast("array<string>"), ",").alias("positions"),
        F.array_join(clean.expand_ranges(F.lit("2..5,5..9")).cast("array<string>"), ",").alias("overlapping"),
        clean.mask_unchanged("text", marked, F.lit("2..3")).alias("unchanged_outside_tail"),
        clean.mask_unchanged("text", marked, F.lit("1")).alias("unchanged_outside_head"))


@query("logical_paths", r"""
WITH x AS (SELECT page_id, CASE WHEN url LIKE 'https:%' THEN regexp_replace(url, '^https?://', '') ELSE '/' || regexp_replace(url, '^https?://', '') END AS p FROM pages)
SELECT page_id, CASE WHEN NOT starts_with(p, '/') AND NOT contains(p, '//') AND NOT ends_with(p, '/') AND NOT regexp_matches(p, '(^|/)[.]{1,2}(/|$)') THEN p END AS logical,
  CASE WHEN NOT starts_with(p, '/') AND NOT contains(p, '//') AND NOT ends_with(p, '/') AND NOT regexp_matches(p, '(^|/)[.]{1,2}(/|$)') THEN 'workspace' END AS scheme FROM x""")
def logical_paths(spark, t):
    bare = F.regexp_replace("url", "^https?://", "")
    p = F.when(F.col("url").startswith("https:"), bare).otherwise(F.concat(F.lit("/"), bare))
    x = t.pages.select("page_id", p.alias("p"))
    return x.select("page_id", clean.logical_path("p").alias("logical"), clean.uri_path(F.concat(F.lit("workspace://"), "p"))["scheme"].alias("scheme"))


@query("id_text", """
SELECT c_custkey, 'C' || CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS padded, 'run_' || c_mktsegment AS head, c_custkey::VARCHAR AS tail,
  regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._-]{7,127}$') AS is_safe_id, c_custkey < 12 AS is_task_id, 'Customer;' || c_mktsegment AS joined, 2 AS parts FROM customer""")
def id_text(spark, t):
    key = F.col("c_custkey").cast("string")
    run = F.concat(F.lit("run_"), "c_mktsegment", F.lit("_"), key)
    joined = F.concat_ws(";", F.lit("Customer"), "c_mktsegment")
    return t.customer.select(
        "c_custkey", clean.padded_id("C", F.col("c_custkey"), 3).alias("padded"), clean.head_before_last(run).alias("head"), clean.last_token(run).alias("tail"),
        F.col("c_name").rlike(clean.SAFE_ID).alias("is_safe_id"), F.concat(F.lit("T"), key).rlike(clean.TASK_ID).alias("is_task_id"),
        joined.alias("joined"), F.size(F.split(joined, ";")).alias("parts"))


@query("truncations", """
WITH x AS (SELECT item_id, text FROM benchmark), w(variant, s, e) AS (VALUES ('full', 1, 37), ('amide', 1, 36), ('short', 3, 37), ('long', 1, 900))
SELECT item_id, variant, s AS start, e AS "end", substr(text, s, e - s + 1) AS sequence FROM x, w WHERE length(text) >= e""")
def truncations(spark, t):
    w = {"full": (1, 37), "amide": (1, 36), "short": (3, 37), "long": (1, 900)}
    return t.benchmark.select("item_id", F.explode(clean.truncations("text", w)).alias("v")).select("item_id", "v.*")


@query("json_time_text", """
SELECT event_id, json_extract_string(props, '$.k') AS k_value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed_second, NULL::VARCHAR AS refused_second,
  printf('%d hours, %d minutes, %d seconds', (floor(value * 60)::BIGINT // 3600), ((floor(value * 60)::BIGINT % 3600) // 60), (floor(value * 60)::BIGINT % 60)) AS duration,
  round(value / 1048576.0, 12) AS gib, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS canonical_sha256 FROM events""")
def json_time_text(spark, t):
    k = F.get_json_object("props", "$.k")
    pairs = F.array(F.struct(F.lit("Mass").alias("label"), F.lit("Exact").alias("name"), F.lit("0").alias("value")), F.struct(F.lit("Key").alias("label"), F.lit("k").alias("name"), k.alias("value")))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    second = lambda c: F.date_format(clean.utc_second(c), "yyyy-MM-dd HH:mm:ss")
    return t.events.select(
        "event_id", clean.property_lookup(pairs, "Key", "k").alias("k_value"), second(iso).alias("parsed_second"), second(F.concat(iso, F.lit("Z"))).alias("refused_second"),
        clean.duration_text(F.col("value") * 60).alias("duration"), F.round(clean.kib_to_gib("value"), 12).alias("gib"),
        F.sha2(clean.canonical_json(["event_type", "event_id"]), 256).alias("canonical_sha256"))


@query("pretty_bytes", """
SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.3f KiB', n_chars / 1024.0::DOUBLE) END AS size_text, printf('%.3f GiB', n_chars * 1048576.0 / 1024) AS unit_check
FROM (SELECT doc_id, n_chars FROM documents WHERE n_chars < 1024 * 1024)""")
def pretty_bytes(spark, t):
    return t.documents.select("doc_id", clean.pretty_bytes("n_chars").alias("size_text"), F.format_string("%.3f GiB", F.col("n_chars") * 1048576.0 / 1024).alias("unit_check"))


@query("half_even", "SELECT p_partkey, round_even(p_size / 8.0::DOUBLE, 2) AS rounded FROM part")
def half_even(spark, t):
    return t.part.select("p_partkey", clean.half_even(F.col("p_size") / 8.0, 2).alias("rounded"))


# ---- round trips: written from the given tables, read back with the contract readers ----


@query("io_tables", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS o_orderpriority, NULL::VARCHAR AS note FROM orders")
def io_tables(spark, t):
    path = scratch_path(spark, "table")
    prio = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    out = t.orders.select("o_orderkey", "o_orderstatus", prio.alias("o_orderpriority"))
    tables.write_table(out, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"], ["o_orderkey"])
    back = tables.read_table(spark, path, ["o_orderkey", "o_orderpriority"], sep="\t")
    return tables.fit_columns(back, ["o_orderkey", "o_orderstatus", "o_orderpriority", "note"])


@query("io_contract", "SELECT p_partkey, p_name, p_retailprice FROM part")
def io_contract(spark, t):
    path = scratch_path(spark, "contract")
    tables.write_table(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return tables.read_contract_tsv(spark, path, "p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE")


@query("io_json", """
SELECT conv_id, turn, role, length(text) AS size FROM conversations""")
def io_json(spark, t):
    path = scratch_path(spark, "json")
    item = F.struct("conv_id", "turn", "role", F.length("text").alias("size"))
    t.conversations.select("conv_id", F.array(item).alias("turns")).write.json(path)
    return tables.read_json(spark, path, "conv_id BIGINT, turns ARRAY<STRUCT<conv_id: BIGINT, turn: BIGINT, role: STRING, size: BIGINT>>", "turns", per_line=True)


@query("io_jsonl", """
SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'read' END AS side, count(*) AS lines, coalesce(round(sum(value) FILTER (event_type <> 'error'), 2), 0) AS total FROM events GROUP BY 1""")
def io_jsonl(spark, t):
    path = scratch_path(spark, "jsonl")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    t.events.select(F.when(F.col("event_type") == "error", F.concat(good, F.lit("}{"))).otherwise(good)).write.text(path)
    ok, bad = tables.read_jsonl(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")
    read = ok.agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("value"), 2).alias("total")).select(F.lit("read").alias("side"), "lines", "total")
    return read.unionAll(bad.agg(F.count(F.lit(1)).alias("lines")).select(F.lit("rejected"), "lines", F.lit(0.0)))


@query("io_registry", "SELECT c_custkey, c_name FROM customer")
def io_registry(spark, t):
    path = scratch_path(spark, "registry")
    tables.write_registry({"customer": t.customer, "orders": t.orders}, {"customer": ["c_custkey"], "orders": ["o_orderkey"]}, {"schema_version": "1"}, path)
    return tables.read_registry(spark, path, "customer").select("c_custkey", "c_name")


@query("io_check", "SELECT s_suppkey, s_name, 'new' AS side, 1::BIGINT AS row_count FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, s_name, 'stale', 1 FROM supplier WHERE s_acctbal > 9000")
def io_check(spark, t):
    path = scratch_path(spark, "published")
    tables.write_new(t.supplier.filter("s_acctbal >= 0").select("s_suppkey", "s_name"), path)
    return tables.check_published(t.supplier.filter("s_acctbal <= 9000").select("s_suppkey", "s_name"), path)


@query("io_manifest", """
WITH d AS (SELECT doc_id, source, sha256(text) AS h, CASE WHEN lang = 'es' THEN '../' ELSE '' END || source || '/' || CASE WHEN n_chars > 9000 THEN 'big' ELSE doc_id::VARCHAR END AS path, lang FROM documents), c AS (SELECT path, count(*) AS n FROM d WHERE source <> 'src4' GROUP BY 1)
SELECT CASE WHEN source = 'src4' THEN 'malformed' WHEN lang = 'es' THEN 'unsafe_path' WHEN n > 1 THEN 'duplicate_path' ELSE 'listed' END AS verdict, count(*) AS lines FROM d LEFT JOIN c USING (path) GROUP BY 1""")
def io_manifest(spark, t):
    path = scratch_path(spark, "manifest")
    rel = F.concat(F.when(F.col("lang") == "es", "../").otherwise(""), "source", F.lit("/"), F.when(F.col("n_chars") > 9000, "big").otherwise(F.col("doc_id").cast("string")))
    digest = F.sha2("text", 256)
    t.documents.select(F.concat(F.when(F.col("source") == "src4", F.upper(digest)).otherwise(digest), F.lit("  "), rel)).write.text(path)
    good, bad = files.read_manifest(spark, path)
    rows = good.select(F.lit("listed").alias("verdict")).unionAll(bad.select("reason"))
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("lines"))


@query("io_inventory", "SELECT source, '.txt' AS suffix, sum(octet_length(encode(text)) + 1)::BIGINT AS total_bytes FROM documents GROUP BY 1")
def io_inventory(spark, t):
    path = scratch_path(spark, "files")
    t.documents.select("source", "text").write.partitionBy("source").text(path)
    inv = files.file_inventory(spark, path)
    return inv.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "suffix").agg(F.sum("bytes").alias("total_bytes"))


@query("io_telemetry", "SELECT event_type, max(round(value)) AS used_peak, min(1000 + event_id % 9)::DOUBLE AS total_min FROM events GROUP BY 1")
def io_telemetry(spark, t):
    path = scratch_path(spark, "telemetry")
    used = F.concat(F.lit(" "), F.round("value").cast("long").cast("string"), F.lit(" MiB"))
    total = F.concat(F.lit(" "), (1000 + F.col("event_id") % 9).cast("string"))
    out = t.events.select("event_type", used.alias(" memory.used [MiB]"), total.alias(" memory.total [MiB]"))
    out.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    tel = files.read_telemetry(spark, path)
    return tel.groupBy("event_type").agg(F.max("used_mib").alias("used_peak"), F.min("total_mib").alias("total_min"))


@query("sql_text", "SELECT n_name, count(*) AS customers, 12 AS panel FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sql_text(spark, t):
    return tables.run_sql(spark, {"customer": t.customer, "nation": t.nation}, "SELECT n_name, count(*) AS customers, 12 AS panel FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")


@query("schema_typed", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, NULL::DOUBLE AS event_type FROM events")
def schema_typed(spark, t):
    raw = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return tables.typed(checks.require_columns(raw, ["event_id", "k"]), {"k": "int", "event_type": "double"})
