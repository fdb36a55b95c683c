"""Similarity, clustering, selection and closures over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import cluster, ranking, select, similarity
from siftline.operators.joins import range_pairs
from siftline.plans.joins import points
from siftline.plans.registry import query
from siftline.session import stage_table

# Settings of the shape queries: shared positions needed, anchors, and the three scales.
MIN_COMMON, ANCHORS, SCALES = 4, 4, (1.2, 0.16, 0.06)


def shapes(t):
    """Six numbered points per vector; a point is observed where its first coordinate is below 0.25."""
    e = t.embeddings.select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 18)).alias("i", "v"))
    axis = F.col("i") % 3
    pts = e.groupBy("vec_id", "label", (F.floor(F.col("i") / 3) + 1).cast("int").alias("pos")).agg(
        *[F.max(F.when(axis == k, F.col("v").cast("double"))).alias(c) for k, c in enumerate("xyz")])
    letter = F.concat(F.when(F.col("x") > 0, "A").otherwise("G"), F.when(F.col("y") > 0, "K").otherwise("L"))
    return pts.filter((F.col("pos") <= ANCHORS) | (F.col("x") < 0.25)).withColumn("letter", letter)


def shape_pairs(t, limit: float = 1.0):
    """Near pairs among distinct shapes, the map of copies, and the shapes."""
    pts = stage_table(shapes(t), "points")
    every = similarity.point_profiles(pts, "vec_id", "pos", "letter", F.col("pos") <= ANCHORS)
    profiles, copies = similarity.collapse_copies(every, "vec_id", [F.to_json(F.struct("pos", "let", "xs", "ys", "zs"))])
    profiles, copies = stage_table(profiles, "profiles"), stage_table(copies, "copies")
    scored = similarity.near_shapes(profiles, "vec_id", ANCHORS, MIN_COMMON, limit * SCALES[2])
    near = scored.withColumn("distance", similarity.combined_distance("identity", "rmsd", "anchor_rmsd", SCALES)).filter(F.col("distance") < limit)
    return near, copies, profiles


def shape_clusters(t):
    """Clusters of all shapes; the pairs are written once, as the links that the loop starts from."""
    pairs, copies, profiles = shape_pairs(t)
    members = cluster.threshold_clusters(pairs, copies.select(F.col("representative").alias("vec_id")).distinct(), "vec_id", 1.0)
    return cluster.expand_members(members, copies, "vec_id"), profiles


def _det3(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cofactors(m: list[list[str]]) -> list[list[str]]:
    minor = lambda r, c: [[m[x][y] for y in range(4) if y != c] for x in range(4) if x != r]
    return [[f"({'-' if (r + c) % 2 else ''}{_det3(minor(r, c))})" for c in range(4)] for r in range(4)]


def _shapes_sql() -> str:
    """Superposition by quaternions: the largest root of the quartic by Newton steps, its vector from cofactors."""
    k = [["s00 + s11 + s22", "s12 - s21", "s20 - s02", "s01 - s10"], ["", "s00 - s11 - s22", "s01 + s10", "s20 + s02"], ["", "", "s11 - s00 - s22", "s12 + s21"], ["", "", "", "s22 - s00 - s11"]]
    name = lambda r, c: f"k{min(r, c)}{max(r, c)}"
    own = [[f"({name(r, c)} - lam)" if r == c else name(r, c) for c in range(4)] for r in range(4)]
    plain = [[name(r, c) for c in range(4)] for r in range(4)]
    det = " + ".join(f"{plain[0][c]} * {x}" for c, x in enumerate(_cofactors(plain)[0]))
    cof = _cofactors(own)
    rows = ", ".join("[" + ", ".join(r) + "]" for r in cof)
    axes = ("x", "y", "z")
    sums = ", ".join(f"sum(p.{a} * q.{b}) - sum(p.{a}) * sum(q.{b}) / count(*) AS s{i}{j}" for i, a in enumerate(axes) for j, b in enumerate(axes))
    turn = [
        ["1 - 2 * (v[3] * v[3] + v[4] * v[4]) / n2", "2 * (v[2] * v[3] - v[1] * v[4]) / n2", "2 * (v[2] * v[4] + v[1] * v[3]) / n2"],
        ["2 * (v[2] * v[3] + v[1] * v[4]) / n2", "1 - 2 * (v[2] * v[2] + v[4] * v[4]) / n2", "2 * (v[3] * v[4] - v[1] * v[2]) / n2"],
        ["2 * (v[2] * v[4] - v[1] * v[3]) / n2", "2 * (v[3] * v[4] + v[1] * v[2]) / n2", "1 - 2 * (v[2] * v[2] + v[3] * v[3]) / n2"],
    ]
    error = " + ".join(f"power({' + '.join(f'({turn[i][j]}) * (p.{b} - pm{b})' for j, b in enumerate(axes))} - (q.{a} - qm{a}), 2)" for i, a in enumerate(axes))
    return f"""
raw AS (SELECT vec_id, label, i + 1 AS pos, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(6) r(i)),
pts AS (SELECT *, CASE WHEN x > 0 THEN 'A' ELSE 'G' END || CASE WHEN y > 0 THEN 'K' ELSE 'L' END AS letter FROM raw WHERE pos <= {ANCHORS} OR x < 0.25),
shape AS (SELECT vec_id, count(*) AS n, list((pos, letter, x, y, z) ORDER BY pos) AS s FROM pts GROUP BY 1),
copies AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY s) AS representative, n FROM shape),
d AS (SELECT vec_id, n FROM copies WHERE vec_id = representative),
m AS (SELECT p.vec_id AS id_a, q.vec_id AS id_b, count(*) AS common, count(*) FILTER (p.letter = q.letter) AS same, any_value(a.n + b.n) AS both_n, {sums}, {', '.join(f'avg({t}.{c}) AS {t}m{c}' for t in 'pq' for c in axes)},
  sum(p.x * p.x + p.y * p.y + p.z * p.z) - (sum(p.x) * sum(p.x) + sum(p.y) * sum(p.y) + sum(p.z) * sum(p.z)) / count(*) AS ga, sum(q.x * q.x + q.y * q.y + q.z * q.z) - (sum(q.x) * sum(q.x) + sum(q.y) * sum(q.y) + sum(q.z) * sum(q.z)) / count(*) AS gb
  FROM pts p JOIN d a ON a.vec_id = p.vec_id JOIN pts q ON q.pos = p.pos AND q.vec_id > p.vec_id JOIN d b ON b.vec_id = q.vec_id GROUP BY 1, 2),
k AS (SELECT *, {', '.join(f'{k[r][c]} AS k{r}{c}' for r in range(4) for c in range(r, 4))} FROM m),
c AS (SELECT *, -2 * ({' + '.join(f's{i}{j} * s{i}{j}' for i in range(3) for j in range(3))}) AS c2, -8 * {_det3([[f's{i}{j}' for j in range(3)] for i in range(3)])} AS c1, {det} AS c0 FROM k),
l AS (SELECT *, list_reduce(list_prepend((ga + gb) / 2, list_transform(range(60), lambda i: i::DOUBLE)), lambda t, i: t - coalesce((((t * t + c2) * t + c1) * t + c0) / nullif((4 * t * t + 2 * c2) * t + c1, 0), 0)) AS lam FROM c),
w AS (SELECT *, list_sort(list_transform([{rows}], lambda r: [list_sum(list_transform(r, lambda e: e * e)), r[1], r[2], r[3], r[4]]))[-1] AS top FROM l),
v AS (SELECT *, top[2:5] AS v, top[1] AS n2 FROM w),
e AS (SELECT id_a, id_b, any_value(common) AS common_positions, any_value(same / (both_n - common)) AS identity, sqrt(avg({error})) AS rmsd, sqrt(avg({error}) FILTER (p.pos <= {ANCHORS})) AS anchor_rmsd
  FROM v JOIN pts p ON p.vec_id = id_a JOIN pts q ON q.vec_id = id_b AND q.pos = p.pos GROUP BY 1, 2),
near AS (SELECT *, greatest((1 - identity) / {SCALES[0]}, rmsd / {SCALES[1]}, anchor_rmsd / {SCALES[2]}) AS distance FROM e WHERE greatest((1 - identity) / {SCALES[0]}, rmsd / {SCALES[1]}, anchor_rmsd / {SCALES[2]}) < 1.0)"""


@query("kabsch_pairs", f"""
WITH {_shapes_sql()}
SELECT id_a, id_b, common_positions::INTEGER AS common_positions, {', '.join(f'round({c}, 6) AS {c}' for c in ('identity', 'rmsd', 'anchor_rmsd', 'distance'))} FROM near""")
def kabsch_pairs(spark, t):
    return shape_pairs(t)[0].select("id_a", "id_b", "common_positions", *[F.round(c, 6).alias(c) for c in ("identity", "rmsd", "anchor_rmsd", "distance")])


@query("shape_signature", """
WITH c AS (SELECT vec_id, p, embedding[3 * p + 1]::DOUBLE AS x, embedding[3 * p + 2]::DOUBLE AS y, embedding[3 * p + 3]::DOUBLE AS z FROM embeddings, range(4) r(p))
SELECT vec_id, count(*) AS points, round(var_pop(x) + var_pop(y) + var_pop(z), 6) AS spread FROM c GROUP BY 1""")
def shape_signature(spark, t):
    s = similarity.shape_signature(shapes(t).filter(F.col("pos") <= ANCHORS), "vec_id")
    return s.select("vec_id", "points", F.round(F.col("s1") ** 2 + F.col("s2") ** 2 + F.col("s3") ** 2, 6).alias("spread"))


@query("combined_distance", """
WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings),
m AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, (a.label = b.label)::INT::DOUBLE AS identity, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS rmsd, CASE WHEN a.w > 0 AND b.w > 0 THEN abs(a.w - b.w) END AS anchor FROM p a JOIN p b ON a.vec_id < b.vec_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.0025)
SELECT id_a, id_b, round(CASE WHEN anchor IS NULL THEN 999.0 ELSE greatest((1.0 - identity) / 2.0, rmsd / 0.05, anchor / 0.5) END, 6) AS distance FROM m""")
def combined_distance(spark, t):
    p = points(t).join(t.embeddings.select("vec_id", F.element_at("embedding", 4).cast("double").alias("w")), "vec_id")
    near = range_pairs(p, p, [], ["x", "y", "z"], 0.05, ["vec_id", "label", "w"], ["vec_id", "label", "w"]).filter("vec_id_a < vec_id_b")
    identity = (F.col("label_a") == F.col("label_b")).cast("double")
    anchor = F.when((F.col("w_a") > 0) & (F.col("w_b") > 0), F.abs(F.col("w_a") - F.col("w_b")))
    d = similarity.combined_distance(identity, "distance", anchor, (2.0, 0.05, 0.5))
    return near.select(F.col("vec_id_a").alias("id_a"), F.col("vec_id_b").alias("id_b"), F.round(d, 6).alias("distance"))


def _clusters_sql() -> str:
    """The two nearest clusters merge, one pair a step, as long as all pairs across them are near."""
    cross = "list_max(flatten(list_transform(c[i], lambda a: list_transform(c[j], lambda b: coalesce(m[least(a, b) * 1000000000 + greatest(a, b)], 'inf'::DOUBLE)))))"
    options = f"flatten(list_transform(range(1, len(c)), lambda i: list_transform(range(i + 1, len(c) + 1), lambda j: [{cross}, least(c[i][1], c[j][1])::DOUBLE, greatest(c[i][1], c[j][1])::DOUBLE, i::DOUBLE, j::DOUBLE])))"
    return f"""{_shapes_sql()},
ends AS (SELECT id_a AS x FROM near UNION SELECT id_b FROM near),
merge(step, m, c) AS (
  SELECT 0, (SELECT map_from_entries(list((id_a * 1000000000 + id_b, distance))) FROM near), (SELECT list([x] ORDER BY x) FROM ends)
  UNION ALL
  SELECT step + 1, m, list_append(list_filter(c, lambda x, k: k <> top[4] AND k <> top[5]), list_sort(list_concat(c[top[4]::BIGINT], c[top[5]::BIGINT]))) FROM (
    SELECT *, list_sort(list_filter({options}, lambda o: o[1] < 1))[1] AS top FROM merge WHERE len(c) > 1) WHERE top IS NOT NULL),
last AS (SELECT unnest(c) AS own FROM merge WHERE step = (SELECT max(step) FROM merge)),
grown AS (SELECT unnest(own) AS representative, own[1] AS cluster FROM last),
members AS (SELECT vec_id, coalesce(cluster, representative) AS cluster FROM copies LEFT JOIN grown USING (representative))"""


@query("threshold_clusters", f"""
WITH RECURSIVE {_clusters_sql()}
SELECT vec_id, printf('FWC%04d', dense_rank() OVER (ORDER BY low)) AS cluster_id FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY cluster) AS low FROM members)""")
def threshold_clusters(spark, t):
    return cluster.number_clusters(shape_clusters(t)[0], "vec_id").select("vec_id", "cluster_id")


@query("representatives", f"""
WITH RECURSIVE {_clusters_sql()},
b AS (SELECT vec_id, cluster, first_value(vec_id) OVER w AS representative, count(*) OVER (PARTITION BY cluster) AS cluster_size
  FROM members JOIN (SELECT vec_id, label, embedding[1]::DOUBLE AS quality FROM embeddings) USING (vec_id) WINDOW w AS (PARTITION BY cluster ORDER BY label, quality DESC, vec_id))
SELECT vec_id, representative, 'quality_order' AS reason, cluster_size, vec_id = representative AS is_representative, {', '.join(f'round({c}, 6) AS {c}' for c in ('identity', 'rmsd', 'anchor_rmsd'))}
FROM b LEFT JOIN near ON id_a = least(vec_id, representative) AND id_b = greatest(vec_id, representative)""")
def representatives(spark, t):
    members, profiles = shape_clusters(t)
    nodes = t.embeddings.select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("quality"))

    def metrics(pairs):  # distinct shapes of one cluster are near; copies have no pairs
        return similarity.superpose_pairs(pairs, profiles, "vec_id", ANCHORS, MIN_COMMON).drop("common_positions")

    out = cluster.representatives(members, nodes, "vec_id", "cluster", ["label", F.col("quality").desc(), "vec_id"], metrics=metrics)
    return out.select("vec_id", "representative", "reason", "cluster_size", "is_representative", *[F.round(c, 6).alias(c) for c in ("identity", "rmsd", "anchor_rmsd")])


@query("diverse_select", """
WITH RECURSIVE n AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, abs(embedding[1]::DOUBLE) AS q FROM embeddings),
t(k, picks, trail) AS (
  SELECT 1, [first], [{'id': first.id, 'q': first.q, 'u': NULL::DOUBLE, 's': NULL::DOUBLE, 'g': NULL::DOUBLE}] FROM (SELECT arg_max({'id': id, 'label': label, 'v': v, 'q': q}, [q, id::DOUBLE]) AS first FROM n)
  UNION ALL
  SELECT k + 1, list_append(any_value(picks), arg_max({'id': id, 'label': label, 'v': v, 'q': q}, [u, q, id::DOUBLE])), list_append(any_value(trail), arg_max({'id': id, 'q': q, 'u': u, 's': s, 'g': g}, [u, q, id::DOUBLE])) FROM (
    SELECT *, 0.5 * q + 0.3 * s + 0.2 * g AS u FROM (
      SELECT k, picks, trail, id, label, v, q, list_min(list_transform(picks, lambda p: (p.label IS DISTINCT FROM n.label)::INTEGER::DOUBLE)) AS s, list_min(list_transform(picks, lambda p: least(1.0, list_distance(p.v, n.v) / 2.0))) AS g
      FROM t, n WHERE k < 12 AND NOT list_contains(list_transform(picks, lambda p: p.id), n.id))) GROUP BY k)
SELECT rank::INTEGER AS selection_rank, x.id AS vec_id, CASE WHEN rank <= 10 THEN 'primary' ELSE 'reserve' END AS role, round(x.q, 6) AS quality, round(x.u, 6) AS utility, round(x.s, 6) AS min_sequence_distance, round(x.g, 6) AS min_geometry_distance
FROM (SELECT unnest(trail) AS x, unnest(range(1, len(trail) + 1)) AS rank FROM t WHERE k = (SELECT max(k) FROM t))""")
def diverse_select(spark, t):
    nodes = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.abs(F.element_at("embedding", 1)).cast("double").alias("quality"))

    def measure(pick):
        seq = (F.col("label") != F.lit(pick["label"])).cast("double")
        geo = F.least(F.lit(1.0), similarity.vector_distance(F.col("v"), F.array(*[F.lit(x) for x in pick["v"]])) / 2.0)
        return seq, geo

    picks = select.select_diverse(nodes, 12, "vec_id", "quality", measure, (0.5, 0.3, 0.2))
    return select.assign_roles(picks, 10).select("selection_rank", "vec_id", "role", *[F.round(c, 6).alias(c) for c in ("quality", "utility", "min_sequence_distance", "min_geometry_distance")])


def _urls(t):
    """Addresses without their scheme, one page per distinct address."""
    bare = t.pages.select("page_id", F.regexp_replace("url", "^https?://(m[.]|www[.]|blog[.])?", "").alias("address"))
    return ranking.best_per_key(bare, ["address"], ["page_id"])


_ADDRESSES = """
u AS (SELECT min(page_id) AS id, address FROM (SELECT page_id, regexp_replace(url, '^https?://(m[.]|www[.]|blog[.])?', '') AS address FROM pages) GROUP BY address),
p AS (SELECT x.id AS id_a, y.id AS id_b, x.address AS a, y.address AS b FROM u x JOIN u y ON x.id < y.id AND levenshtein(x.address, y.address) <= {budget})"""


# Row by row: a letter pair takes one more than the cell before both, then the largest so far is carried on.
@query("lcs_pairs", f"""
WITH RECURSIVE {_ADDRESSES.format(budget="length(x.address) + length(y.address) - 2 * 0.92 * greatest(length(x.address), length(y.address)) + 1e-9")},
t(id_a, id_b, a, b, i, row) AS (
  SELECT id_a, id_b, a, b, 0, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) FROM p
  UNION ALL
  SELECT id_a, id_b, a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(cells[1:j])) FROM (
    SELECT id_a, id_b, a, b, i, list_transform(range(1, length(b) + 2), lambda j: CASE WHEN j > 1 AND a[i + 1] = b[j - 1] THEN row[j - 1] + 1 ELSE row[j] END) AS cells FROM t WHERE i < length(a)))
SELECT id_a, id_b, round(row[-1] / greatest(length(a), length(b)), 6) AS similarity FROM t WHERE i = length(a) AND row[-1] / greatest(length(a), length(b)) >= 0.92 - 1e-12""")
def lcs_pairs(spark, t):
    return similarity.lcs_pairs(_urls(t), "page_id", "address", 0.92).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def _align_sql() -> str:
    """Cell by cell. A state is score, matches and length in one number; a better score replaces it."""
    unit, none = 1_000_000, 50_000 * 1_000_000
    better = lambda x, y: f"(CASE WHEN {y} // {unit} > {x} // {unit} THEN {y} ELSE {x} END)"
    best = lambda c: better(better(f"{c}[1]", f"{c}[2]"), f"{c}[3]")
    begun, more = similarity.GAP_OPEN * unit + 1, similarity.GAP_EXTEND * unit + 1
    start = lambda k: f"({100_000 * unit} + {similarity.GAP_OPEN * unit} + ({k} - 1) * {similarity.GAP_EXTEND * unit} + {k})"
    gap = lambda c, steps: better(better(*[f"({c}[{k + 1}] + {steps[k]})" for k in (0, 1)]), f"({c}[3] + {steps[2]})")
    pair = f"({best('d')} + CASE WHEN same THEN {similarity.MATCH * unit} + 1001 ELSE {similarity.MISMATCH * unit} + 1 END)"
    return f"""
WITH RECURSIVE {_ADDRESSES.format(budget="least(length(x.address), length(y.address)) * (0.12 / 0.88) + 1e-9")},
t(id_a, id_b, a, b, i, j, above, row) AS (
  SELECT id_a, id_b, a, b, 1, 0, list_transform(range(length(b) + 1), lambda k: CASE WHEN k = 0 THEN [{100_000 * unit}, {none}, {none}] ELSE [{none}, {none}, {start('k')}] END), CAST([] AS BIGINT[][]) FROM p
  UNION ALL
  SELECT id_a, id_b, a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 0 ELSE j + 1 END, CASE WHEN j = length(b) THEN list_append(row, cell) ELSE above END, CASE WHEN j = length(b) THEN [] ELSE list_append(row, cell) END FROM (
    SELECT *, CASE WHEN j = 0 THEN [{none}, {start('i')}, {none}] ELSE [{pair}, {gap('u', (begun, more, begun))}, {gap('l', (begun, begun, more))}] END AS cell FROM (
      SELECT *, above[j] AS d, above[j + 1] AS u, row[j] AS l, a[i] = b[j] AS same FROM t WHERE i <= length(a)))),
e AS (SELECT id_a, id_b, {best('above[-1]')} AS v FROM t WHERE i = length(a) + 1)
SELECT id_a, id_b, round((v // 1000 % 1000) / (v % 1000), 6) AS identity FROM e WHERE (v // 1000 % 1000) / (v % 1000) >= 0.88 - 1e-12"""


@query("align_identity", _align_sql())
def align_identity(spark, t):
    return similarity.align_pairs(_urls(t), "page_id", "address", 0.88).select("id_a", "id_b", F.round("identity", 6).alias("identity"))


@query("collapse_copies", """
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS representative FROM documents) SELECT doc_id, representative FROM d""")
def collapse_copies(spark, t):
    return similarity.collapse_copies(t.documents.select("doc_id", "lang", "text"), "doc_id", [F.col("lang"), F.col("text")])[1]


@query("closure", """
WITH RECURSIVE e AS (SELECT o_orderkey // 12 AS parent, o_orderkey AS child FROM orders WHERE o_orderkey > 0 AND o_totalprice > 40000),
c(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT child, depth + 1 FROM c JOIN e ON e.parent = c.node)
SELECT node, depth FROM c""")
def closure(spark, t):
    e = t.orders.filter("o_orderkey > 0 AND o_totalprice > 40000").select(F.floor(F.col("o_orderkey") / 12).cast("long").alias("parent"), F.col("o_orderkey").alias("child"))
    root = t.orders.filter("o_orderkey = 0").select(F.col("o_orderkey").alias("node"))
    return cluster.closure(e, root, "parent", "child")


@query("chain_roots", """
WITH RECURSIVE e AS (SELECT event_id AS node, CASE WHEN event_type IN ('error', 'view', 'click') AND event_id > 0 THEN event_id - 1 END AS parent FROM events),
c AS (SELECT node, node AS root, 0 AS hops FROM e WHERE parent IS NULL UNION ALL SELECT e.node, c.root, c.hops + 1 FROM e JOIN c ON e.parent = c.node)
SELECT node, root, hops::BIGINT AS hops FROM c""")
def chain_roots(spark, t):
    up = F.when(F.col("event_type").isin("error", "view", "click") & (F.col("event_id") > 0), F.col("event_id") - 1)
    return cluster.chain_roots(t.events.select(F.col("event_id").alias("n"), up.alias("p")), "n", "p")
