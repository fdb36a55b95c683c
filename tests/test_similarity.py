"""Similarity searches, clustering and selection against brute force."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline import session
from siftline.operators import cluster, joins, select, similarity


def kabsch(a, b):
    p, q = a - a.mean(0), b - b.mean(0)
    u, _, vt = np.linalg.svd(p.T @ q)
    if np.linalg.det(u @ vt) < 0:
        vt[-1] *= -1
    return p @ u @ vt - q


@pytest.fixture(scope="module")
def shapes(spark):
    """Structures of 4 anchors and up to 3 further points, some of them turned copies."""
    rng = np.random.default_rng(3)
    base = [rng.normal(size=(7, 3)) for _ in range(6)]
    data, table = [], {}
    for i in range(40):
        pts = base[i % 6] + rng.normal(scale=0.05 * (i // 6), size=(7, 3))
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        if np.linalg.det(turn) < 0:
            turn[:, 0] *= -1
        pts = pts @ turn + rng.normal(size=3) * 10
        keep = [0, 1, 2, 3] + [k for k in (4, 5, 6) if rng.random() < 0.7]
        if i == 39:
            keep = [0, 1, 2, 5]  # an anchor is missing
        letters = {k: "ACDE"[rng.integers(4)] for k in keep}
        table[i] = (keep, letters, pts)
        data += [(i, int(k) + 1, letters[k], *map(float, pts[k])) for k in keep]
    return spark.createDataFrame(data, "sid int, pos int, l string, x double, y double, z double").cache(), table


def expected(table, i, j, min_common=4):
    (ka, la, pa), (kb, lb, pb) = table[i], table[j]
    common = sorted(set(ka) & set(kb))
    if len(common) < min_common:
        return 0.0, math.inf, math.inf, len(common)
    identity = sum(la[k] == lb[k] for k in common) / len(set(ka) | set(kb))
    err = (kabsch(pa[common], pb[common]) ** 2).sum(1)
    anchors = [n for n, k in enumerate(common) if k < 4]
    anchor = math.sqrt(err[anchors].mean()) if len(anchors) == 4 else math.inf
    return identity, math.sqrt(err.mean()), anchor, len(common)


def test_superposition_matches_brute_force(spark, shapes):
    df, table = shapes
    pairs = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "id_a int, id_b int")
    prof = similarity.point_profiles(df, "sid", "pos", "l", F.col("pos") <= 4)
    for r in similarity.superpose_pairs(pairs, prof, "sid", 4, 4).collect():
        want = expected(table, r["id_a"], r["id_b"])
        for got, w in zip((r["identity"], r["rmsd"], r["anchor_rmsd"], r["common_positions"]), want):
            assert got == w or abs(got - w) < 1e-9


def test_candidates_lose_no_pair(spark, shapes):
    df, table = shapes
    for limit in (0.2, 0.5):
        got = {tuple(r) for r in similarity.shape_candidates(df.filter("pos <= 4"), "sid", "pos", 4, limit).collect()}
        want = {(i, j) for i, j in itertools.combinations(range(40), 2) if expected(table, i, j)[2] < limit}
        assert want <= got and len(got) < 40 * 39 / 2 and want


def test_signature_equals_singular_values(spark, shapes):
    df, table = shapes
    for r in similarity.shape_signature(df, "sid").collect():
        keep, _, pts = table[r["sid"]]
        p = pts[keep] - pts[keep].mean(0)
        assert np.allclose([r["s1"], r["s2"], r["s3"]], np.linalg.svd(p, compute_uv=False) / math.sqrt(len(keep)), atol=1e-6)


def test_degenerate_shapes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)] * 3 + [(2, float(i), 0.0, 0.0) for i in range(3)], "sid int, x double, y double, z double")
    got = {r["sid"]: (r["s1"], r["s2"], r["s3"]) for r in similarity.shape_signature(df, "sid").collect()}
    assert got[1] == (0, 0, 0) and abs(got[2][0] - math.sqrt(2 / 3)) < 1e-9 and got[2][1] < 2e-4


def naive_complete_linkage(n, d, t):
    groups = [{i} for i in range(n)]
    while True:
        best = None
        for a, b in itertools.combinations(range(len(groups)), 2):
            dist = max(d[min(i, j), max(i, j)] for i in groups[a] for j in groups[b])
            if dist < t and (best is None or dist < best[0]):
                best = (dist, a, b)
        if best is None:
            return {frozenset(g) for g in groups}
        _, a, b = best
        groups[a] |= groups[b]
        del groups[b]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_match_naive_linkage(spark, seed):
    rnd = random.Random(seed)
    n = 24
    d = {(i, j): rnd.random() for i, j in itertools.combinations(range(n), 2)}
    edges = spark.createDataFrame([(i, j, v) for (i, j), v in d.items() if v < 0.6], "id_a long, id_b long, distance double")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    members = cluster.threshold_clusters(edges, nodes, "node", 0.6).collect()
    got = {}
    for r in members:
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(g) for g in got.values()} == naive_complete_linkage(n, d, 0.6)
    assert all(k == min(g) for k, g in got.items())


def test_cluster_threshold_is_strict(spark, rows):
    edges = spark.createDataFrame([(1, 2, 1.0)], "id_a long, id_b long, distance double")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert rows(cluster.threshold_clusters(edges, nodes, "node", 1.0)) == [(1, 1), (2, 2)]
    assert rows(cluster.threshold_clusters(edges, nodes, "node", 1.01)) == [(1, 1), (2, 1)]


def test_representatives(spark, rows):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id int, cluster int")
    nodes = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.1)], "id int, q double")
    metrics = spark.createDataFrame([(1, 2, 0.25)], "id_a int, id_b int, rmsd double")
    out = cluster.representatives(members, nodes, "id", "cluster", [F.col("q").desc(), "id"], metrics=metrics)
    assert rows(out, "id", "representative", "cluster_size", "rmsd") == [(1, 2, 2, 0.25), (2, 2, 2, None), (3, 3, 1, None)]
    pinned = cluster.representatives(members, nodes, "id", "cluster", [F.col("q").desc(), "id"], F.col("id") == 1)
    assert rows(pinned.filter("is_representative"), "id", "reason") == [(1, "pinned"), (3, "quality_order")]


def test_closure_and_chains(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "p int, c int")
    assert rows(cluster.closure(edges, spark.createDataFrame([(1,)], "node int"), "p", "c")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(37)] + [(100, 101), (101, 100), (200, 999)], "n int, p int")
    got = {r["node"]: (r["root"], r["hops"]) for r in cluster.chain_roots(links, "n", "p").collect()}
    assert all(got[i] == (0, i) for i in range(37))
    assert got[100] == (None, None) and got[200] == (200, 0)


def test_closure_of_deep_and_tangled_graphs(spark, rows):
    deep = spark.range(10000).select(F.col("id").alias("p"), (F.col("id") + 1).alias("c"))
    got = cluster.closure(deep, spark.createDataFrame([(0,)], "node long"), "p", "c")
    assert got.filter("depth = node").count() == 10001 == got.count()
    rng = random.Random(12)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(75)] + [(i, i + 1) for i in range(100, 140)] + [(5, 100), (140, 7), (None, 3), (3, None), (2, 2)]
    roots = [0, 5, 77, 5]
    depth = {r: 0 for r in roots}
    todo = list(depth)
    while todo:
        x = todo.pop(0)
        for p, c in edges:
            if p == x and c is not None and c not in depth:
                depth[c] = depth[x] + 1
                todo.append(c)
    got = cluster.closure(spark.createDataFrame(edges, "p int, c int"), spark.createDataFrame([(r,) for r in roots], "node int"), "p", "c")
    assert rows(got) == sorted(depth.items(), key=str)
    assert rows(cluster.closure(spark.createDataFrame([], "p int, c int"), spark.createDataFrame([(4,)], "node int"), "p", "c")) == [(4, 0)]


def test_selection_scans_less_than_it_picks(spark, monkeypatch):
    rng = random.Random(3)
    data = [(i, rng.random(), rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(data, "id int, q double, x double, y double")

    def measure(p):
        return F.abs(F.col("x") - F.lit(p["x"])), F.abs(F.col("y") - F.lit(p["y"]))

    scans, plain = [], select._scan
    monkeypatch.setattr(select, "_scan", lambda *a: scans.append(1) or plain(*a))
    got = [(r["id"], round(r["utility"] or 0, 12)) for r in select.select_diverse(df, 8, "id", "q", measure, (0.6, 0.2, 0.2), shortlist=64).orderBy("selection_rank").collect()]
    picks, want = [max(data, key=lambda r: (r[1], r[0]))], []
    want.append((picks[0][0], 0))
    while len(picks) < 8:
        worth = lambda r: 0.6 * r[1] + 0.2 * min(abs(r[2] - p[2]) for p in picks) + 0.2 * min(abs(r[3] - p[3]) for p in picks)
        best = max((r for r in data if r not in picks), key=lambda r: (worth(r), r[1], r[0]))
        want.append((best[0], round(worth(best), 12)))
        picks.append(best)
    assert got == want and 0 < len(scans) < 7


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def gotoh(a, b):
    """Plain reference for the alignment identity, with the stated tie order."""
    low = -10**9
    m, x, y = {}, {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            def best(*cells):
                top = cells[0]
                for c in cells[1:]:
                    if c[0] > top[0]:
                        top = c
                return top

            none = (low, 0, 0)
            if i and j:
                p = best(m[i - 1, j - 1], x[i - 1, j - 1], y[i - 1, j - 1])
                same = a[i - 1] == b[j - 1]
                m[i, j] = (p[0] + (10 if same else 0), p[1] + same, p[2] + 1)
            else:
                m[i, j] = (0, 0, 0) if i == j == 0 else none
            up = lambda c, s: (c[0] + s, c[1], c[2] + 1)
            x[i, j] = best(up(m[i - 1, j], -10), up(x[i - 1, j], -1), up(y[i - 1, j], -10)) if i else none
            y[i, j] = best(up(m[i, j - 1], -10), up(x[i, j - 1], -10), up(y[i, j - 1], -1)) if j else none
            if j == 0 and i:
                m[i, j] = none
            if i == 0 and j:
                m[i, j] = none
    end = best(m[len(a), len(b)], x[len(a), len(b)], y[len(a), len(b)])
    return end[1] / end[2] if end[2] else 1.0


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(11)
    out = {"".join(rnd.choice("ABCD") for _ in range(rnd.randrange(1, 30))) for _ in range(25)}
    for s in sorted(out):
        for _ in range(2):
            t = list(s)
            for _ in range(rnd.randrange(1, 4)):
                k = rnd.randrange(len(t) + 1)
                if rnd.random() < 0.5:
                    t.insert(k, rnd.choice("ABCD"))
                elif len(t) > 1 and k < len(t):
                    del t[k]
            out.add("".join(t))
    data = list(enumerate(sorted(out)))
    return spark.createDataFrame(data, "id int, s string").cache(), dict(data)


@pytest.mark.parametrize("threshold", [0.9, 0.75])
def test_lcs_pairs_brute_force(texts, threshold):
    df, table = texts
    want = {(i, j) for i, j in itertools.combinations(table, 2) if lcs(table[i], table[j]) / max(len(table[i]), len(table[j])) >= threshold - 1e-12}
    got = similarity.lcs_pairs(df, "id", "s", threshold).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want and len(got) == len(want) > 5
    for r in got:
        a, b = table[r["id_a"]], table[r["id_b"]]
        assert abs(r["similarity"] - lcs(a, b) / max(len(a), len(b))) < 1e-12


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_align_pairs_brute_force(texts, threshold):
    df, table = texts
    value = {(i, j): gotoh(table[i], table[j]) for i, j in itertools.combinations(table, 2)}
    want = {k for k, v in value.items() if v >= threshold - 1e-12}
    got = similarity.align_pairs(df, "id", "s", threshold).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want and len(want) > 5
    assert all(abs(r["identity"] - value[r["id_a"], r["id_b"]]) < 1e-12 for r in got)


def test_known_alignments(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "ACT"), ("", ""), ("A", ""), ("AAAA", "TTTT")], "a string, b string")
    got = [r["v"] for r in df.select(similarity.alignment_identity("a", "b").alias("v")).collect()]
    assert got == [1.0, 0.75, 1.0, 0.0, 0.0]
    sims = [r["similarity"] for r in similarity.lcs_similarity(df.toDF("text_a", "text_b")).collect()]
    assert sims == [1.0, 0.75, 1.0, 0.0, 0.0]


def test_low_threshold_is_refused(texts):
    with pytest.raises(ValueError):
        similarity.lcs_pairs(texts[0], "id", "s", 0.5)


def test_copies(spark, rows):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id int, s string")
    kept, mapped = similarity.collapse_copies(df, "id", [F.col("s")])
    assert rows(kept) == [(1, "x"), (2, "y")] and rows(mapped) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("limit", [2, 20_000])
def test_range_pairs_brute_force(spark, limit):
    rnd = random.Random(5)
    pts = [(i, *(rnd.choice([0.0, 0.1, 0.5, 1.0]) + rnd.random() * 0.05 for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(pts, "i int, x double, y double, z double")
    got = joins.range_pairs(df, df, [], ["x", "y", "z"], 0.2, ["i"], ["i"], limit).select("i_a", "i_b").collect()
    want = {(a[0], b[0]) for a in pts for b in pts if math.dist(a[1:], b[1:]) <= 0.2}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_selection_matches_greedy_loop(spark):
    rnd = random.Random(2)
    nodes = [(f"n{i:02d}", rnd.choice([0.2, 0.5, 0.8]), [rnd.random() for _ in range(3)], rnd.choice("AB")) for i in range(20)]
    df = spark.createDataFrame(nodes, "id string, q double, v array<double>, g string")

    def measure(pick):
        geo = F.least(F.lit(1.0), similarity.vector_distance(F.col("v"), F.array(*[F.lit(x) for x in pick["v"]])) / 2.0)
        return (F.col("g") != pick["g"]).cast("double"), geo

    got = [(r["id"], r["utility"]) for r in select.select_diverse(df, 6, "id", "q", measure, (0.5, 0.3, 0.2), shortlist=3).orderBy("selection_rank").collect()]
    chosen = [max(nodes, key=lambda n: (n[1], n[0]))]
    scores = [None]
    while len(chosen) < 6:
        best = None
        for n in nodes:
            if n in chosen:
                continue
            seq = min(float(n[3] != c[3]) for c in chosen)
            geo = min(min(1.0, math.dist(n[2], c[2]) / 2) for c in chosen)
            key = (0.5 * n[1] + 0.3 * seq + 0.2 * geo, n[1], n[0])
            if best is None or key > best[0]:
                best = (key, n)
        chosen.append(best[1])
        scores.append(best[0][0])
    assert [g[0] for g in got] == [c[0] for c in chosen]
    assert all(a[1] is b or abs(a[1] - b) < 1e-9 for a, b in zip(got, scores))
    roles = [r["role"] for r in select.assign_roles(select.select_diverse(df, 3, "id", "q", measure, (1.0, 0.0, 0.0)), 2).orderBy("selection_rank").collect()]
    assert roles == ["primary", "primary", "reserve"]


def test_sentinel(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.2), (0.5, float("inf"), 0.1), (0.5, 0.1, None)], "i double, r double, a double")
    got = [r["d"] for r in df.select(similarity.combined_distance("i", "r", "a", (0.5, 1.0, 1.0)).alias("d")).collect()]
    assert got == [0.5, 999.0, 999.0]


@pytest.mark.parametrize("size", [7, 1024])
def test_near_shapes_in_blocks(spark, shapes, monkeypatch, size):
    """Every near pair once, with its scores, however the structures fall into blocks."""
    df, table = shapes
    monkeypatch.setattr(similarity, "SHAPE_BLOCK", size)
    prof = similarity.point_profiles(df, "sid", "pos", "l", F.col("pos") <= 4)
    ids = [i for i in table if all(k in table[i][0] for k in range(4))]
    pairs = spark.createDataFrame(list(itertools.combinations(ids, 2)), "id_a int, id_b int")
    every = {(r["id_a"], r["id_b"]): tuple(r)[2:] for r in similarity.superpose_pairs(pairs, prof, "sid", 4, 4).collect()}
    for limit in (0.05, 0.2, 1.0):
        rows = similarity.near_shapes(prof, "sid", 4, 4, limit).collect()
        got = {(r["id_a"], r["id_b"]): tuple(r)[2:] for r in rows}
        assert len(got) == len(rows)
        want = {k: v for k, v in every.items() if v[2] < limit}
        assert want and want.keys() == {k for k, v in got.items() if v[2] < limit}
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_loop_state_keeps_its_size(spark):
    """Joins of a loop's state with itself must not multiply its estimated size round by round."""
    from siftline.session import cut

    state = cut(spark.range(100).withColumn("next", F.col("id")))
    for _ in range(6):
        state = cut(state.join(state.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")))
    assert state.count() == 100
    assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40


@pytest.mark.parametrize("size", [9, 2048])
def test_common_pairs_in_blocks(spark, monkeypatch, size):
    """Texts that share most letters but few in order are refused; every pair that reaches the threshold is there once."""
    rng = random.Random(11)
    texts = {i: "".join(rng.choice("abé\U0001f600") for _ in range(rng.choice((3, 8, 70, 300)))) for i in range(25)}
    texts |= {25 + i: t[: len(t) // 2] + "z" + t[len(t) // 2 + 1 :] for i, t in texts.items()}
    texts |= {60: "", 61: None}
    monkeypatch.setattr(similarity, "TEXT_BLOCK", size)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j: row[j] + 1 if x == b[j] else max(left, row[j + 1]), initial=0))
        return row[-1]

    rows = similarity.common_pairs(df, "id", "t", 0.85).collect()
    got = {(r["id_a"], r["id_b"]): (r["text_a"], r["text_b"], r["common"]) for r in rows}
    real = {i: t for i, t in texts.items() if t}
    want = {(i, j): (a, b, n) for (i, a), (j, b) in itertools.combinations(sorted(real.items()), 2) if (n := common(a, b)) >= 0.85 * max(len(a), len(b)) - 1e-9}
    assert len(rows) == len(got) and got == want and len(want) > 15


def test_rows_travel_a_bounded_number_of_times(spark):
    """However many blocks a table would fill, a row goes to so many tasks at most, and every two rows meet once."""
    n = 200

    def meet(a, b):
        alone = len(a) and len(b) and a["i"][0].as_py() == a["j"][0].as_py()
        pairs = [(x, y) for x in a["id"].to_pylist() for y in b["id"].to_pylist() if (x < y if alone else x != y)]
        return pa.table({"x": [min(p) for p in pairs], "y": [max(p) for p in pairs], "sent": [len(a) + len(b)] * len(pairs)}, pa.schema([("x", pa.int64()), ("y", pa.int64()), ("sent", pa.int64())]))

    met = similarity.block_pairs(spark.range(n), "id", F.lit(1), meet, "x long, y long, sent long", 1).collect()
    assert len(met) == n * (n - 1) // 2 == len({(r["x"], r["y"]) for r in met})
    assert max(r["sent"] for r in met) < n
    plan = similarity.block_pairs(spark.range(n), "id", F.lit(1), lambda a, b: pa.table({"n": [len(a) + len(b)]}), "n long", 1)
    assert n < plan.agg(F.sum("n")).first()[0] <= n * (similarity.BLOCKS + 1)


def test_near_shapes_far_out_and_broken(spark):
    """Shapes far from the origin lose no pair in single precision; one with a missing shared coordinate is in none."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 3))
    data, pts = [], {}
    for i in range(60):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn[:, 0] *= np.sign(np.linalg.det(turn))
        pts[i] = (base + rng.normal(scale=0.04, size=(6, 3))) @ turn + rng.normal(size=3) * 1e4
        data += [(i, k + 1, "A", *map(float, pts[i][k])) for k in range(6)]
    data += [(70, k + 1, "A", *(float(v) if k < 5 else None for v in pts[0][k])) for k in range(6)]
    df = spark.createDataFrame(data, "sid int, pos int, l string, x double, y double, z double")
    prof = similarity.point_profiles(df, "sid", "pos", "l", F.col("pos") <= 4)
    got = {(r["id_a"], r["id_b"]): r["anchor_rmsd"] for r in similarity.near_shapes(prof, "sid", 4, 4, 0.06).collect()}
    value = {(i, j): math.sqrt((kabsch(pts[i], pts[j])[:4] ** 2).sum(1).mean()) for i, j in itertools.combinations(pts, 2)}
    want = {k for k, v in value.items() if v < 0.06}
    assert 5 < len(want) < 1700 and want == {k for k, v in got.items() if v < 0.06} and all(abs(got[k] - value[k]) < 1e-6 for k in want)


def test_alignments_of_odd_lengths():
    """Closed forms and narrow bands give the identity of the whole table, with and without a least identity that matters."""
    rnd = random.Random(8)
    one = ["".join(rnd.choice("ab1") for _ in range(rnd.choice((0, 1, 5, 12, 30, 70)))) for _ in range(150)]
    two = []
    for s in one:
        t = list(s)
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.choice((0, 0, 1, 2))] = rnd.choice(("", "a", "1b"))
        two.append("".join(t))
    a, b, at = similarity._Letters(one), similarity._Letters(two), np.arange(len(one))
    common = similarity._lcs_lengths(one, two)
    assert common.tolist() == [lcs(s, t) for s, t in zip(one, two)]
    want = np.array([gotoh(s, t) for s, t in zip(one, two)])
    assert np.allclose(similarity._align(a, b, at, at, common), want, atol=1e-12)
    some = similarity._align(a, b, at, at, common, 0.8)
    assert np.array_equal(some >= 0.8, want >= 0.8) and np.allclose(some[want >= 0.8], want[want >= 0.8], atol=1e-12)


def test_clustering_keeps_two_states(spark, tmp_path, monkeypatch):
    """A chain of links merges over several rounds; of each state two are left on disk, not one a round."""
    n = 64
    d = {(i, j): abs(i - j) + min(i, j) / 1000 for i, j in itertools.combinations(range(n), 2)}
    edges = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "id_a long, id_b long, distance double")
    tags = itertools.count()
    monkeypatch.setattr(session, "scratch_path", lambda spark, tag: f"{tmp_path}/{tag}-{next(tags)}")
    members = cluster.threshold_clusters(edges, spark.range(n).withColumnRenamed("id", "node"), "node", 20.0).collect()
    got = {}
    for r in members:
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(g) for g in got.values()} == naive_complete_linkage(n, d, 20.0)
    written = list(tmp_path.rglob("_SUCCESS"))
    assert 3 <= len(written) <= 6


def test_representatives_compare_only_their_members(spark, rows):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id int, cluster int")
    nodes = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.1)], "id int, q double")
    asked = []

    def metrics(pairs):
        asked.extend(rows(pairs))
        return pairs.withColumn("rmsd", F.lit(0.25))

    out = cluster.representatives(members, nodes, "id", "cluster", [F.col("q").desc(), "id"], metrics=metrics)
    assert rows(out, "id", "representative", "cluster_size", "rmsd") == [(1, 2, 2, 0.25), (2, 2, 2, None), (3, 3, 1, None)] and asked == [(1, 2)]
