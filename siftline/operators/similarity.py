"""Pair similarity: exact candidate search, superposition, sequence alignment, common subsequence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StringType

from siftline.functions.clean import let
from siftline.operators.joins import range_pairs
from siftline.session import stage_table


def collapse_copies(df: DataFrame, id_col: str, content: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """One row per distinct content (smallest id), and the id → representative map.

    Copies are at distance 0 of each other, so pairs are only searched among representatives.
    """
    key = F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in content]), 256)
    hashed = df.withColumn("_key", key)
    firsts = hashed.groupBy("_key").agg(F.min(id_col).alias("representative"))
    mapped = hashed.select(id_col, "_key").join(firsts, "_key").select(id_col, "representative")
    return df.join(firsts.select(F.col("representative").alias(id_col)), id_col, "left_semi"), mapped


# ---- superposition of numbered points ----


def point_profiles(coords: DataFrame, id_col: str, position: str, letter: str, anchor: Column) -> DataFrame:
    """One row per structure with its points as aligned arrays in position order (G1).

    A structure holds as many points as there are positions, which the numbering bounds.
    """
    point = F.struct(F.col(position).cast("string").alias("p"), F.col(letter).alias("l"), "x", "y", "z", anchor.alias("k"))
    rows = coords.groupBy(id_col).agg(F.array_sort(F.collect_list(point)).alias("_pts"))
    pick = lambda f: F.transform("_pts", lambda q: q[f])
    return rows.select(
        id_col, pick("p").alias("pos"), pick("l").alias("let"), pick("x").alias("xs"), pick("y").alias("ys"), pick("z").alias("zs"), pick("k").alias("anc")
    )


def shape_signature(coords: DataFrame, id_col: str) -> DataFrame:
    """Scaled singular values s1 >= s2 >= s3 of the centred points of each structure.

    They ignore rotation and shift, and by von Neumann's trace inequality their distance never
    exceeds the RMSD of any superposition of equally many points.
    """
    n = F.count(F.lit(1))
    m = {}
    for i, a in enumerate("xyz"):
        for b in "xyz"[i:]:
            m[a + b] = F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)
    sums = coords.groupBy(id_col).agg(n.alias("points"), *[v.alias(k) for k, v in m.items()])
    # Eigenvalues of the symmetric 3x3 covariance in closed form. Each step is bound once by
    # ``let``; as plain columns the steps would be inlined into each other many times over.
    def eigen(m: Column) -> Column:
        q = (m["xx"] + m["yy"] + m["zz"]) / 3.0
        off = m["xy"] ** 2 + m["xz"] ** 2 + m["yz"] ** 2
        return let(F.struct(q.alias("q"), off.alias("off")), lambda c: scaled(m, c))

    def scaled(m: Column, c: Column) -> Column:
        q = c["q"]
        spread = (m["xx"] - q) ** 2 + (m["yy"] - q) ** 2 + (m["zz"] - q) ** 2 + 2.0 * c["off"]
        return let(F.sqrt(F.greatest(spread, F.lit(0.0)) / 6.0), lambda p: turned(m, q, p))

    def turned(m: Column, q: Column, p: Column) -> Column:
        x, y, z = m["xx"] - q, m["yy"] - q, m["zz"] - q
        det = (
            x * (y * z - m["yz"] ** 2) - m["xy"] * (m["xy"] * z - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - y * m["xz"])
        )
        half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2.0 * p * p * p)))
        return let(F.when(p > 0, F.acos(half) / 3.0).otherwise(0.0), lambda t: roots(q, p, t))

    def roots(q: Column, p: Column, t: Column) -> Column:
        e1 = q + 2.0 * p * F.cos(t)
        e3 = q + 2.0 * p * F.cos(t + 2.0 * math.pi / 3.0)
        return F.array(*[F.sqrt(F.greatest(e, F.lit(0.0))) for e in (e1, 3.0 * q - e1 - e3, e3)])

    values = let(F.struct(*m), eigen)
    return sums.select(id_col, "points", values.alias("s")).select(
        id_col, "points", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(3)]
    )


def shape_candidates(anchors: DataFrame, id_col: str, position: str, required: int, max_rmsd: float) -> DataFrame:
    """Pairs (id_a < id_b) whose anchor RMSD may lie below ``max_rmsd``; none that does is lost.

    Two exact lower bounds: the signatures find near pairs through a grid join, then the distances
    between the anchors must agree, as sqrt(sum of squared differences) / anchors <= RMSD.
    Structures without all anchors are at the sentinel distance from every other and have no pairs.
    """
    sig = shape_signature(anchors, id_col).filter(F.col("points") == required)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).cast("string").alias("p"), "x", "y", "z")))
    points = anchors.groupBy(id_col).agg(ordered.alias("_p")).filter(F.size("_p") == required)
    names, gaps = [], []
    for i in range(required):
        for j in range(i + 1, required):
            names.append(f"g{i}_{j}")
            gaps.append(F.sqrt(sum(((F.col("_p")[i][c] - F.col("_p")[j][c]) ** 2 for c in "xyz"), F.lit(0.0))).alias(names[-1]))
    # A few numbers per structure, read four times below: written once.
    sig = stage_table(sig.join(points.select(id_col, *gaps), id_col), "signatures")
    # The closed form is off by up to 2e-4 of the largest value where eigenvalues meet.
    scale = sig.agg(F.max("s1")).first()[0] or 0.0
    near = range_pairs(sig, sig, [], ["s1", "s2", "s3"], max_rmsd + 5e-4 * scale + 1e-12, [id_col, *names], [id_col, *names])
    spread = sum(((F.col(f"{g}_a") - F.col(f"{g}_b")) ** 2 for g in names), F.lit(0.0))
    limit = (required * max_rmsd) ** 2 * (1 + 1e-9) + 1e-18
    return near.filter((F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & (spread <= limit)).select(
        F.col(f"{id_col}_a").alias("id_a"), F.col(f"{id_col}_b").alias("id_b")
    )


SUPERPOSE_RESULT = "identity double, rmsd double, anchor_rmsd double, common_positions int"


def _points(batch: pd.DataFrame, side: str) -> pd.DataFrame:
    sizes = batch[f"pos_{side}"].map(len).to_numpy()
    flat = {c: np.concatenate(batch[f"{c}_{side}"].to_numpy()) for c in ("pos", "let", "xs", "ys", "zs", "anc")}
    return pd.DataFrame({"pair": np.repeat(np.arange(len(batch)), sizes), **flat})


def _sums(pair: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Per-pair sums of rows of ``values``."""
    return np.stack([np.bincount(pair, weights=v, minlength=n) for v in values.reshape(len(values), -1).T], axis=1)


def _superpose(batch: pd.DataFrame, min_common: int, required: int) -> pd.DataFrame:
    """All pairs of one Arrow batch at once: shared positions, moments, one stacked SVD."""
    n = len(batch)
    if n == 0:
        return pd.DataFrame({"identity": [], "rmsd": [], "anchor_rmsd": [], "common_positions": []})
    a, b = _points(batch, "a"), _points(batch, "b")
    both = a.merge(b, on=["pair", "pos"], suffixes=("_a", "_b"))
    pair = both["pair"].to_numpy()
    common = np.bincount(pair, minlength=n)
    union = np.bincount(a["pair"], minlength=n) + np.bincount(b["pair"], minlength=n) - common
    identity = np.bincount(pair, weights=(both["let_a"] == both["let_b"]).astype(float), minlength=n) / np.maximum(union, 1)
    p = both[["xs_a", "ys_a", "zs_a"]].to_numpy(float)
    q = both[["xs_b", "ys_b", "zs_b"]].to_numpy(float)
    weight = np.maximum(common, 1)[:, None]
    p = p - (_sums(pair, p, n) / weight)[pair]
    q = q - (_sums(pair, q, n) / weight)[pair]
    cov = _sums(pair, p[:, :, None] * q[:, None, :], n).reshape(n, 3, 3)
    u, _, vt = np.linalg.svd(cov)
    flip = np.linalg.det(u @ vt) < 0
    vt[flip, 2, :] *= -1
    moved = np.einsum("ni,nij->nj", p, (u @ vt)[pair])  # points are rows, hence R = U Vt
    error = ((moved - q) ** 2).sum(axis=1)
    rmsd = np.sqrt(np.bincount(pair, weights=error, minlength=n) / weight[:, 0])
    held = both["anc_a"].to_numpy(bool) & both["anc_b"].to_numpy(bool)
    anchors = np.bincount(pair[held], minlength=n)
    anchor_rmsd = np.sqrt(np.bincount(pair[held], weights=error[held], minlength=n) / np.maximum(anchors, 1))
    few = common < min_common
    return pd.DataFrame({
        "identity": np.where(few, 0.0, identity), "rmsd": np.where(few, np.inf, rmsd),
        "anchor_rmsd": np.where(few | (anchors < required), np.inf, anchor_rmsd), "common_positions": common.astype("int32"),
    })


_PROFILE = ("pos", "let", "xs", "ys", "zs", "anc")


def superpose_column(required: int, min_common: int):
    """Arrow UDF over two point profiles; returns SUPERPOSE_RESULT (G1)."""

    @F.pandas_udf(SUPERPOSE_RESULT)
    def kernel(pa: pd.Series, la: pd.Series, xa: pd.Series, ya: pd.Series, za: pd.Series, ka: pd.Series,
               pb: pd.Series, lb: pd.Series, xb: pd.Series, yb: pd.Series, zb: pd.Series, kb: pd.Series) -> pd.DataFrame:
        names = [f"{c}_{s}" for s in "ab" for c in _PROFILE]
        return _superpose(pd.DataFrame(dict(zip(names, (pa, la, xa, ya, za, ka, pb, lb, xb, yb, zb, kb)))), min_common, required)

    return kernel


def superpose_pairs(pairs: DataFrame, profiles: DataFrame, id_col: str, required: int, min_common: int) -> DataFrame:
    """Identity over the union of positions, RMSD, anchor RMSD and shared positions per pair (G1)."""
    side = lambda s: profiles.select(F.col(id_col).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _PROFILE])
    both = pairs.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b")
    kernel = superpose_column(required, min_common)
    return both.select("id_a", "id_b", kernel(*[f"{c}_{s}" for s in "ab" for c in _PROFILE]).alias("m")).select("id_a", "id_b", "m.*")


BLOCKS = 24  # blocks of a large table
BLOCK_CELLS = 1 << 23  # letters or points of a block, 32 more a row


def block_pairs(rows: DataFrame, id_col: str, cells: Column, meet, schema: str, size: int) -> DataFrame:
    """``meet`` of every two blocks, Arrow tables with the numbers ``i`` <= ``j`` of the blocks.

    Every two rows meet in one task, a block also meets itself. A pair that ``meet`` refuses is never
    written anywhere. Rows travel once for each block: a table has blocks of ``size`` rows up to ``BLOCKS``
    of them, then their rows grow, so the shuffle grows with the table alone, until a block is full.
    """
    rows = stage_table(rows, "rows")
    count, held = rows.agg(F.count(F.lit(1)), F.sum(F.coalesce(cells.cast("long"), F.lit(0)) + 32)).first()
    blocks = max(1, min(BLOCKS, -(-count // size)), -(-(held or 0) // BLOCK_CELLS))
    own = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    left = rows.select("*", own.alias("i"), F.explode(F.sequence(own, F.lit(blocks - 1))).alias("j"))
    # Other names on the right: columns that both sides share by identity may be pruned from one of them.
    right = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns], F.explode(F.sequence(F.lit(0), own)).alias("_i"), own.alias("_j"))
    # Little data makes much work here, so the number of tasks follows the pairs of blocks, not the bytes.
    tasks = min(blocks * (blocks + 1) // 2, 1000)
    pairs = left.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(right.repartition(tasks, "_i", "_j").groupBy("_i", "_j"))
    return pairs.applyInArrow(lambda a, b: meet(a, b.rename_columns(a.column_names) if len(a) else b), schema)


def _roots_of_grams(points: np.ndarray) -> np.ndarray:
    """Entries of the square root of each structure's matrix of products of its centred points, whose distance is that of the roots."""
    n = points.shape[1]
    basis = np.linalg.qr(np.hstack((np.ones((n, 1)), np.eye(n)[:, 1:])))[0][:, 1:]  # orthogonal to a shift
    u, s, _ = np.linalg.svd(np.einsum("kj,nki->nji", basis, points), full_matrices=False)
    i, j = np.triu_indices(n - 1)
    return np.einsum("nik,nk,njk->nij", u, s, u)[:, i, j] * np.where(i == j, 1.0, math.sqrt(2))


def _may_be_near(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all pairs whose best RMSD of numbered points may lie below ``limit``, a strip of a at a time.

    |X| and |Y| are never further apart than sqrt(2) times X and Y (Araki, Yamagami), for turned points
    as well, which refuses most. The best RMSD follows from the largest eigenvalue of a matrix of the
    moments: it is below a number exactly if all pivots of their difference are positive. Both tests are
    in single precision, with a margin beyond its rounding.
    """
    n, high, wide = a.shape[1], 96, 1536
    p, q = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    scale = max(np.sqrt(max((p**2).sum(axis=(1, 2)).max(initial=0), (q**2).sum(axis=(1, 2)).max(initial=0))), 1e-300)
    p, q, limit = p / scale, q / scale, limit / scale
    size_p, size_q = ((side**2).sum(axis=(1, 2)).astype(np.float32) for side in (p, q))
    # Squared distance as one product; columns that fill the last tile are far from all.
    left = np.hstack((-2 * _roots_of_grams(p), size_p[:, None], np.ones((len(p), 1)))).astype(np.float32)
    right = np.hstack((_roots_of_grams(q), np.ones((len(q), 1)), size_q[:, None])).astype(np.float32).T
    right = np.hstack((right, np.repeat(np.eye(len(right), 1, 1 - len(right), dtype=np.float32) * 9, -len(q) % wide, axis=1)))
    p, q = (np.ascontiguousarray(side.reshape(len(side), -1).astype(np.float32).T) for side in (p, q))
    most, near = np.float32(2 * n * limit**2 + 1e-5), np.float32(n * limit**2 / 2)
    for low in range(0, len(left), high):
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, right.shape[1], wide):
            hit = np.flatnonzero(left[low : low + high] @ right[:, at : at + wide] <= most)
            i, j = hit // wide + low, hit % wide + at
            u, v = p.take(i, axis=1), q.take(j, axis=1)
            (s00, s01, s02), (s10, s11, s12), (s20, s21, s22) = [[np.einsum("kn,kn->n", u[e::3], v[f::3]) for f in range(3)] for e in range(3)]
            size = (size_p[i] + size_q[j]) / 2
            t = size - near - size * np.float32(1e-5)
            one, two = t - s00, t + s00
            add, less = s11 + s22, s11 - s22
            k00, k11, k22, k33 = one - add, one + add, two - less, two + less
            k01, k02, k03, k12, k13, k23 = s21 - s12, s02 - s20, s10 - s01, -s01 - s10, -s20 - s02, -s12 - s21
            with np.errstate(all="ignore"):
                f1, f2, f3 = k01 / k00, k02 / k00, k03 / k00
                k11, k12, k13, k22, k23, k33 = k11 - f1 * k01, k12 - f1 * k02, k13 - f1 * k03, k22 - f2 * k02, k23 - f2 * k03, k33 - f3 * k03
                f2, f3 = k12 / k11, k13 / k11
                k22, k23, k33 = k22 - f2 * k12, k23 - f2 * k13, k33 - f3 * k13
                k33 = k33 - k23 / k22 * k23
            pick = ~((k00 > 0) & (k11 > 0) & (k22 > 0) & (k33 > 0))
            x.append(i[pick])
            y.append(j[pick])
        yield np.concatenate(x), np.concatenate(y)


def _quartic(s: list) -> tuple:
    """Coefficients of the characteristic quartic of superpositions from the nine entries of their moments, their cofactors, determinant."""
    minors = [s[(i + 1) % 3][(j + 1) % 3] * s[(i + 2) % 3][(j + 2) % 3] - s[(i + 1) % 3][(j + 2) % 3] * s[(i + 2) % 3][(j + 1) % 3] for i in range(3) for j in range(3)]
    square = sum(s[i][j] * s[i][j] for i in range(3) for j in range(3))
    det = s[0][0] * minors[0] + s[0][1] * minors[1] + s[0][2] * minors[2]
    return -2 * square, -8 * det, square * square - 4 * sum(m * m for m in minors), minors, det


class _Shapes:
    """Structures of a block as dense arrays over the numbers of their points."""

    def __init__(self, table: pa.Table, id_col: str, names: tuple[pa.Array, pa.Array]):
        rows, (places, letters) = len(table), names
        self.ids = table.column(id_col).to_numpy()
        lists = {c: table.column(c).combine_chunks() for c in _PROFILE}
        row = np.repeat(np.arange(rows), lists["pos"].value_lengths().to_numpy(zero_copy_only=False))
        flat = {c: lists[c].flatten() for c in _PROFILE}
        place = pc.index_in(flat["pos"], places).to_numpy()
        self.held, self.anchor = np.zeros((2, len(places), rows), bool)
        self.held[place, row] = True
        self.anchor[place, row] = flat["anc"].fill_null(False).to_numpy(zero_copy_only=False)
        self.letter = np.full((len(places), rows), -1, np.int32)
        self.letter[place, row] = pc.index_in(flat["let"], letters).fill_null(-1).to_numpy()
        self.points = np.zeros((3, len(places), rows))
        for k, c in enumerate(("xs", "ys", "zs")):
            self.points[k, place, row] = flat[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        bad = ~np.isfinite(self.points).all(axis=0)
        self.points[:, bad] = 0.0
        self.whole = ~(self.anchor & bad).any(axis=0)
        self.marks = (self.held + 2 * self.anchor + 4 * (self.held & ~bad)).astype(np.uint8)
        # Centred, so that single precision serves; places without a point stay at zero.
        self.points -= self.points.sum(axis=1, keepdims=True) / np.maximum(self.held.sum(axis=0), 1)
        self.points *= self.held

    def anchors(self, required: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the structures with all anchors, and these."""
        whole = (self.anchor.sum(axis=0) == required) & self.whole
        rows, place = np.nonzero((self.anchor & whole).T)
        return np.flatnonzero(whole), self.points[:, place, rows].T.reshape(-1, required, 3)


def _names(left: pa.Table, right: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Numbers of the points in order, and letters, of both blocks."""
    every = lambda c: pc.unique(pa.concat_arrays([t.column(c).combine_chunks().flatten() for t in (left, right)]).drop_null())
    places = every("pos")
    return places.take(pc.sort_indices(places)), every("let")


def _moments(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple:
    """Points shared by both sides of each pair about their centres, and the nine entries of their moments."""
    many = np.maximum(both.sum(axis=0), 1).astype(a.dtype)
    p, q = ((side - np.einsum("ikn,kn->in", side, both)[:, None] / many) * both for side in (a, b))
    return p, q, [[np.einsum("kn,kn->n", p[i], q[j]) for j in range(3)] for i in range(3)]


def _may_fit(a: np.ndarray, b: np.ndarray, both: np.ndarray, held: np.ndarray, most: float) -> np.ndarray:
    """Pairs whose error at the anchors, all shared points superposed, may lie below ``most``, by single precision.

    The largest root comes by Newton steps from above, the rotation from it in closed form,
    ((k + |S|^2) S + root * cofactors - S S^T S) / (k * root - det) with k = (root^2 - |S|^2) / 2.
    Where roots come close or the steps have not ended a pair passes.
    """
    p, q, s = _moments(a, b, both.astype(np.float32))
    c2, c1, c0, minors, det = _quartic(s)
    size = (np.einsum("ikn,ikn->n", p, p) + np.einsum("ikn,ikn->n", q, q)) / 2
    root = np.minimum(size, np.sqrt(np.float32(-1.5) * c2))
    for _ in range(10):
        square = root * root
        slope = (4 * square + 2 * c2) * root + c1
        step = (((square + c2) * root + c1) * root + c0) / np.where(slope > 0, slope, np.float32(np.inf))
        root -= step
    apart = (np.abs(step) <= np.float32(1e-4) * root) & (slope > np.float32(0.05) * size * size * size)
    square = c2 / -2
    k = (root * root - square) / 2
    below = np.where(apart, k * root - det, np.float32(1))
    inner = [[s[i][0] * s[j][0] + s[i][1] * s[j][1] + s[i][2] * s[j][2] for j in range(3)] for i in range(3)]
    error = np.zeros_like(size)
    for j in range(3):
        turn = np.stack([((k + square) * s[i][j] + root * minors[3 * i + j] - inner[i][0] * s[0][j] - inner[i][1] * s[1][j] - inner[i][2] * s[2][j]) / below for i in range(3)])
        off = (np.einsum("ikn,in->kn", p, turn) - q[j]) * held
        error += np.einsum("kn,kn->n", off, off)
    return ~(apart & (error > np.float32(1.02 * most) + np.float32(1e-5) * size))


def _superposed(a: _Shapes, b: _Shapes, x: np.ndarray, y: np.ndarray, min_common: int, required: int, limit: float) -> tuple:
    """Places of the pairs whose anchor RMSD, all shared points superposed, is within ``limit``, and the columns of SUPERPOSE_RESULT."""
    marks = a.marks.take(x, axis=1) & b.marks.take(y, axis=1)
    both, held, sound = (marks & 1).astype(bool), (marks & 2).astype(bool), (marks >> 2) & 1
    fine = (both.sum(axis=0) >= min_common) & (held.sum(axis=0) >= required) & (sound.sum(axis=0) == both.sum(axis=0))
    if not fine.all():
        x, y, both, held = x[fine], y[fine], both[:, fine], held[:, fine]
    fits = _may_fit(a.light.take(x, axis=2), b.light.take(y, axis=2), both, held, required * (limit / a.scale) ** 2)
    x, y, both, held = x[fits], y[fits], both[:, fits], held[:, fits]
    p, q, s = _moments(a.points.take(x, axis=2), b.points.take(y, axis=2), both)
    u, _, vt = np.linalg.svd(np.array(s).transpose(2, 0, 1))
    flip = np.linalg.det(u @ vt) < 0
    vt[flip, 2, :] *= -1
    # Points are rows, hence R = U Vt.
    error = ((np.einsum("ikn,nij->jkn", p, u @ vt) - q) ** 2).sum(axis=0) * both
    common = both.sum(axis=0)
    rmsd = np.sqrt(error.sum(axis=0) / np.maximum(common, 1))
    anchor_rmsd = np.sqrt((error * held).sum(axis=0) / np.maximum(held.sum(axis=0), 1))
    near = anchor_rmsd <= limit * (1 + 1e-9)
    x, y, both = x[near], y[near], both[:, near]
    letter = a.letter[:, x]
    same = (both & (letter >= 0) & (letter == b.letter[:, y])).sum(axis=0)
    union = (a.held[:, x] | b.held[:, y]).sum(axis=0)
    return x, y, same / np.maximum(union, 1), rmsd[near], anchor_rmsd[near], common[near].astype(np.int32)


SHAPE_BLOCK = 512  # structures of a block, until there are BLOCKS of them
SHAPE_CELLS = 3 << 13  # points of the pairs that are superposed in one go


def near_shapes(profiles: DataFrame, id_col: str, required: int, min_common: int, limit: float) -> DataFrame:
    """Superposed pairs (id_a < id_b) whose anchor RMSD may lie below ``limit``; none that does is lost (G1).

    Structures meet in blocks, so the pairs refused by the bounds of ``_may_be_near`` are never written.
    Structures without all anchors are at the sentinel distance from every other and have no pairs; so
    have those with a missing or non-finite coordinate at an anchor or a shared point. A structure has a
    numbered point once.
    """
    kind = dict(profiles.dtypes)[id_col]
    id_type = to_arrow_type(profiles.schema[id_col].dataType)
    empty = pa.schema([("id_a", id_type), ("id_b", id_type), *[(c, pa.float64()) for c in ("identity", "rmsd", "anchor_rmsd")], ("common_positions", pa.int32())]).empty_table()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty
        alone = left.column("i")[0].as_py() == left.column("j")[0].as_py()
        names = _names(left, right)
        a, b = _Shapes(left, id_col, names), _Shapes(right, id_col, names)
        scale = max(np.abs(a.points).max(initial=0), np.abs(b.points).max(initial=0), 1e-300)
        for side in (a, b):
            side.light, side.scale = (side.points / scale).astype(np.float32), scale
        (at_a, near_a), (at_b, near_b) = a.anchors(required), b.anchors(required)
        step = max(1, SHAPE_CELLS // max(len(names[0]), 1))
        found = [empty]
        for x, y in _may_be_near(near_a, near_b, limit):
            x, y = at_a[x], at_b[y]
            keep = a.ids[x] < b.ids[y] if alone else a.ids[x] != b.ids[y]
            x, y = x[keep], y[keep]
            for at in range(0, len(x), step):
                i, j, *scores = _superposed(a, b, x[at : at + step], y[at : at + step], min_common, required, limit)
                first = a.ids[i] < b.ids[j]
                ids = np.where(first, a.ids[i], b.ids[j]), np.where(first, b.ids[j], a.ids[i])
                found.append(pa.table([pa.array(v, f.type) for v, f in zip((*ids, *scores), empty.schema)], schema=empty.schema))
        return pa.concat_tables(found).combine_chunks()

    return block_pairs(profiles.select(id_col, *_PROFILE), id_col, F.size("pos"), meet, f"id_a {kind}, id_b {kind}, {SUPERPOSE_RESULT}", SHAPE_BLOCK)


def combined_distance(identity, rmsd, anchor_rmsd, scales: tuple[float, float, float], sentinel: float = 999.0) -> Column:
    """Largest of the three scaled terms; the sentinel when a term is not finite."""
    i, r, a = (F.col(c) if isinstance(c, str) else c for c in (identity, rmsd, anchor_rmsd))
    bad = r.isNull() | a.isNull() | F.isnan(r) | F.isnan(a) | (r == float("inf")) | (a == float("inf"))
    return F.when(bad, sentinel).otherwise(F.greatest((1.0 - i) / scales[0], r / scales[1], a / scales[2]))


# ---- sequence pairs above a similarity threshold ----


class _Letters:
    """Texts as one array of code points, the starts and the lengths."""

    def __init__(self, texts: Sequence[str]):
        self.size = np.array([len(s) for s in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def columns(self, at: np.ndarray) -> np.ndarray:
        """Letters of texts, a text per column; what comes after its end is to be left alone."""
        return self.flat.take(self.start[at] + np.arange(self.size[at].max(initial=0))[:, None], mode="clip")


LETTER_MASKS = 1 << 18  # words of the letter masks that are held at a time
LCS_PAIRS = 1 << 13  # pairs that are measured in one go


class _Subsequences:
    """Longest common subsequences of texts of a and of b, by bit vectors of 64 letters a word.

    Each text of a has a mask of its places per letter. A letter that it lacks, the end of a text and
    places beyond it change nothing, so texts of all lengths are measured side by side.
    """

    def __init__(self, a: _Letters, b: _Letters):
        seen = np.zeros(int(max(a.flat.max(initial=0), b.flat.max(initial=0))) + 1, bool)
        seen[a.flat] = True
        self.none = int(seen.sum())  # the letter that no text of a has
        code = np.where(seen, np.cumsum(seen) - 1, self.none)
        self.a, self.b, self.code_a, self.code_b = a, b, code[a.flat], np.append(code[b.flat], self.none)
        self.words = -(-a.size // 64)

    def lengths(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of text ``x[k]`` of a and ``y[k]`` of b; ``x`` ascends."""
        out = np.zeros(len(x), np.int64)
        lo, letters = 0, self.none + 1
        while lo < len(x):
            row, last = int(x[lo]), int(x[-1]) + 1
            most = np.maximum.accumulate(self.words[row:last]) * np.arange(1, last - row + 1) * letters
            high = row + max(1, int(np.searchsorted(most, LETTER_MASKS, "right")))
            size, start = self.a.size[row:high], self.a.start[row]
            masks = np.zeros((max(1, int(self.words[row:high].max())), (high - row) * letters), np.uint64)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            letter = self.code_a[start : start + size.sum()] + np.repeat(np.arange(high - row), size) * letters
            np.bitwise_or.at(masks, (place // 64, letter), np.uint64(1) << (place % 64).astype(np.uint64))
            end = int(np.searchsorted(x, high))
            for k in range(lo, end, LCS_PAIRS):
                i, j = x[k : min(k + LCS_PAIRS, end)] - row, y[k : min(k + LCS_PAIRS, end)]
                out[k : k + len(i)] = _measured(masks, i * letters, self.code_b, self.b.start[j], self.b.size[j], self.none)
            lo = end
        return out


def _measured(masks: np.ndarray, base: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray, none: int) -> np.ndarray:
    full = np.uint64(2**64 - 1)
    rows = [np.full(len(base), full) for _ in masks]
    least = size.min(initial=0)
    for j in range(int(size.max(initial=0))):
        letter = code.take(start + j, mode="clip")
        if j >= least:
            letter = np.where(j < size, letter, none)
        letter = letter + base
        carry = None
        for w, mask in enumerate(masks):
            row = rows[w]
            hit = row & mask.take(letter)
            total = row + hit
            if len(masks) > 1:
                over = total < hit
                if carry is not None:
                    total = total + carry
                    over = over | (total < carry)
                carry = over.astype(np.uint64)
            rows[w] = total | (row - hit)
    return 64 * len(masks) - sum(np.bitwise_count(row).astype(np.int64) for row in rows)


def _lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Longest common subsequence of each pair."""
    at = np.arange(len(a))
    return _Subsequences(_Letters(a), _Letters(b)).lengths(at, at)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as an Arrow UDF."""

    @F.pandas_udf("long")
    def kernel(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_lcs_lengths(list(x), list(y)))

    return kernel(a, b)


def lcs_similarity(pairs: DataFrame, a: str = "text_a", b: str = "text_b", name: str = "similarity") -> DataFrame:
    """Common subsequence over the longer length; both empty 1.0, one empty 0.0."""
    la, lb = F.length(a), F.length(b)
    empty = (la == 0) | (lb == 0)
    value = F.when(empty, ((la == 0) & (lb == 0)).cast("double")).otherwise(lcs_length(F.col(a), F.col(b)) / F.greatest(la, lb))
    return pairs.withColumn(name, value)


TEXT_BLOCK = 512  # texts of a block, until there are BLOCKS of them
LETTER_BINS = 64


def _letter_counts(texts: _Letters) -> np.ndarray:
    """How often each text holds letters of each bin, one row per bin; capped counts would be no bound."""
    n = len(texts.size)
    cells = (texts.flat.astype(np.int64) % LETTER_BINS) * n + np.repeat(np.arange(n), texts.size)
    counts = np.bincount(cells, minlength=LETTER_BINS * n).reshape(LETTER_BINS, n)
    most = texts.size.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64)


def _may_be_common(a: _Letters, b: _Letters, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs that share enough letters, counted with repeats in bins; both sides ascend in length, a strip of a at a time."""
    in_a, in_b = _letter_counts(a), _letter_counts(b)
    wide = max(in_a.dtype, in_b.dtype)
    in_a, in_b = in_a.astype(wide), in_b.astype(wide)
    for low in range(0, len(a.size), 64):
        here, sizes = in_a[:, low : low + 64], a.size[low : low + 64]
        used = np.flatnonzero(here.any(axis=1))
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        first = int(np.searchsorted(b.size, threshold * sizes[0] - 1e-6))
        last = int(np.searchsorted(b.size, (sizes[-1] + 1e-6) / threshold, "right"))
        for at in range(first, last, 512):
            there = in_b[:, at : min(at + 512, last)]
            shared, least = np.zeros((2, len(sizes), there.shape[1]), wide)
            for k in used:
                np.minimum(here[k][:, None], there[k][None, :], out=least)
                shared += least
            need = threshold * np.maximum(sizes[:, None], b.size[None, at : at + there.shape[1]]) - 1e-6
            i, j = np.nonzero(shared >= np.ceil(need).astype(wide))
            x.append(i + low)
            y.append(j + at)
        x, y = np.concatenate(x), np.concatenate(y)
        order = np.argsort(x, kind="stable")
        yield x[order], y[order]


PAIRS_HELD = 1 << 19  # pairs of a block that are finished in one go


def _gathered(strips: Iterator[tuple]) -> Iterator[tuple]:
    """Strips put together until they have ``PAIRS_HELD`` pairs."""
    held, count = [], 0
    for strip in strips:
        held.append(strip)
        count += len(strip[0])
        if count >= PAIRS_HELD:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, count = [], 0
    if count:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _text_pairs(texts: DataFrame, id_col: str, text: str, threshold: float, fields: list, finish) -> DataFrame:
    """Pairs (id_a < id_b) of texts whose common subsequence has ``threshold`` of the longer length, with what ``finish`` makes of them.

    Texts meet in blocks. A common subsequence is no longer than the letters that two texts share, counted
    with repeats in bins, which refuses most pairs; the rest are measured in the task. No candidate is written.
    ``finish``: both sides as lists of texts and as letters, places of the pairs, their subsequences; gives the
    pairs it keeps and the columns of ``fields``. Missing and empty texts are in no pair.
    """
    kind = texts.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    schema = pa.schema([("id_a", id_type), ("id_b", id_type), *[(name, to_arrow_type(t)) for name, t in fields]])

    def side(table: pa.Table):
        order = np.argsort(pc.utf8_length(table.column("text")).to_numpy(), kind="stable")
        held = table.column("text").take(order).to_pylist()
        return table.column("id").to_numpy()[order], held, _Letters(held)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [schema.empty_table()]
        if len(left) and len(right):
            alone = left.column("i")[0].as_py() == left.column("j")[0].as_py()
            (ids_a, texts_a, a), (ids_b, texts_b, b) = side(left), side(right)
            measure = _Subsequences(a, b)

            def strips():
                for x, y in _may_be_common(a, b, threshold):
                    keep = ids_a[x] < ids_b[y] if alone else ids_a[x] != ids_b[y]
                    x, y = x[keep], y[keep]
                    common = measure.lengths(x, y)
                    good = common >= threshold * np.maximum(a.size[x], b.size[y]) - 1e-6
                    yield x[good], y[good], common[good]

            for x, y, common in _gathered(strips()):
                first = ids_a[x] < ids_b[y]
                kept, values = finish((texts_a, a), (texts_b, b), x, y, common, first)
                x, y, first = x[kept], y[kept], first[kept]
                ids = np.where(first, ids_a[x], ids_b[y]), np.where(first, ids_b[y], ids_a[x])
                found.append(pa.table([pa.array(v, f.type) for v, f in zip((*ids, *values), schema)], schema=schema))
        return pa.concat_tables(found).combine_chunks()

    some = texts.filter(F.length(text) > 0).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    names = ", ".join(f"{name} {t.simpleString()}" for name, t in (("id_a", kind), ("id_b", kind), *fields))
    return block_pairs(some, "id", F.length("text"), meet, names, TEXT_BLOCK)


def common_pairs(texts: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """Pairs (id_a < id_b) of texts whose common subsequence has ``threshold`` of the longer length: ids, texts, ``common``."""

    def finish(left, right, x, y, common, first):
        one, two = [left[0][k] for k in x], [right[0][k] for k in y]
        both = [(u, v) if f else (v, u) for u, v, f in zip(one, two, first)]
        return slice(None), ([u for u, _ in both], [v for _, v in both], common)

    return _text_pairs(texts, id_col, text, threshold, [("text_a", StringType()), ("text_b", StringType()), ("common", LongType())], finish)


def lcs_pairs(texts: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """All pairs of distinct texts whose common-subsequence similarity reaches the threshold."""
    if threshold <= 2 / 3:
        raise ValueError("below two thirds, pairs of texts need not be alike")

    def finish(left, right, x, y, common, first):
        value = common / np.maximum(left[1].size[x], right[1].size[y])
        kept = value >= threshold - 1e-12
        return kept, (value[kept],)

    return _text_pairs(texts, id_col, text, threshold, [("similarity", DoubleType())], finish)


# Match, mismatch, gap opening and gap extension scores, times ten.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 10, 0, -10, -1
_LOW = -(10**9)


def _better(cur, new):
    """Cell-wise choice of (score, matches, length); the first one wins ties."""
    take = new[0] > cur[0]
    return tuple(np.where(take, y, x) for x, y in zip(cur, new))


def _one_gap(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, more: int) -> np.ndarray:
    """Most matches of alignments with no gap but one in the shorter text, which are columns x with ``sizes`` letters."""
    total, ahead, most = np.zeros((3, len(sizes)), np.int32)
    for i in range(len(x)):
        here = i < sizes
        late = here & (x[i] == y[i + more])
        total += late
        if more:
            ahead += here & (x[i] == y[i])
            ahead -= late
            np.maximum(most, ahead, out=most)
    return total + most


def _band(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, more: int, radius: int) -> np.ndarray:
    """Best alignments (score, matches, length) of pairs within ``radius`` of both corners' diagonals.

    Texts are columns, those of x have ``sizes`` letters, ascending, and those of y ``more`` than that. Cells are
    (row of x, diagonal); two rows of three states are kept, so memory follows the band. A pair leaves with its last row;
    cells beyond the end of y lead nowhere.
    """
    low, high = min(0, more) - radius, max(0, more) + radius  # diagonals j - i
    none = np.full(len(sizes), _LOW, np.int32)
    zero = np.zeros(len(sizes), np.int32)
    best = lambda cell: _better(_better(cell[0], cell[1]), cell[2])
    gap = lambda state, score: (state[0] + np.int32(score), state[1], state[2] + np.int32(1))

    def start(k):  # a gap of k letters from the corner on
        return zero + np.int32(GAP_OPEN + GAP_EXTEND * (k - 1)), zero, zero + np.int32(k)

    out = np.zeros((3, len(sizes)), np.int64)
    # States of a cell: ends in a letter pair, in a gap of y, in a gap of x.
    off = (none, zero, zero)
    above = [(off, off, off) if d < 0 else ((zero, zero, zero), off, off) if d == 0 else (off, off, start(d)) for d in range(low, high + 1)]
    done = 0
    for i in range(len(x) + 1):
        if i:
            row: list = []
            for k, d in enumerate(range(low, high + 1)):
                j = i + d
                if j < 0 or j > len(y):
                    row.append((off, off, off))
                elif j == 0:
                    row.append((off, start(i), off))
                else:
                    before = best(above[k])
                    same = x[i - 1, done:] == y[j - 1, done:]
                    pair = (before[0] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), before[1] + same, before[2] + np.int32(1))
                    in_y = in_x = off
                    if k + 1 < len(above):
                        p, u, v = above[k + 1]
                        in_y = _better(_better(gap(p, GAP_OPEN), gap(u, GAP_EXTEND)), gap(v, GAP_OPEN))
                    if k:
                        p, u, v = row[k - 1]
                        in_x = _better(_better(gap(p, GAP_OPEN), gap(u, GAP_OPEN)), gap(v, GAP_EXTEND))
                    row.append((pair, in_y, in_x))
            above = row
        ended = int(np.searchsorted(sizes, i, "right")) - done
        if ended:
            out[:, done : done + ended] = [v[:ended] for v in best(above[more - low])]
            none, zero = none[ended:], zero[ended:]
            off = (none, zero, zero)
            above = [tuple(tuple(v[ended:] for v in state) for state in cell) for cell in above]
            done += ended
    return out


def _beyond(least: np.ndarray, more: int, radius: int, common: np.ndarray) -> np.ndarray:
    """No alignment that leaves the band scores more: it has a gap in both texts, that many letters fewer in pairs than
    the shorter text (``least``), and no more matches than a common subsequence."""
    return MATCH * np.minimum(common, least - radius - 1) + 2 * GAP_OPEN + GAP_EXTEND * (2 * radius + abs(more))


ALIGN_CELLS = 1 << 18  # letters of the pairs that are aligned in one go


def _alike(longest: np.ndarray, more: np.ndarray) -> Iterator[slice]:
    """Runs of pairs with one difference of lengths, which ascends, and letters within ALIGN_CELLS."""
    low = 0
    while low < len(more):
        end = int(np.searchsorted(more, more[low], "right"))
        fits = np.maximum.accumulate(longest[low:end]) * np.arange(1, end - low + 1)
        high = low + max(1, int(np.searchsorted(fits, ALIGN_CELLS, "right")))
        yield slice(low, high)
        low = high


def _align(a: _Letters, b: _Letters, x: np.ndarray, y: np.ndarray, common: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Identity of the best global alignment of each pair, whose longest common subsequences have ``common`` letters.

    A band is widened, for the pairs that need it, until no path outside can score as much as the best
    one inside; the result is that of the full table. Below ``least`` any identity below it may be given:
    a path outside has that many letters more than the longer text, and no more matches than ``common``.
    """
    result = np.ones(len(x))
    la, lb = a.size[x], b.size[y]
    every, r = np.lexsort((la, lb - la)), 0
    while len(every):
        wider = []
        for at in _alike(np.maximum(la, lb)[every], (lb - la)[every]):
            at = every[at]
            more, most = int(lb[at[0]] - la[at[0]]), common[at]
            short, long = np.minimum(la[at], lb[at]), np.maximum(la[at], lb[at])
            one, two = a.columns(x[at]), b.columns(y[at])
            if r:
                score, matches, length = _band(one, two, la[at], more, r)
                beyond, letters = _beyond(short, more, r, most), long + r + 1
            else:
                matches = _one_gap(one, two, short, more) if more >= 0 else _one_gap(two, one, short, -more)
                score = MATCH * matches + MISMATCH * (short - matches) + (GAP_OPEN + GAP_EXTEND * (abs(more) - 1) if more else 0)
                # Any other has two gaps: one in each text, or two in the shorter.
                beyond, letters, length = _beyond(short, more, 0, most), long + 1, long
                if abs(more) > 1:
                    beyond, letters = MATCH * np.minimum(most, short) + 2 * GAP_OPEN + GAP_EXTEND * (abs(more) - 2), long
            identity = np.where(length > 0, matches / np.maximum(length, 1), 1.0)
            result[at] = identity
            wider.append(at[(r < long) & (score <= beyond) & ((identity >= least - 1e-9) | (most / np.maximum(letters, 1) >= least - 1e-9))])
        every, r = np.concatenate(wider), max(1, 4 * r)
    return result


def alignment_identity(a, b) -> Column:
    """Matches over alignment length of the best global alignment, affine gaps, as an Arrow UDF.

    Ties prefer a letter pair, then a gap in the second text, then a gap in the first.
    """

    @F.pandas_udf("double")
    def kernel(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right, at = _Letters(list(x)), _Letters(list(y)), np.arange(len(x))
        return pd.Series(_align(left, right, at, at, np.minimum(left.size, right.size)))

    return kernel(a, b)


def align_pairs(texts: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """All pairs of distinct texts whose alignment identity reaches the threshold."""
    if threshold <= 0.5:
        raise ValueError("below one half, pairs of texts need not be alike")

    def finish(left, right, x, y, common, first):
        (_, a), (_, b) = left, right
        value = np.empty(len(x))
        for u, v, i, j, pick in ((a, b, x, y, first), (b, a, y, x, ~first)):  # ties depend on the order of the texts
            value[pick] = _align(u, v, i[pick], j[pick], common[pick], threshold)
        kept = value >= threshold - 1e-12
        return kept, (value[kept],)

    # The matches are a common subsequence, and the alignment is no shorter than the longer text.
    return _text_pairs(texts, id_col, text, threshold, [("identity", DoubleType())], finish)


def vector_distance(a, b) -> Column:
    """Euclidean distance of two equally long arrays."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v))
