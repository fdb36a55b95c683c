"""Greedy diversified selection and panel roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siftline.session import cut, literal_rows

Measure = Callable[[Row], tuple[Column, Column]]


def _scan(state: DataFrame, picks: list[Row], id_col: str, measure: Measure) -> DataFrame:
    """The whole table with its minima brought up to date, without the rows picked since the last scan."""
    return cut(_folded(state, picks, id_col, measure))


def _folded(rows: DataFrame, picks: list[Row], id_col: str, measure: Measure) -> DataFrame:
    for pick in picks:
        seq, geo = measure(pick)
        rows = rows.filter(F.col(id_col) != F.lit(pick[id_col])).withColumns({"_seq": F.least("_seq", seq), "_geo": F.least("_geo", geo)})
    return rows


def select_diverse(nodes: DataFrame, k: int, id_col: str, quality: str, measure: Measure, weights: tuple[float, float, float],
                   pinned: Column | None = None, soft: str | None = None, shortlist: int = 256) -> DataFrame:
    """k picks, each with the largest weighted sum of quality and distances to the picks so far.

    Distances to the picks only fall as picks are added, so a utility of an earlier round is an upper
    bound. One scan gives the ``shortlist`` rows of the largest utilities, and the utility of the next
    row bounds all others. Picks are taken from the shortlist, brought up to date, as long as the best
    of it is above that bound; then the table is scanned again. ``weights`` must not be negative. The
    driver sees the picks, whose distances are columns built by ``measure`` (sequence distance,
    geometry distance), and one bound a scan. Ties go to quality, then to the largest id.
    """
    wq, ws, wg = weights
    if min(ws, wg) < 0:
        raise ValueError("with negative weights utilities could rise")
    far = F.lit(float("inf"))
    state = nodes.withColumns({"_seq": far, "_geo": far})
    pin = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    seed_order = [pin.desc(), F.col(quality).desc()] + ([F.col(soft).asc()] if soft else []) + [F.col(id_col).desc()]
    utility = F.lit(wq) * F.col(quality) + F.lit(ws) * F.col("_seq") + F.lit(wg) * F.col("_geo")
    order = [F.col("_utility").desc(), F.col(quality).desc(), F.col(id_col).desc()]
    seed = state.orderBy(*seed_order).limit(1).collect() if k > 0 else []
    picks = [(1, r[id_col], r[quality], None, None, None) for r in seed]
    pending = list(seed)
    while pending and len(picks) < k:
        state = _scan(state, pending, id_col, measure)
        ranked = cut(state.withColumn("_utility", utility).orderBy(*order).limit(shortlist + 1))
        rest = ranked.orderBy(*order).offset(shortlist).select("_utility").collect()  # the first row beyond, if any
        bound = rest[0][0] if rest else None
        near, pending = ranked.orderBy(*order).limit(shortlist).drop("_utility"), []
        while len(picks) < k:
            best = near.withColumn("_utility", utility).orderBy(*order).limit(1).collect()
            # Straight after a scan the first row is the best; later only if nothing else can reach it.
            if not best or (pending and bound is not None and not (best[0]["_utility"] is not None and best[0]["_utility"] > bound)):
                break
            row = best[0]
            picks.append((len(picks) + 1, row[id_col], row[quality], row["_utility"], row["_seq"], row["_geo"]))
            pending.append(row)
            near = cut(_folded(near, [row], id_col, measure))
    names = ["selection_rank", id_col, "quality", "utility", "min_sequence_distance", "min_geometry_distance"]
    table = literal_rows(nodes.sparkSession, picks, names)
    return table.withColumns({c: F.col(c).cast("double") for c in names[2:]})


def assign_roles(df: DataFrame, n_primary: int, rank: str = "selection_rank") -> DataFrame:
    """The first ``n_primary`` ranks are primary, the rest reserve."""
    return df.withColumn("role", F.when(F.col(rank) <= n_primary, "primary").otherwise("reserve"))
