"""Ranked lexical search: dense blocked matrix products of item terms and document impacts.

Items come in blocks, each a bounded broadcast, and every block is matched against all documents. A
tile of documents becomes a dense matrix of impacts over the block's terms that occur in it, a tile of
items a dense matrix of term weights; their product, by BLAS in float64, holds the scores. All entries
are whole numbers, and a product takes so few terms at a time that its partial sums stay below 2^53:
it is exact in any order of summation. Sums of several products are 64-bit integers.

A task keeps the ``k`` best documents of each item. Scores of a tile that reach the k-th best so far,
equal ones included, are merged by (score, id), so ties never depend on tiles or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.words import PLAIN, Words, distinct, member, slices
from siftline.session import stage_table

BLOCK_BYTES = 2 << 20  # of item text in one broadcast
SLICE = 1 << 20  # of document text in one tile of rows
ITEM_TILE, DOC_TILE, TERM_TILE = 512, 512, 4096
EXACT = 1 << 53
NO_ID = 2**63 - 1


@dataclass
class Items:
    """A block of items: sorted term fingerprints, and each item's terms as places among them."""

    rows: np.ndarray
    terms: np.ndarray
    owner: np.ndarray  # item of each (item, term) pair, ascending
    place: np.ndarray  # term of each pair

    def plain(self) -> tuple:
        return tuple(vars(self).values())

    @staticmethod
    def of(rows: list[int], texts: list[str | None]) -> Items:
        words = Words(pa.array(texts, pa.string()), PLAIN, lower=True)
        prints = words.hashes()
        terms = distinct(prints)
        pairs = distinct(words.row_of() * max(len(terms), 1) + member(prints, terms))
        return Items(np.array(rows, np.int64), terms, pairs // max(len(terms), 1), pairs % max(len(terms), 1))


def item_blocks(items: DataFrame, row: str, text: str, block_bytes: int) -> Iterator[Items]:
    """Items dealt by row number into blocks of about ``block_bytes``, one at a time on the driver."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + total // block_bytes
    for b in range(blocks):
        found = items.filter(F.pmod(F.xxhash64(row), F.lit(blocks)) == b).select(row, text).collect()
        yield Items.of([r[0] for r in found], [r[1] for r in found])


def _counted(words: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the known terms of a slice, by row and term."""
    known = member(words.hashes(), terms)
    hit = known >= 0
    keys = np.sort(words.row_of()[hit] * len(terms) + known[hit])
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    counts = np.diff(np.append(begin, len(keys)))
    return keys[begin] // max(len(terms), 1), keys[begin] % max(len(terms), 1), counts


def term_statistics(docs: DataFrame, items: Items, text: str) -> tuple[int, int, np.ndarray]:
    """N, L and the document count of each term of the block, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def count(batches):
        terms = shared.value
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE):
                words = Words(batch.column(0).slice(lo, hi - lo), PLAIN, lower=True)
                n, total = n + int((words.counts > 0).sum()), total + len(words)
                df += np.bincount(_counted(words, terms)[1], minlength=len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *range(len(terms))], pa.int64()), "n": pa.array(np.concatenate(([n, total], df)), pa.int64())})

    found = docs.select(F.col(text).alias("_text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r["term"]: r["n"] for r in found}  # two numbers, and one for each term of the block
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(len(items.terms))], np.int64)


def lengths(counts: np.ndarray, n: int, total: int) -> np.ndarray:
    """100-50+((50*n*N) div L) of documents of ``counts`` terms; exact beyond 64 bits too."""
    if 50 * int(counts.max(initial=0)) * n < 1 << 63:
        return 50 + 50 * counts * n // max(total, 1)
    return np.array([50 + 50 * int(c) * n // total for c in counts], np.int64)


class Best:
    """The k best (score, id) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(n_items, np.int64)  # scores below can't enter

    def offer(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in candidates; of equal scores the smaller id is better."""
        item, score, ids = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        begin = np.searchsorted(item, item, "left")
        keep = np.arange(len(item)) - begin < self.k
        self.item, self.score, self.id = item[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.arange(len(item))[keep] - begin[keep] == self.k - 1)
        self.least[self.item[full]] = np.maximum(self.score[full], 1)

    def tile(self, first_item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a tile, items by documents; only those that reach the k-th best are kept."""
        least = self.least[first_item : first_item + len(scores)]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        if len(item):
            self.offer(item + first_item, scores[item, doc], ids[doc])


def score_tiles(items: Items, weights: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Dense products of all item tiles with the tiles of a slice's documents."""
    n_items = len(items.rows)
    step = max(1, min(TERM_TILE, (EXACT - 1) // max(int(weights.max(initial=0)) * 1_000_000, 1)))
    for d in range(0, len(ids), DOC_TILE):
        a, b = np.searchsorted(row, (d, d + DOC_TILE))
        used = distinct(term[a:b])  # terms of the block in this tile of documents
        if not len(used):
            continue
        here = ids[d : d + DOC_TILE]
        column = np.searchsorted(used, term[a:b])
        impacts = np.zeros((len(here), len(used)))
        impacts[row[a:b] - d, column] = impact[a:b]
        for i in range(0, n_items, ITEM_TILE):
            x, y = np.searchsorted(items.owner, (i, i + ITEM_TILE))
            spot = member(items.place[x:y], used)
            spots = distinct(spot[spot >= 0])  # and of these the ones in this tile of items
            owner, spot = items.owner[x:y][spot >= 0] - i, np.searchsorted(spots, spot[spot >= 0])
            scores = np.zeros((min(ITEM_TILE, n_items - i), len(here)), np.int64)
            for t in range(0, len(spots), step):
                some = (spot >= t) & (spot < t + step)
                own = np.zeros((len(scores), len(spots[t : t + step])))
                own[owner[some], spot[some] - t] = weights[used[spots[spot[some]]]]
                scores += (own @ impacts[:, spots[t : t + step]].T).astype(np.int64)
            best.tile(i, scores, here)


def _block_scores(docs: DataFrame, items: Items, doc_id: str, text: str, k: int) -> DataFrame:
    n, total, df = term_statistics(docs, items, text)
    weights = np.array([floor(1000 * log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((items.plain(), weights))

    def search(batches):
        own, weights = shared.value
        own = Items(*own)
        best = Best(len(own.rows), k)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(1), PLAIN, lower=True)
                row, term, tf = _counted(words, own.terms)
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * lengths(words.counts, n, total)[row])
                ids = pc.fill_null(part.column(0), NO_ID).to_numpy(zero_copy_only=False)
                score_tiles(own, weights, row, term, impact, ids, best)
        yield pa.RecordBatch.from_pydict({"_item": pa.array(own.rows[best.item], pa.int64()), "_doc": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.int64())})

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(search, "_item long, _doc long, score long")


def top_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents.

    Every row of ``items`` is an item of its own and every row of ``docs`` a document of its own, so
    repeated rows are ranked each for itself. Only scores above 0 are ranked; equal scores go by
    ascending id, a null id last. Null and empty texts have no terms: such items have no rows, such
    documents are in none. Texts of any length are one row. Other columns are not looked at. Document
    ids are whole numbers below 2^63 - 1. Terms are told apart by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    numbered = stage_table(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id).alias("_name"), F.col(item_text).alias("_text")), "items")
    parts = [_block_scores(docs, block, doc_id, text, k) for block in item_blocks(numbered, "_item", "_text", block_bytes)]
    found = reduce(DataFrame.unionByName, parts)
    # Each task has k rows of an item at most. They meet in as many groups as there are cores, then in one.
    order = [F.desc("score"), "_doc"]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(spark.sparkContext.defaultParallelism)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("_item", "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).filter(F.col("rank") <= k)
    named = ranked.join(numbered.select("_item", "_name"), "_item")
    return named.select(F.col("_name").alias(item_id), "rank", F.when(F.col("_doc") != NO_ID, F.col("_doc")).cast(dict(docs.dtypes)[doc_id]).alias(doc_id), "score")
