"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of whole documents of bounded size. Its index text holds the words that can take
part in a hit: maximal runs of words in which every neighbouring pair is a pair of the test phrases.
Nothing else can hold a phrase, so no hit is lost, and an index stays small on clean text. Phrases
are searched backwards, one word at a time for all phrases at once, through wavelet-matrix ranks;
occurrences are located by sampled suffix positions and merged into removal spans.

Test phrases come in blocks of bounded bytes; a block is broadcast, searched in all shards, and the
hits of several blocks are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import PLAIN, Words, covered, distinct, member, slices, sums_by_row
from siftline.session import stage_table

WINDOW = 13
SAMPLE = 16
BLOCK_BYTES = 8 << 20


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            on = (symbols >> bit & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(on, out=ones[1:])
            self.levels.append((bit, on, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate((symbols[~on], symbols[on]))

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol`` before each place."""
        base, at = np.zeros(len(symbol), np.int64), [p.copy() for p in places]
        for bit, _, ones, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            base = np.where(one, zeros + ones[base], base - ones[base])
            at = [np.where(one, zeros + ones[p], p - ones[p]) for p in at]
        return [p - base for p in at]

    def access(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for _, on, ones, zeros in self.levels:
            one = on[place]
            out = out * 2 + one
            place = np.where(one, zeros + ones[place], place - ones[place])
        return out


class FMIndex:
    """Runs of symbols (1 and up); a search never leaves a run."""

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, sigma: int):
        """``begins``: True at the first symbol of each run."""
        runs = np.cumsum(begins) - 1
        n = len(symbols) + int(begins.sum()) + 1
        spot = np.arange(len(symbols)) + runs + 1  # a run follows its separator
        text = np.zeros(n, np.int64)
        text[spot] = symbols
        order = self._suffixes(text)
        self.text_spot, self.sigma = spot, sigma
        before = text[order - 1]
        self.bwt = WaveletMatrix(before, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        # Each run's first symbol and every SAMPLE-th after it are sampled: a walk stays in its run.
        inside = np.arange(len(symbols)) - np.flatnonzero(begins)[runs]
        sampled = np.zeros(n, bool)
        sampled[spot[inside % SAMPLE == 0]] = True
        self.marked = sampled[order]
        self.kept = np.zeros(n + 1, np.int64)
        np.cumsum(self.marked, out=self.kept[1:])
        self.sample = order[self.marked]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; separators differ by place, so rounds follow the longest run."""
        n = len(text)
        apart = text == 0
        rank = np.where(apart, np.cumsum(apart) - 1, text + int(apart.sum()))
        step = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + np.where(apart, 0, follow)
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                return order

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol number, phrase number) of every occurrence; phrases are rows, filled up with 0."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.first[-1])
        done = []
        for back in range(phrases.shape[1]):
            ended = sizes[live] == back
            done.append((live[ended], lo[ended], hi[ended]))
            live, lo, hi = live[~ended], lo[~ended], hi[~ended]
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - back]
            if back:
                below, upto = self.bwt.rank(symbol, lo, hi)
                lo, hi = self.first[symbol] + below, self.first[symbol] + upto
            else:
                lo, hi = self.first[symbol], self.first[symbol + 1]
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
        done.append((live, lo, hi))
        live, lo, hi = (np.concatenate(x) for x in zip(*done))
        found = np.repeat(live, hi - lo)
        ahead = np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        return self._locate(np.repeat(lo, hi - lo) + ahead), found

    def _locate(self, row: np.ndarray) -> np.ndarray:
        spots, steps, left = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(left):
            here = self.marked[row]
            spots[left[here]] = self.sample[self.kept[row[here]]] + steps
            row, left = row[~here], left[~here]
            if len(left):
                symbol = self.bwt.access(row)
                row = self.first[symbol] + self.bwt.rank(symbol, row)[0]
            steps += 1
        return np.searchsorted(self.text_spot, spots)


@dataclass
class Phrases:
    """The distinct windows of a block of test items, as symbols of the block's words."""

    names: list[str]
    vocabulary: np.ndarray
    pairs: np.ndarray
    windows: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray  # item numbers, window by window
    owner_at: np.ndarray

    def plain(self) -> tuple:
        """The fields, to be shipped without their class."""
        return tuple(vars(self).values())

    @staticmethod
    def of(names: list[str], texts: list[str | None], size: int = WINDOW) -> Phrases:
        words = Words(pa.array(texts, pa.string()), PLAIN, lower=True)
        hashes = words.hashes()
        vocabulary = distinct(hashes)
        symbols = np.searchsorted(vocabulary, hashes) + 1
        item = words.row_of()
        short = (words.counts > 0) & (words.counts < size)
        starts = np.concatenate((words.window_starts(size), words.at[:-1][short]))
        sizes = np.minimum(size, words.counts[item[starts]]) if len(starts) else np.zeros(0, np.int64)
        grid = starts[:, None] + np.arange(size)
        table = np.where(np.arange(size) < sizes[:, None], symbols[np.minimum(grid, max(len(symbols) - 1, 0))], 0) if len(starts) else np.zeros((0, size), np.int64)
        windows, same = np.unique(table, axis=0, return_inverse=True) if len(starts) else (table, starts)
        owned = distinct(same.reshape(-1) * len(names) + item[starts]) if len(starts) else starts
        follow = np.flatnonzero(item[1:] == item[:-1])
        return Phrases(
            names, vocabulary, distinct(symbols[follow] * (len(vocabulary) + 1) + symbols[follow + 1]), windows, (windows > 0).sum(axis=1),
            owned % max(len(names), 1), np.searchsorted(owned // max(len(names), 1), np.arange(len(windows) + 1)),
        )

    def hits(self, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of a shard; hit flags by word; (row, item) pairs; merged spans by their first and last word."""
        words = Words(column, PLAIN, lower=True)
        nothing = np.zeros(0, np.int64)
        hit = np.zeros(len(words), bool)
        if not len(words) or not len(self.windows):
            return words, hit, nothing, nothing, nothing
        least = int(self.sizes.min())
        hashes, shift = words.hashes(), np.uint64(44)
        sieve = np.zeros(1 << 20, bool)
        sieve[self.vocabulary >> shift] = True
        some = np.flatnonzero(sieve[hashes >> shift])
        symbols = np.zeros(len(words), np.int64)
        symbols[some] = member(hashes[some], self.vocabulary) + 1
        begins_row = np.zeros(len(words) + 1, bool)
        begins_row[words.at[:-1]] = True
        link = np.zeros(len(words) + 1, bool)  # between a word and the one before it
        both = np.flatnonzero((symbols[1:] > 0) & (symbols[:-1] > 0) & ~begins_row[1:-1])
        link[both[member(symbols[both] * (len(self.vocabulary) + 1) + symbols[both + 1], self.pairs) >= 0] + 1] = True
        begins = np.flatnonzero(~link[:-1] & (symbols > 0) & (link[1:] | (least == 1)))
        ends = np.flatnonzero(~link[1:] & (symbols > 0) & (link[:-1] | (least == 1))) + 1
        long = ends - begins >= least
        begins, sizes = begins[long], (ends - begins)[long]
        if not len(begins):
            return words, hit, nothing, nothing, nothing
        origin = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        run_first = np.zeros(len(origin), bool)
        run_first[np.cumsum(sizes) - sizes] = True
        index = FMIndex(symbols[origin], run_first, len(self.vocabulary) + 1)
        place, window = index.search(self.windows, self.sizes)
        place = origin[place]
        hit = covered(place, self.sizes[window], len(words))
        many = np.diff(self.owner_at)[window]
        owner = np.repeat(self.owner_at[window], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        row = np.searchsorted(words.at, place, "right") - 1
        pairs = distinct(np.repeat(row, many) * len(self.names) + self.owners[owner])
        # Spans of one row that touch are one span.
        edge = np.concatenate(([False], hit, [False]))
        cut = np.concatenate(([False], begins_row[:-1] & hit, [False]))
        firsts = np.flatnonzero(edge[1:-1] & (~edge[:-2] | cut[1:-1]))
        lasts = np.flatnonzero(edge[1:-1] & (~edge[2:] | cut[2:]))
        return words, hit, pairs, firsts, lasts


def phrase_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Test phrases in blocks of about ``block_bytes``, one at a time on the driver.

    A null item id is named ``null``; null texts have no phrases.
    """
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.coalesce(text, F.lit("")).alias("text"))
    items = stage_table(items.withColumn("row", F.monotonically_increasing_id()), "phrases")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = 1 + total // block_bytes
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        found = block.collect()
        yield Phrases.of([r["name"] for r in found], [r["text"] for r in found])


def _int_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))


def _scan(docs: DataFrame, phrases: Phrases, columns: dict[str, str], text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases.plain())

    def shards(batches):
        own = Phrases(*shared.value)
        for batch in batches:
            for lo, hi in slices(batch.column("_text")):
                part = batch.slice(lo, hi - lo)
                words, hit, pairs, firsts, lasts = own.hits(part.column("_text"))
                names = own.names
                rows, n_names = len(part), max(len(names), 1)
                item_at = np.searchsorted(pairs // n_names, np.arange(rows + 1))
                span_at = np.searchsorted(firsts, words.at)
                base = words.at[:-1]
                span_rows = np.repeat(base, np.diff(span_at))
                named = [sorted(set(names[i] for i in pairs[a:b] % n_names)) for a, b in zip(item_at[:-1], item_at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(words.counts, pa.int64()), pa.array(sums_by_row(hit, words.at), pa.int64()), pa.array(named, pa.list_(pa.string())),
                     _int_lists(firsts - span_rows, span_at), _int_lists(lasts + 1 - span_rows, span_at)],
                    names=[*columns, "n_words", "n_hit", "items", "span_starts", "span_ends"],
                )

    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
    asked = docs.select(*[F.col(c) for c in columns], F.col(text).alias("_text"))
    return asked.mapInArrow(shards, f"{schema}, n_words long, n_hit long, items array<string>, span_starts array<long>, span_ends array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: id, ``n_words``, ``n_hit``, ``items``, ``spans``, ``contaminated``.

    ``items``: names of test items with occurring windows, sorted as text. ``spans``: merged removal
    spans as word numbers, end exclusive. Contaminated: a hit, and at least one word in twenty hit.
    Null and empty texts have no words; an empty benchmark hits nothing. Repeated rows are judged
    each for itself; with several blocks, rows are numbered once and their hits merged by number.
    """
    keys = {doc_id: dict(docs.dtypes)[doc_id]}
    blocks = phrase_blocks(benchmark, block_bytes=block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is not None:  # two blocks at a time are on the driver
        docs = stage_table(docs.select(doc_id, text, F.monotonically_increasing_id().alias("_row")), "numbered")
        keys["_row"] = "bigint"
        found = stage_table(_scan(docs, block, keys, text), "hits")
        while following is not None:
            block, following = following, next(blocks, None)
            found = found.unionByName(stage_table(_scan(docs, block, keys, text), "hits"))
        found = _merged(found, doc_id)
    else:
        found = _scan(docs, block, keys, text)
    spans = F.transform(F.arrays_zip("span_starts", "span_ends"), lambda s: F.struct(s["span_starts"].alias("start"), s["span_ends"].alias("end")))
    return found.select(
        doc_id, "n_words", "n_hit", "items", spans.alias("spans"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _merged(found: DataFrame, doc_id: str) -> DataFrame:
    """Union of the spans and items that all blocks found in a row."""
    pieces = found.groupBy("_row").agg(
        F.any_value(doc_id).alias(doc_id), F.any_value("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends")))).alias("s"),
    )
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["span_starts"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["span_ends"]).alias("b")))),
    ).otherwise(F.concat(done, F.array(F.struct(s["span_starts"].alias("a"), s["span_ends"].alias("b")))))
    joined = pieces.withColumn("u", F.aggregate("s", F.array().cast("array<struct<a:bigint,b:bigint>>"), step))
    return joined.select(
        doc_id, "n_words", F.aggregate("u", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]).alias("n_hit"), "items",
        F.transform("u", lambda x: x["a"]).alias("span_starts"), F.transform("u", lambda x: x["b"]).alias("span_ends"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated in any block of ``benchmark``.

    Whether a document is contaminated depends on all blocks together, so with several blocks the
    hit words of a row are gathered as spans first, by row number; with one block rows are filtered as
    they pass. Null and empty texts stay. Repeated rows stay or go together; columns may have any names.
    """
    blocks = phrase_blocks(benchmark, block_bytes=block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is not None:
        numbered = stage_table(docs.select(F.struct(*docs.columns).alias("own"), F.monotonically_increasing_id().alias("number")), "numbered")
        asked = numbered.select("number", F.col("own")[text].alias("text"))
        bad = contamination(asked, benchmark, "number", "text", block_bytes).filter("contaminated").select("number")
        return numbered.join(bad, "number", "left_anti").select(*[F.col("own")[c].alias(c) for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(first.plain())

    def clean(batches):
        own = Phrases(*shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in slices(column):
                words, hit, *_ = own.hits(column.slice(lo, hi - lo))
                n_hit = sums_by_row(hit, words.at)
                yield batch.slice(lo, hi - lo).filter(pa.array((n_hit == 0) | (20 * n_hit < words.counts)))

    return docs.mapInArrow(clean, docs.schema)
