"""Substring dedup: fixed-block anchors, rolling probes, and maximal exact repeats.

Reference blocks are the non-overlapping seven-word blocks of every document; each window of thirteen
words holds one whole block. Every rolling seven-word window probes the block index. Words of windows
around a hit are extended: a window of thirteen words is a repeat if the same words start in a
document with a smaller id. Runs of repeated windows are the maximal exact repeats.

Rows are dealt into shards by their number, so that neither an id nor a text makes a shard large, once. A shard sends each of its distinct
fingerprints once to the bucket that owns it, packed with all others for that bucket; a bucket
answers with the fingerprints that are alive. So a passage held by a third of all rows sends one entry per shard, no
group holds pairs, and shards and buckets are sized by the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import SPACED, Words, covered, slices, window_hashes

WINDOW, BLOCK = 13, 7  # WINDOW >= 2 * BLOCK - 1, so a window holds a whole block
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 6 << 20  # of text behind one bucket
LOW_BITS = 38  # of a fingerprint, next to its bucket; two more bits are flags: five bytes
IS_BLOCK, IN_MANY = 1, 2
NO_ID = 2**63 - 1
_U = np.uint64


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets take equal ranges of the upper bits."""
    return (values >> _U(38)) * _U(buckets) >> _U(26)


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _pack_ids(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids above their smallest, in four bytes each where that is enough."""
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    return base, (ids - base).astype("<u8" if wide else "<u4").tobytes()


def _unpack_ids(base: int, blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u8" if len(blob) == 8 * n else "<u4").astype(np.int64) + base


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by value, where each distinct value begins in it, and the values' group numbers in order."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate((np.ones(min(len(values), 1), bool), ordered[1:] != ordered[:-1]))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class Shard:
    """Rolling fingerprints of a shard's documents."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        batch = table.to_batches()[0] if len(table) else pa.RecordBatch.from_pylist([], table.schema)
        self.ids = pc.fill_null(batch.column(1), NO_ID).to_numpy(zero_copy_only=False)
        self.parts = [Words(batch.column(2).slice(lo, hi - lo), SPACED) for lo, hi in slices(batch.column(2))]
        self.counts = np.concatenate([np.zeros(0, np.int64), *[w.counts for w in self.parts]])
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.n = int(self.first[-1])

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first word of every window of ``size`` words."""
        prints, places, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for words in self.parts:
            starts = words.window_starts(size)
            prints.append(window_hashes(words.hashes(), size, size)[starts])
            places.append(starts + base)
            base += len(words)
        return np.concatenate(prints), np.concatenate(places)

    def probes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, low bits) of rolling blocks, their flags, and the windows in that order."""
        prints, places = self.windows(BLOCK)
        order, begin, group = _groups(_bucket(prints, buckets) << _U(LOW_BITS) | prints & _U((1 << LOW_BITS) - 1))
        keys = (_bucket(prints[order[begin]], buckets) << _U(LOW_BITS)) | (prints[order[begin]] & _U((1 << LOW_BITS) - 1))
        if not len(begin):
            return keys, np.zeros(0, np.uint8), places, order, group
        rows = self.row(places)
        block = (places - self.first[rows]) % BLOCK == 0
        ordered = rows[order]
        many = np.maximum.reduceat(ordered, begin) != np.minimum.reduceat(ordered, begin)
        flags = np.where(np.logical_or.reduceat(block[order], begin), IS_BLOCK, 0) + np.where(many, IN_MANY, 0)
        return keys, flags.astype(np.uint8), places, order, group

    def kept_texts(self, removed: np.ndarray) -> list[bytes | None]:
        """The kept words of each document, joined by one space."""
        out, base = [], 0
        for words in self.parts:
            keep = np.flatnonzero(~removed[base : base + len(words)])
            sizes = words.ends[keep] - words.starts[keep]
            begin = np.concatenate(([0], np.cumsum(sizes + 1)))
            text = np.full(int(begin[-1]), 0x20, np.uint8)
            spot = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            text[spot + np.repeat(begin[:-1], sizes)] = words.data[spot + np.repeat(words.starts[keep], sizes)]
            at = begin[np.searchsorted(keep, words.at)]
            raw = text.tobytes()
            out += [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            base += len(words)
        return out


def _by_bucket(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the ranges of sorted keys."""
    own = keys >> _U(bits)
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(own), 1), bool), own[1:] != own[:-1])))
    return [(int(own[a]), int(a), int(b)) for a, b in zip(begin, np.append(begin[1:], len(own)))]


def _table(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(names.items(), columns)})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``n_words``, ``spans`` (removed words, end exclusive) and ``kept`` (text) of each row.

    A word is removed if a window of 13 words that covers it also starts in a document with a smaller
    id. Ids are whole numbers; rows of one id are the same document, each judged for itself; a row
    without id counts as larger than all. Null texts and texts of fewer than 13 words lose nothing.
    ``kept`` has its words joined by one space. Texts of any length are whole; other columns are not
    looked at. The numbers of the rows must be the same if an executor is lost: ``docs`` is a table, or
    made from one without a shuffle. Sequences are told apart by 64-bit fingerprints, on
    top of the anchor that they share.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    shards, buckets = 1 + total // SHARD_BYTES, 1 + total // BUCKET_BYTES
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    blob, long = pa.binary(), pa.int64()

    def send_probes(table: pa.Table) -> pa.Table:
        keys, flags, *_ = Shard(table).probes(buckets)
        shard = table.column(0)[0].as_py()
        low = (keys & _U((1 << LOW_BITS) - 1)) << _U(2) | flags.astype(np.uint64)
        return _table([(b, shard, _pack(low[x:y])) for b, x, y in _by_bucket(keys, LOW_BITS)], {"bucket": long, "shard": long, "prints": blob})

    def answer_probes(table: pa.Table) -> pa.Table:
        """An entry lives if its words are a block somewhere and occur in two documents."""
        lists = [_unpack(x) for x in table.column("prints").to_pylist()]
        values = np.concatenate(lists)
        order, begin, group = _groups(values >> _U(2))
        flags = np.bitwise_or.reduceat((values & _U(3))[order], begin)
        sizes = np.diff(np.append(begin, len(values)))
        live = ((flags & _U(IS_BLOCK)) > 0) & ((sizes > 1) | ((flags & _U(IN_MANY)) > 0))
        entry = np.zeros(len(values), bool)
        entry[order] = live[group]
        at = np.cumsum([0, *map(len, lists)])
        bucket = table.column("bucket")[0].as_py()
        rows = [(s, bucket, np.packbits(entry[a:b]).tobytes()) for s, a, b in zip(table.column("shard").to_pylist(), at[:-1], at[1:]) if entry[a:b].any()]
        return _table(rows, {"shard": long, "bucket": long, "live": blob})

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Windows around a living block, each distinct one with the smallest id of the shard."""
        names = {"bucket": long, "shard": long, "prints": blob, "base": long, "ids": blob}
        if not len(table) or not len(answers):
            return _table([], names)
        shard = Shard(table)
        keys, _, places, order, group = shard.probes(buckets)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("live").to_pylist()))
        live = np.zeros(len(keys), bool)
        for b, x, y in _by_bucket(keys, LOW_BITS):
            if b in bits:
                live[x:y] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=y - x)
        hits = np.zeros(shard.n + 1, np.int64)
        hits[places[order[live[group]]] + 1] = 1
        hits = np.cumsum(hits)
        prints, starts = shard.windows(WINDOW)
        around = hits[starts + WINDOW - BLOCK + 1] > hits[starts]
        prints, starts = prints[around], starts[around]
        if not len(prints):
            return _table([], names)
        order, begin, _ = _groups(prints)
        least = np.minimum.reduceat(shard.ids[shard.row(starts)][order], begin)
        prints = prints[order[begin]]
        number = table.column(0)[0].as_py()
        own = _bucket(prints, buckets)
        cuts = np.append(np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))), len(own))
        rows = [(int(own[a]), number, prints[a:b].astype("<u8").tobytes(), *_pack_ids(least[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
        return _table(rows, names)

    def answer_windows(table: pa.Table) -> pa.Table:
        """Windows with a smaller id elsewhere, with the smallest."""
        prints = [np.frombuffer(x, "<u8") for x in table.column("prints").to_pylist()]
        ids = [_unpack_ids(b, x, len(p)) for b, x, p in zip(table.column("base").to_pylist(), table.column("ids").to_pylist(), prints)]
        values, owners = np.concatenate(prints), np.concatenate(ids)
        order, begin, group = _groups(values)
        least = np.zeros(len(values), np.int64)
        least[order] = np.minimum.reduceat(owners[order], begin)[group]
        at, rows = np.cumsum([0, *map(len, prints)]), []
        for s, a, b in zip(table.column("shard").to_pylist(), at[:-1], at[1:]):
            some = np.flatnonzero(least[a:b] < owners[a:b]) + a
            if len(some):
                rows.append((s, values[some].tobytes(), *_pack_ids(least[some])))
        return _table(rows, {"shard": long, "prints": blob, "base": long, "ids": blob})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"id": long, "n_words": long, "starts": pa.list_(long), "ends": pa.list_(long), "kept": pa.string()}
        if not len(table):
            return _table([], kinds)
        shard = Shard(table)
        prints, starts = shard.windows(WINDOW)
        ids = shard.ids[shard.row(starts)]
        order, begin, group = _groups(prints)
        least = np.minimum.reduceat(ids[order], begin) if len(begin) else np.zeros(0, np.int64)
        distinct = prints[order[begin]]
        for p, base, own in zip(answers.column("prints").to_pylist(), answers.column("base").to_pylist(), answers.column("ids").to_pylist()):
            told = np.frombuffer(p, "<u8")
            spot = np.searchsorted(distinct, told)
            least[spot] = np.minimum(least[spot], _unpack_ids(base, own, len(told)))
        later = np.zeros(len(prints), bool)
        later[order] = least[group] < ids[order] if len(order) else False
        removed = covered(starts[later], WINDOW, shard.n)
        cut = np.zeros(shard.n + 1, bool)
        cut[shard.first] = True
        edge = np.concatenate(([False], removed, [False]))
        firsts = np.flatnonzero(removed & (~edge[:-2] | cut[:-1]))
        lasts = np.flatnonzero(removed & (~edge[2:] | cut[1:])) + 1
        at = np.searchsorted(firsts, shard.first)
        base = np.repeat(shard.first[:-1], np.diff(at))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - base, long))
        return pa.table([table.column(1).combine_chunks(), pa.array(shard.counts, long), lists(firsts), lists(lasts), pa.array(shard.kept_texts(removed), blob).cast(pa.string())], names=list(kinds))

    probes = dealt.groupBy("shard").applyInArrow(send_probes, "bucket long, shard long, prints binary")
    answers = probes.groupBy("bucket").applyInArrow(answer_probes, "shard long, bucket long, live binary")
    windows = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(send_windows, "bucket long, shard long, prints binary, base long, ids binary")
    least = windows.groupBy("bucket").applyInArrow(answer_windows, "shard long, prints binary, base long, ids binary")
    out = dealt.groupBy("shard").cogroup(least.groupBy("shard")).applyInArrow(remove, "id long, n_words long, starts array<long>, ends array<long>, kept string")
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    return out.select(F.col("id").cast(dict(docs.dtypes)[doc_id]).alias(doc_id), "n_words", spans.alias("spans"), "kept")
