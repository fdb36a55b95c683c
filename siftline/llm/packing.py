"""Sum-of-squares packing of tokenised documents into sequences of a fixed size.

A document is the ids of its text and one end id; only documents longer than a sequence are cut. The
packer keeps the number of open sequences for each residual gap and places every piece where the sum
of their squares becomes smallest, a closed or a new sequence counting as no gap. Keeping the counts
low and even leaves a gap for most lengths that may come.

Pieces are dealt into shards of a bounded number and packed in shards, longer ones first.
A shard keeps the sequences that it has filled; the pieces of all others are dealt again, into far
fewer shards, until few are left, which are packed for good. What a shard leaves open does not
depend on how much it has packed, so the rounds are about as many as the digits of the input.

Tokens: no token of the vocabularies meant here crosses white space, nor the place between an ASCII
letter and one of ``.,;:!?``. The text is cut there and a worker remembers the ids of its chunks.
"""

from __future__ import annotations

import os
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import SPACED, Tables, Words, slices
from siftline.session import stage_table

SLICE = 2 << 20
SHARD_PIECES = 1 << 16
CLASSES = 16  # of length
LAST_PIECES = 1 << 12  # so few pieces are packed for good, in the better of two orders
CHUNKS_KEPT = 1 << 20  # chunks that one Python worker remembers
IDS_KEPT = 1 << 23
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True

_encoders = Tables()  # of this process


class Encoder:
    """Ids of whole texts, by chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids that end a word, where the vocabulary has such: a chunk of letters has one, its last.
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    @staticmethod
    def of(path: str) -> Encoder:
        """One for each worker process: what it has learned serves its later tasks."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _learn(self, prints: list[int], chunks: list[str]) -> None:
        """Remember the ids of unseen chunks."""
        plain = [i for i, c in enumerate(chunks) if c.isalpha()] if self.ends.any() else []
        sizes, found = np.zeros(len(chunks), np.int64), {}
        for lo in range(0, len(plain), 1000):
            group = plain[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([chunks[i] for i in group])], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.ends[ids]) + 1
            # Every chunk has one word at least; as many words as chunks, so each has one.
            if len(at) == len(group) and (not len(at) or at[-1] == len(ids)):
                sizes[group] = np.diff(np.concatenate(([0], at)))
                found[group[0]] = ids, group
        left = np.flatnonzero(sizes == 0).tolist()
        single = self.tokenizer.encode_batch_fast([chunks[i] for i in left], add_special_tokens=False)
        sizes[left] = [len(x.ids) for x in single]
        base, first = int(self.at[len(self.number)]), np.concatenate(([0], np.cumsum(sizes)))
        while base + first[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.number) + len(chunks) >= len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        for ids, group in found.values():
            own = sizes[group]
            self.ids[base + np.arange(len(ids)) + np.repeat(first[group] - (np.cumsum(own) - own), own)] = ids
        for i, x in zip(left, single):
            self.ids[base + first[i] : base + first[i + 1]] = x.ids
        k = len(self.number)
        self.at[k + 1 : k + 1 + len(chunks)] = base + first[1:]
        self.number.update(zip(prints, range(k, k + len(chunks))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one after another, and where each row begins."""
        words = Words(column, SPACED)
        data = words.data
        cut = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
        cut = cut[~np.isin(cut, words.rows)]
        words.starts, words.ends = np.sort(np.concatenate((words.starts, cut))), np.sort(np.concatenate((words.ends, cut)))
        chunk_at = np.searchsorted(words.starts, words.rows)
        if len(self.number) > CHUNKS_KEPT or self.at[len(self.number)] > IDS_KEPT:
            self._forget()
        prints, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        values = prints.tolist()
        spots = list(map(self.number.get, values))
        new = [i for i, s in enumerate(spots) if s is None]
        if new:
            raw = data.tobytes()
            begin, end = words.starts[first].tolist(), words.ends[first].tolist()
            self._learn([values[i] for i in new], [raw[begin[i] : end[i]].decode() for i in new])
            spots = list(map(self.number.get, values))
        chunk = np.array(spots, np.int64)[inverse]
        sizes = self.at[chunk + 1] - self.at[chunk]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[np.arange(int(begin[-1])) + np.repeat(self.at[chunk] - begin[:-1], sizes)], begin[chunk_at]


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and each bin's gap.

    Putting a piece into a gap changes the sum of squares by what the new gap's count adds and the old
    one's takes away; of equal changes the smallest gap is taken. Sizes are 1 to ``capacity``.
    """
    none = 1 << 60
    adds = np.ones(capacity + 1, np.int64)  # 2n + 1 for a gap with n open bins
    adds[0] = 0
    takes = np.full(capacity + 1, -none)  # 2n - 1; a new bin takes nothing
    takes[capacity] = 0
    open_bins: list[list[int]] = [[] for _ in range(capacity)]
    gaps: list[int] = []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        gap = int((adds[: capacity - size + 1] - takes[size:]).argmin()) + size
        if gap == capacity:
            own = len(gaps)
            gaps.append(capacity)
        else:
            own = open_bins[gap].pop()
            adds[gap] -= 2
            takes[gap] = takes[gap] - 2 if open_bins[gap] else -none
        where[i], offset[i] = own, capacity - gap
        gaps[own] = left = gap - size
        if left:
            takes[left] = 2 * len(open_bins[left]) + 1
            open_bins[left].append(own)
            adds[left] += 2
    return where, offset, np.array(gaps, np.int64)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, a row number, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    ``ids_crc32`` is taken over the ids as unsigned 32-bit little-endian numbers.
    """

    def cut(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for lo, hi in slices(batch.column(2), SLICE):
                part = batch.slice(lo, hi - lo)
                ids, at = encoder.encode(part.column(2))
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                counts = -(-np.diff(at) // size)
                row = np.repeat(np.arange(len(counts)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = at[row] + piece * size
                end = np.minimum(begin + size, at[row + 1])
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8))
                sums = [crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist())]
                columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(end - begin, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = dict(docs.dtypes)[doc_id]
    asked = docs.select(F.col(doc_id).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    return asked.mapInArrow(cut, f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def _packed(rest: DataFrame, level: int, shards: int, size: int) -> DataFrame:
    """Row, piece, sequence, offset and gap of each piece, packed in shards."""
    last = shards == 1

    def pack(table: pa.Table) -> pa.Table:
        row, piece, length, shard = (table.column(c).to_numpy() for c in ("_row", "piece", "length", "_shard"))
        # Longer pieces first, by rough classes; in a class the mixed order keeps the gaps apart.
        mixed = (piece, row, table.column("_mixed").to_numpy())
        orders = [np.lexsort((*mixed, -(length * CLASSES // size)))]
        if last and len(row) <= LAST_PIECES:
            orders.append(np.lexsort((*mixed, -length)))
        tries = [(order, *sum_of_squares(length[order].tolist(), size)) for order in orders]
        order, where, offset, gaps = min(tries, key=lambda t: len(t[3]))
        sequence = (level << 56) + (int(shard[0]) << 20) + where if len(row) else where
        names = ["_row", "piece", "length", "sequence_id", "offset", "gap"]
        return pa.table([pa.array(x) for x in (row[order], piece[order], length[order], sequence, offset, gaps[where])], names=names)

    mixed = F.xxhash64("_row", "piece", F.lit(level))
    dealt = rest.select("_row", "piece", "length", mixed.alias("_mixed"), F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInArrow(pack, "_row long, piece int, length long, sequence_id long, offset long, gap long")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and ``ids`` if asked.

    Offsets of a sequence are gapless from 0. Null and empty texts are the end id alone; repeated rows
    and rows without id are documents of their own; an empty table has no rows. Texts of any length
    are cut into pieces of ``size`` ids. Other columns are not looked at. Sequence numbers have gaps.
    """
    staged = stage_table(pieces(docs, tokenizer, doc_id, text, size, end_id, with_ids), "pieces")
    rest, left, level, places = staged, staged.count(), 0, None
    while True:
        shards = 1 + left // SHARD_PIECES
        packed = stage_table(_packed(rest, level, shards, size), "packed")
        again = packed.filter("gap > 0")
        count = again.count()
        # Pieces that fill no sequence are dealt again, as long as that makes them fewer by half.
        final = left <= LAST_PIECES or 2 * count > left or count == 0
        done = packed if final else packed.filter("gap = 0")
        places = done if places is None else places.unionByName(done)
        if final:
            break
        rest, left, level = again, count, level + 1
    found = staged.join(places.select("_row", "piece", "sequence_id", "offset"), ["_row", "piece"])
    return found.select(F.col("_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The training sequences of ``pack``: ``sequence_id``, ``ids``, and ``parts`` (id, piece, offset, length)."""
    part = F.struct("offset", "length", F.col(doc_id).alias("doc_id"), "piece", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return grouped.select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"),
    )
