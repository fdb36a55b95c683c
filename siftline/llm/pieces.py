"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of pieces. Forward Viterbi costs are the exact rest costs of a backward A-star
search, which therefore takes the best paths off its heap in order and expands little else. No piece
crosses certain places (before a run of spaces, between letters and most signs), which are read from
the vocabulary; the lattice falls apart there, each part is searched by itself and remembered, and
the N best paths of a text are the N cheapest choices over its parts.

A model of unigram kind gives log probabilities; one of BPE kind gives merge ranks, taken as Zipf
probabilities. Costs are integers (millionths of a nat), so sums and ties are exact. Characters
beyond the vocabulary become byte pieces.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import Tables, Words, slices, sums_by_row, text_bytes

UNIT = 1_000_000
UNKNOWN = 10 * UNIT  # beyond the dearest piece
NEVER = 1 << 60  # the cost of a path that is none
PARTS_KEPT = 1_000_000  # parts that one Python worker remembers
LONGEST, BLOCK = 40, 1 << 14  # parts of so many letters, so many at once, take the forward pass in arrays
_LETTER, _SLOTS = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
LISTS_KEPT = 50_000  # and parts whose n cheapest paths it remembers
_encoders = Tables()  # of this process
_ANY = np.ones(256, bool)


@dataclass
class Vocabulary:
    """Pieces by id, with costs; spaces stand for the piece alphabet's own space sign."""

    texts: list[bytes]
    known: dict[str, tuple[int, int] | None]  # piece: (id, cost); a mere prefix of pieces: None
    byte_ids: list[int]
    byte_cost: int
    parts: str

    def plain(self) -> tuple:
        """The fields, to be shipped without their class."""
        return tuple(vars(self).values())

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace("▁", " "): i for i in plain}
        scores = {i: model.get_score(i) for i in plain}
        if all(s == round(s) and s <= 0 for s in scores.values()):  # merge ranks
            norm = log(sum(1 / (1 - s) for s in scores.values() if s > -1e8))
            scores = {i: -(log(1 - s) + norm) for i, s in scores.items()}
        known: dict[str, tuple[int, int] | None] = {}
        for piece, i in pieces.items():
            for n in range(1, len(piece)):
                known.setdefault(piece[:n], None)
            known[piece] = (i, round(-scores[i] * UNIT))
        dearest = max(x[1] for x in known.values() if x)
        texts = [b""] * len(ids)
        for piece, i in pieces.items():
            texts[i] = piece.encode()
        byte_ids = [0] * 256
        for i in ids:
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                texts[i], byte_ids[value] = bytes([value]), i
        return Vocabulary(texts, known, byte_ids, dearest + UNKNOWN, Vocabulary._parts(pieces))

    @staticmethod
    def _parts(pieces) -> str:
        """A pattern of text parts that no piece crosses."""
        if any(" " in p.lstrip(" ") for p in pieces):
            return r"(?s:.+)"
        pairs = {(x, y) for p in pieces for x, y in zip(p, p[1:])}
        if any(not x.isalnum() and x != " " and y.isalnum() for x, y in pairs):
            return r" *[^ ]+| +"
        glue = "".join(re.escape(y) for y in sorted({y for x, y in pairs if x.isalnum() and not y.isalnum()}))
        tail = f"(?:[{glue}](?:[^\\w ]|_)*)?" if glue else ""
        return f" *(?:[^\\W_]+{tail}|(?:[^\\w ]|_)+)| +"

    def lattice(self, part: str) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
        """Edges into each place (start, cost, piece or -1 for bytes), and the cheapest cost up to it."""
        n, find = len(part), self.known.get
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        best = [0] + [NEVER] * n
        for i in range(n):
            here = best[i]
            if not find(part[i]):
                into[i + 1].append((i, self.byte_cost, -1))
                if here + self.byte_cost < best[i + 1]:
                    best[i + 1] = here + self.byte_cost
            for j in range(i + 1, n + 1):
                entry = find(part[i:j], 0)
                if entry:
                    piece, cost = entry
                    into[j].append((i, cost, piece))
                    if here + cost < best[j]:
                        best[j] = here + cost
                elif entry == 0:
                    break
        return into, best

    def best_two(self, part: str) -> tuple[list[int], int, int]:
        """The cheapest ids of a part, their cost, and the cost of the next path (or a huge number).

        One forward pass carries the two cheapest costs up to each place. Of equally cheap paths the one
        with the smallest ids counts as the best.
        """
        n, find = len(part), self.known.get
        first, second = [0] + [NEVER] * n, [NEVER] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)

        def settle(i: int, piece: int, j: int, x: int, y: int) -> None:
            """An edge over which the two cheapest costs up to ``j`` are x and y."""
            old = first[j]
            if x < old:
                first[j], second[j], back[j] = x, min(old, y), (i, piece)
            else:
                if x < second[j]:
                    second[j] = x
                if x == old and self._path(part, i, back) + self._ids(part, i, piece) < self._path(part, j, back):
                    back[j] = i, piece

        for i in range(n):
            here, after = first[i], second[i]
            if not find(part[i]):
                settle(i, -1, i + 1, here + self.byte_cost, after + self.byte_cost)
            for j in range(i + 1, n + 1):
                entry = find(part[i:j], 0)
                if entry:
                    settle(i, entry[0], j, here + entry[1], after + entry[1])
                elif entry == 0:
                    break
        return self._path(part, n, back), first[n], min(second[n], NEVER)

    def _ids(self, part: str, start: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.byte_ids[b] for b in part[start].encode()]

    def _path(self, part: str, place: int, back: list[tuple[int, int]]) -> list[int]:
        steps = []
        while place:
            steps.append(back[place])
            place = back[place][0]
        return [x for start, piece in reversed(steps) for x in self._ids(part, start, piece)]

    def n_best(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` cheapest (cost, ids) of a part by (cost, ids), searched from the end backwards.

        The heap gives whole paths in the order of their costs; those as dear as the n-th are all taken,
        then ordered by their ids.
        """
        into, best = self.lattice(part)
        out: list[tuple[int, tuple[int, ...]]] = []
        order = itertools.count()
        heap = [(best[-1], len(part), 0, 0, None)]  # whole cost, place, tie, cost from here on, path
        while heap and (len(out) < n or heap[0][0] == out[n - 1][0]):
            whole, place, _, rest, path = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while path is not None:
                    (piece, start), path = path
                    ids += self._ids(part, start, piece)
                out.append((whole, tuple(ids)))
                continue
            for start, cost, piece in into[place]:
                heapq.heappush(heap, (best[start] + cost + rest, start, next(order), cost + rest, ((piece, start), path)))
        return sorted(out)[:n]


class PieceTable:
    """Pieces by 64-bit fingerprints of their letters: the forward pass for many parts of one length at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_cost = vocabulary.byte_cost
        pieces = [(p, *x) for p, x in vocabulary.known.items() if x]
        self.longest = max(len(p) for p, *_ in pieces)
        prints = np.array([self._print(p) for p, *_ in pieces], np.uint64)
        self.ids, self.costs = np.array([x[1] for x in pieces], np.int64), np.array([x[2] for x in pieces], np.int64)
        # Two tables of slots: each piece is in one of its two, so a look-up reads four numbers.
        bits = max(8, int(len(pieces)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        slots = [x.tolist() for x in self._slots(prints)]
        held = [-1] * (1 << bits), [-1] * (1 << bits)
        for new in range(len(pieces)):
            item, side = new, 0
            for _ in range(500):
                at = slots[side][item]
                item, held[side][at] = held[side][at], item
                if item < 0:
                    break
                side = 1 - side
            else:
                raise ValueError("the pieces fit into no table")
        self.held = [np.array(h, np.int64) for h in held]
        self.keys = [np.where(h >= 0, prints[h], 0) for h in self.held]  # no piece has the fingerprint 0

    def _slots(self, prints: np.ndarray) -> list[np.ndarray]:
        return [(prints * np.uint64(m)) >> self.shift for m in _SLOTS]

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each fingerprint among the pieces, and whether it is one."""
        one, two = self._slots(prints)
        first = (self.keys[0][one] == prints) & (prints != 0)
        return np.where(first, self.held[0][one], self.held[1][two]), first | ((self.keys[1][two] == prints) & (prints != 0))

    @staticmethod
    def _print(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _LETTER + ord(c) + 1) % (1 << 64)
        return h

    def two_cheapest(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Best ids (padded), their numbers, the two cheapest costs, and whether these are settled.

        Not settled: equal costs on the way, or a letter that becomes bytes.
        """
        n, length = len(parts), len(parts[0])
        letters = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T.astype(np.uint64) + np.uint64(1)
        first, second = np.full((length + 1, n), NEVER), np.full((length + 1, n), NEVER)
        first[0] = 0
        from_, piece = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int64)
        sure = np.ones(n, bool)
        for i in range(length):
            prints = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                prints = prints * np.uint64(_LETTER) + letters[j - 1]
                spot, hit = self.find(prints)
                cost, own = self.costs[spot], self.ids[spot]
                if j == i + 1:
                    cost, own = np.where(hit, cost, self.byte_cost), np.where(hit, own, -1)
                    hit = np.ones(n, bool)
                elif not hit.any():
                    continue
                x, y, old = np.where(hit, first[i] + cost, NEVER), second[i] + cost, first[j]
                better = x < old
                sure &= ~hit | (x != old)
                second[j] = np.where(better, np.minimum(old, y), np.minimum(second[j], x))
                first[j] = np.where(better, x, old)
                from_[j][better], piece[j][better] = i, own[better]
        ids, counts = np.zeros((n, length), np.int32), np.zeros(n, np.int64)
        place, rows = np.full(n, length), np.arange(n)
        while (place > 0).any():
            going = place > 0
            here, at = rows[going], place[going]
            own = piece[at, here]
            sure[here[own < 0]] = False
            ids[here, counts[here]] = own
            counts[here] += 1
            place[here] = from_[at, here]
        back = np.arange(length)[None, :]
        turned = np.take_along_axis(ids, np.maximum(counts[:, None] - 1 - back, 0), axis=1)
        return turned, counts, first[length], np.minimum(second[length], NEVER), sure


def _gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values``, one after another, and where each begins."""
    sizes = at[which + 1] - at[which]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    return values[np.arange(int(begin[-1])) + np.repeat(at[which] - begin[:-1], sizes)], begin


class Encoder:
    """Segments columns of texts; remembers the parts it has seen."""

    @staticmethod
    def of(key: tuple, plain: tuple, n: int) -> Encoder:
        """One for each model and worker process: what it has learned serves its later tasks."""
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(Vocabulary(*plain), n)
        return _encoders[key]

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n, self.table = vocabulary, n, PieceTable(vocabulary)
        self.split = re.compile(vocabulary.parts).findall
        self.cuts = vocabulary.parts.startswith(" *")
        sizes = np.array([len(t) for t in vocabulary.texts])
        self.piece_at = np.concatenate(([0], np.cumsum(sizes)))
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.chunks: dict[int, int] = {}
        self.chunk_parts, self.chunk_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.lists: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        self.ids, self.at, self.cost, self.next = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Remember the best ids and the two cheapest costs of unseen parts."""
        by_length: dict[int, list[str]] = {}
        for part in new:
            by_length.setdefault(len(part), []).append(part)
        names: list[str] = []
        ids, sizes, costs, after = [], [], [], []
        for length, group in by_length.items():
            for lo in range(0, len(group), BLOCK):
                block = group[lo : lo + BLOCK]
                if length <= LONGEST:
                    own, counts, first, second, sure = self.table.two_cheapest(block)
                    names += [block[i] for i in np.flatnonzero(sure).tolist()]
                    ids.append(own[sure][np.arange(length) < counts[sure, None]])
                    sizes.append(counts[sure])
                    costs.append(first[sure])
                    after.append(second[sure])
                    block = [block[i] for i in np.flatnonzero(~sure).tolist()]
                found = [self.vocabulary.best_two(part) for part in block]
                names += block
                ids.append(np.array([x for f in found for x in f[0]], np.int32))
                for out, values in ((sizes, [len(f[0]) for f in found]), (costs, [f[1] for f in found]), (after, [f[2] for f in found])):
                    out.append(np.array(values, np.int64))
        k, flat, cost, second = len(self.number), np.concatenate(ids), np.concatenate(costs), np.concatenate(after)
        ends = int(self.at[k]) + np.cumsum(np.concatenate(sizes))
        while k + len(names) >= len(self.at):
            self.at, self.cost, self.next = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.cost, self.next))
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.at[k] : ends[-1]] = flat
        self.at[k + 1 : k + 1 + len(names)] = ends
        self.cost[k : k + len(names)] = cost
        self.next[k : k + len(names)] = np.where(second < NEVER, second - cost, NEVER)
        self.number.update(zip(names, range(k, k + len(names))))
        self.names += names

    def _numbers(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Part numbers of texts, one after another, and how many each has."""
        own = [self.split(text) for text in texts]
        flat = list(itertools.chain.from_iterable(own))
        new = [p for p in dict.fromkeys(flat) if p not in self.number]
        if new:
            self._learn(new)
        return list(map(self.number.__getitem__, flat)), list(map(len, own))

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Part numbers of all texts, and where each text's parts begin.

        Where parts don't go over the start of a run of spaces, a text is cut there and the parts of each
        distinct chunk are remembered.
        """
        if len(self.number) > PARTS_KEPT or len(self.chunks) > PARTS_KEPT:
            self._forget()
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        if not self.cuts:
            flat, counts = self._numbers(texts.to_pylist())
            return np.array(flat, np.int64), np.cumsum([0, *counts])
        words = Words(texts, _ANY)
        space = words.data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[words.rows[:-1][np.diff(words.rows) > 0]] = True
        words.starts = np.flatnonzero(begins)
        words.ends = np.append(words.starts[1:], len(words.data))[: len(words.starts)]
        chunk_at = np.searchsorted(words.starts, words.rows)
        prints, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        values = prints.tolist()
        spots = list(map(self.chunks.get, values))
        new = [i for i, s in enumerate(spots) if s is None]
        if new:
            raw, begin, end = words.data.tobytes(), words.starts[first].tolist(), words.ends[first].tolist()
            flat, counts = self._numbers([raw[begin[i] : end[i]].decode() for i in new])
            k = len(self.chunks)
            ends = int(self.chunk_at[k]) + np.cumsum(counts)
            while k + len(new) >= len(self.chunk_at):
                self.chunk_at = np.concatenate((self.chunk_at, np.zeros_like(self.chunk_at)))
            while ends[-1] > len(self.chunk_parts):
                self.chunk_parts = np.concatenate((self.chunk_parts, np.zeros_like(self.chunk_parts)))
            self.chunk_parts[self.chunk_at[k] : ends[-1]] = flat
            self.chunk_at[k + 1 : k + 1 + len(new)] = ends
            self.chunks.update(zip([values[i] for i in new], range(k, k + len(new))))
            spots = list(map(self.chunks.get, values))
        chunk = np.array(spots, np.int64)[inverse]
        parts, begin = _gathered(self.chunk_parts, self.chunk_at, chunk)
        return parts, begin[chunk_at]

    def gather(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best ids of the parts, one after another, and where each part begins."""
        return _gathered(self.ids, self.at, parts)

    def _list(self, part: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n cheapest paths of a part, searched once."""
        name = self.names[part]
        if name not in self.lists:
            if len(self.lists) > LISTS_KEPT:
                self.lists.clear()
            self.lists[name] = self.vocabulary.n_best(name, self.n)
        return self.lists[name]

    def choices(self, parts: np.ndarray) -> list[tuple[int, dict[int, tuple[int, ...]]]]:
        """The n cheapest (cost, ids of the parts that differ from their best) of one text."""
        base = int(self.cost[parts].sum())
        m = min(self.n - 1, len(parts))
        if not m:
            return [(base, {})]
        # Only the n - 1 parts with the nearest second choice can differ in one of the n best; of parts
        # with equally near ones the first are taken.
        change = self.next[parts]
        near = np.flatnonzero(change <= np.partition(change, m - 1)[m - 1])
        near = sorted(near[np.argsort(change[near], kind="stable")][:m].tolist())
        # Part by part, the n cheapest sums so far; sums of equal cost go by their ids.
        sums: list[tuple[int, tuple]] = [(0, ())]
        for p in near:
            if change[p] < NEVER:
                own = self._list(int(parts[p]))
                sums = heapq.nsmallest(self.n, [(cost + x[0] - own[0][0], (*picks, (p, x[1], x is own[0]))) for cost, picks in sums for x in own])
        return [(base + extra, {p: ids for p, ids, same in picks if not same}) for extra, picks in sums]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the pieces, one after another, and where each piece's bytes begin."""
        return _gathered(self.piece_bytes, self.piece_at, ids)


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """Id, ``ids`` (best pieces), ``n_best`` (cost in nats, ids, SHA-256 of the ids) and ``round_trip``.

    Each segmentation has all its ids; its digest is that of the ids as 32-bit little-endian numbers.
    Null and empty texts have no pieces and one segmentation of cost 0. Texts with fewer than ``n``
    segmentations list all. Paths of equal cost are different segmentations: in a part of a text the
    smaller ids come first, of equally near changes those in earlier parts. ``round_trip``: decoding the ids gives back the text byte by byte.
    """
    vocabulary = Vocabulary.load(model_path)
    key = sha256(repr((vocabulary.texts, vocabulary.byte_cost, vocabulary.parts, sorted(vocabulary.known.items(), key=str))).encode()).hexdigest(), n
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())  # bounded by the model file

    def segment(batches):
        encoder = Encoder.of(key, shared.value, n)
        for batch in batches:
            for lo, hi in slices(batch.column(1), 2 << 20):
                part = batch.slice(lo, hi - lo)
                yield _segmented(encoder, part)

    kind = dict(docs.dtypes)[doc_id]
    asked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = asked.mapInArrow(segment, f"_id {kind}, ids array<int>, n_best array<struct<cost:double,ids:array<int>,ids_sha256:string>>, round_trip boolean")
    return found.withColumnRenamed("_id", doc_id)


def _segmented(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
    parts, at = encoder.parts(batch.column(1))
    ids, begin = encoder.gather(parts)
    doc_at = begin[at]
    back, piece_at = encoder.decoded(ids)
    data, rows = text_bytes(batch.column(1))
    lead = (np.diff(rows) > 0).astype(np.int64)  # the space put before a text
    sizes = np.diff(piece_at[doc_at]) - lead
    same = sizes == np.diff(rows)
    # The bytes of the rows whose lengths agree; no other row keeps them from being compared.
    keep = np.repeat(same, np.diff(piece_at[doc_at]))
    keep[piece_at[doc_at[:-1]][same & (lead > 0)]] = False
    differ, asked = np.zeros(len(data), bool), np.repeat(same, np.diff(rows))
    differ[asked] = back[keep] != data[asked]
    same &= sums_by_row(differ, rows) == 0
    costs, digests, chosen, list_at = [], [], [], [0]
    for d in range(len(at) - 1):
        own = parts[at[d] : at[d + 1]]
        for cost, changed in encoder.choices(own):
            pieces, last = [], int(doc_at[d])
            for p in sorted(changed):
                pieces += [ids[last : begin[at[d] + p]], np.array(changed[p], np.int32)]
                last = int(begin[at[d] + p + 1])
            pieces.append(ids[last : doc_at[d + 1]])
            costs.append(cost / UNIT)
            chosen.append(np.concatenate(pieces))
            digests.append(sha256(chosen[-1].astype("<i4").tobytes()).hexdigest())
        list_at.append(len(costs))
    paths = _int_lists(np.concatenate((*chosen, ids[:0])), np.cumsum([0, *map(len, chosen)]))
    choices = pa.StructArray.from_arrays([pa.array(costs, pa.float64()), paths, pa.array(digests, pa.string())], names=["cost", "ids", "ids_sha256"])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), _int_lists(ids, doc_at), pa.ListArray.from_arrays(pa.array(list_at, pa.int32()), choices), pa.array(same)],
        names=["_id", "ids", "n_best", "round_trip"],
    )


def _int_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def decode(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Id and ``text`` of each row of piece ids; null and empty ids give the empty text.

    Rows of ``F.inline("n_best")`` beside their id give the text of each segmentation.

    Bytes that are no UTF-8 become U+FFFD; control pieces give no text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path).texts)

    def join(batches) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        for batch in batches:
            rows = [b"".join([texts[i] for i in row or ()]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.removeprefix(b" ").decode(errors="replace") for r in rows], pa.string())], names=["_id", "text"])

    kind = dict(encoded.dtypes)[doc_id]
    out = encoded.select(F.col(doc_id).alias("_id"), F.col(ids).alias("_ids")).mapInArrow(join, f"_id {kind}, text string")
    return out.withColumnRenamed("_id", doc_id)
