"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

A word position starts a suffix of up to four words that ends with its piece. Suffixes are routed by
their leading words into ranges of suffix order: ranges are cut at sampled suffixes, so that a word
or a pair that starts a third of all suffixes fills many ranges. Map tasks add up equal suffixes and
send each range its share as one packed, sorted trie.

A range sorts pointers to its suffixes by three-way partition around a pivot, word after word. The
equal partition of a word is a phrase and its size the phrase's count; partitions of too few
occurrences hold no frequent phrase and are left unsorted. All partitions are split at once in each
round. Phrases that start like the suffix at either end of a range may go on in the next one: their
parts are counted apart and added up. No other phrase is in two ranges.

Words are 64-bit fingerprints of language and word; the texts of ranked phrases are looked up at the
end. Scores, and the removal of phrases inside longer ones, are joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.words import Words, mix, slices
from siftline.session import stage_table

WIDTH = 4  # words of the longest phrase
SLICE = 2 << 20
SHARD_BYTES = 4 << 20  # of text whose suffixes are added up in a map task
RANGE_BYTES = 6 << 20  # of text behind one range: about a million suffixes of 32 bytes
SAMPLE_ROWS, SAMPLE_WORDS = 1 / 16, 1000  # of the sampled rows one suffix in so many: some 64 a range
CUTS_BYTES = 256 << 20  # bound of the cut table, which is broadcast
_BREAKS = [*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]
INSIDE = np.ones(256, bool)
INSIDE[[0x20, 0x09, *_BREAKS]] = False
_BREAK = np.zeros(256, bool)
_BREAK[_BREAKS] = True
_U = np.uint64
_KEYS = [f"k{d}" for d in range(1, WIDTH + 1)]


class Suffixes:
    """Words of a slice of texts as keys, and the suffix that starts at each of them."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.words = words = Words(texts, INSIDE, lower=True)
        coded = pc.dictionary_encode(pc.fill_null(langs, "und"))
        self.names = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest()) for x in self.names], np.uint64)
        row = words.row_of()
        self.lang = codes[row] if len(row) else np.zeros(0, np.int64)
        own = mix(words.hashes() ^ seeds[self.lang]) if len(row) else np.zeros(0, np.uint64)
        own[own == 0] = 1  # 0 ends a suffix
        pieces = np.cumsum(_BREAK[words.data])[words.starts] if len(row) else row
        linked = np.zeros(len(row), bool)
        linked[:-1] = (row[1:] == row[:-1]) & (pieces[1:] == pieces[:-1])
        self.keys = np.zeros((WIDTH, len(row)), np.uint64)
        self.keys[0], going = own, np.ones(len(row), bool)
        for d in range(1, min(WIDTH, len(row))):
            going = going[:-1] & linked[d - 1 : len(row) - 1] if d > 1 else linked[:-1].copy()
            self.keys[d, : len(going)] = np.where(going, own[d:], 0)


def added_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes in order, and how often each occurs."""
    keys = keys[:, np.lexsort(keys[::-1])]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    begin = np.flatnonzero(new)
    return keys[:, begin], np.diff(np.append(begin, keys.shape[1]))


def places(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where each cut, a suffix, belongs among sorted suffixes."""
    low, high = np.searchsorted(keys[0], cuts[0], "left"), np.searchsorted(keys[0], cuts[0], "right")
    for c in np.flatnonzero(low < high):
        a, b = int(low[c]), int(high[c])
        for d in range(1, WIDTH):
            a, b = (a + int(np.searchsorted(keys[d, a:b], cuts[d, c], side)) for side in ("left", "right"))
        low[c] = a
    return low


def packed(keys: np.ndarray, weights: np.ndarray) -> tuple[bytes, ...]:
    """Sorted suffixes as a trie: the words of each depth that differ from the suffix before, and where."""
    new, marks, out = np.zeros(keys.shape[1], bool), [], []
    new[0] = True
    for d in range(WIDTH):
        new[1:] |= keys[d, 1:] != keys[d, :-1]
        marks.append(new.copy())
        out.append(keys[d, new].astype("<u8").tobytes())
    width = "<u1" if weights.max() < 256 else "<u8"
    return (*out, np.packbits(np.concatenate(marks)).tobytes(), weights.astype(width).tobytes())


def unpacked(n: int, blobs: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    *words, marks, weights = blobs
    new = np.unpackbits(np.frombuffer(marks, np.uint8), count=n * WIDTH).reshape(WIDTH, n)
    keys = np.stack([np.frombuffer(w, "<u8")[np.cumsum(new[d]) - 1] for d, w in enumerate(words)])
    return keys, np.frombuffer(weights, "<u1" if len(weights) == n else "<u8").astype(np.int64)


def frequent(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A suffix, the number of leading words and the count of every phrase of at least ``least`` occurrences."""
    n = keys.shape[1]
    flat = keys.ravel()
    pointers, begin, depth = np.arange(n), np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(pointers):
        sizes = np.diff(np.append(begin, len(pointers)))
        own = np.repeat(np.arange(len(begin)), sizes)
        key = flat[(depth * n)[own] + pointers]
        a, b, c = key[begin], key[begin + sizes // 2], key[begin + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[own]
        parts = []
        for side in (key < pivot, key == pivot, key > pivot):
            # The members of a side are still in the order of their partitions.
            at = np.flatnonzero(side)
            of = own[at]
            first = np.flatnonzero(np.concatenate((np.ones(min(len(of), 1), bool), of[1:] != of[:-1])))
            if not len(first):
                continue
            total = np.add.reduceat(weights[pointers[at]], first)
            deep = depth[of[first]]
            members, lengths = pointers[at], np.diff(np.append(first, len(at)))
            alive = total >= least
            if side[at[0]] and key[at[0]] == pivot[at[0]]:
                out.append((members[first[alive]], deep[alive] + 1, total[alive]))
                deep = deep + 1
                alive &= deep < WIDTH
                keep = np.repeat(alive, lengths)
                members, group = members[keep], np.repeat(np.arange(len(first)), lengths)[keep]
                going = flat[deep[group] * n + members] != 0  # the others end here
                members, group = members[going], group[going]
                first = np.flatnonzero(np.concatenate((np.ones(min(len(group), 1), bool), group[1:] != group[:-1])))
                parts.append((members, first, deep[group[first]]))
            else:
                members = members[np.repeat(alive, lengths)]
                parts.append((members, np.cumsum(lengths[alive]) - lengths[alive], deep[alive]))
        pointers = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *[len(p[0]) for p in parts]])
        begin = np.concatenate([p[1] + s for p, s in zip(parts, shift)])
        depth = np.concatenate([p[2] for p in parts])
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _cuts(docs: DataFrame, ranges: int) -> np.ndarray:
    """Suffixes at which the ranges are cut: quantiles of a sample, 64 suffixes a range on the driver."""
    if ranges == 1:
        return np.zeros((WIDTH, 0), np.uint64)
    if ranges * 8 * WIDTH > CUTS_BYTES:
        raise ValueError("too many ranges: choose larger ones by range_bytes")

    def some(batches):
        seen = 0
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE):
                keys = Suffixes(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)).keys
                own = keys[:, (-seen) % SAMPLE_WORDS :: SAMPLE_WORDS]
                seen += keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)) for k in own], names=_KEYS)

    found = docs.sample(SAMPLE_ROWS, 7).mapInArrow(some, ", ".join(f"{k} long" for k in _KEYS)).collect()
    sample = np.array([tuple(r) for r in found], np.int64).reshape(-1, WIDTH).T.view(np.uint64)
    sample = sample[:, np.lexsort(sample[::-1])]
    cuts = sample[:, np.arange(1, ranges) * sample.shape[1] // ranges] if sample.shape[1] else sample
    return added_up(cuts)[0]


def phrase_counts(docs: DataFrame, text: str, lang: str, least: int, range_bytes: int) -> DataFrame:
    """``lang``, the keys and ``f`` of all frequent phrases of up to four words; without keys, all words of a language."""
    asked = docs.select(F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    ranges = 1 + total // range_bytes
    cuts = _cuts(asked, ranges)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)
    names = ["range", "lang", "n", *_KEYS, "marks", "weights"]

    def send(batches):
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            rows = []
            while waiting:
                name, found = waiting.popitem()
                keys, weights = added_up(np.concatenate(found, axis=1))
                at = [0, *places(keys, shared.value).tolist(), keys.shape[1]]
                rows += [(r, name, b - a, *packed(keys[:, a:b], weights[a:b])) for r, (a, b) in enumerate(zip(at, at[1:])) if a < b]
            kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * (WIDTH + 2)]
            for lo in range(0, len(rows), 100):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 100]), kinds)], names=names)

        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE):
                own = Suffixes(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
                for code, name in enumerate(own.names):
                    mine = own.keys[:, own.lang == code]
                    if mine.shape[1]:
                        waiting.setdefault(name, []).append(mine)
                size += len(own.words.data)
                if size >= SHARD_BYTES:
                    yield from shard()
                    size = 0
        yield from shard()

    def count(table: pa.Table) -> pa.Table:
        cuts, which = shared.value, table.column("range")[0].as_py()
        kinds = {"lang": pa.string(), **{k: pa.int64() for k in _KEYS}, "f": pa.int64(), "part": pa.bool_()}
        names = sorted(set(table.column("lang").to_pylist()))
        parts = [unpacked(n, blobs) for n, *blobs in zip(*[table.column(c).to_pylist() for c in ("n", *_KEYS, "marks", "weights")])]
        code = np.repeat([names.index(x) for x in table.column("lang").to_pylist()], [len(w) for _, w in parts])
        keys, weights = np.concatenate([k for k, _ in parts], axis=1), np.concatenate([w for _, w in parts])
        del parts
        member, depth, total = frequent(keys, weights, least)
        phrase = keys[:, member] * (np.arange(WIDTH)[:, None] < depth)
        part = np.zeros(len(member), bool)
        # Phrases at the ends of the range are added up over ranges, with all that the range has of them.
        ends = []
        for cut in {tuple(cuts[:, c].tolist()) for c in (which - 1, which) if 0 <= c < cuts.shape[1]}:
            for d in range(1, WIDTH + 1):
                start = tuple(cut[:d]) + (0,) * (WIDTH - d)
                if cut[d - 1] and start not in ends:
                    ends.append(start)
        rows = []
        for start in ends:
            d = sum(x > 0 for x in start)
            inside = np.flatnonzero((keys[:d] == np.array(start[:d], np.uint64)[:, None]).all(axis=0))
            part |= (phrase == np.array(start, np.uint64)[:, None]).all(axis=0)
            if len(inside):
                rows.append((code[inside[0]], start, int(weights[inside].sum())))
        rows += [(c, (0,) * WIDTH, int(weights[code == c].sum())) for c in range(len(names))]
        apart = np.array([r[1] for r in rows], np.uint64).reshape(-1, WIDTH).T
        lang = np.concatenate((code[member[~part]], [r[0] for r in rows])).astype(np.int64)
        columns = [pa.array(np.concatenate((phrase[d, ~part], apart[d])).view(np.int64)) for d in range(WIDTH)]
        flags = np.concatenate((np.zeros(int((~part).sum()), bool), np.ones(len(rows), bool)))
        return pa.table([pa.array(names).take(pa.array(lang)), *columns, pa.array(np.concatenate((total[~part], [r[2] for r in rows])).astype(np.int64)), pa.array(flags)], names=list(kinds))

    longs = ", ".join(f"{k} long" for k in _KEYS)
    sent = asked.mapInArrow(send, "range long, lang string, n long, " + ", ".join(f"{k} binary" for k in _KEYS) + ", marks binary, weights binary")
    # As many partitions as ranges, so that a task's share doesn't grow with the input.
    found = stage_table(sent.repartition(ranges, "range").groupBy("range").applyInArrow(count, f"lang string, {longs}, f long, part boolean"), "phrases")
    ends = found.filter("part").groupBy("lang", *_KEYS).agg(F.sum("f").alias("f"))  # at most some eight rows a range
    return found.filter("NOT part").drop("part").unionByName(ends.filter((F.col("f") >= least) | (F.col("k1") == 0)))


def _texts(docs: DataFrame, needed: DataFrame, text: str, lang: str) -> DataFrame:
    """``key`` and ``word`` of the needed keys."""

    def words(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE):
                own = Suffixes(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
                keys, first = np.unique(own.keys[0], return_index=True)
                raw = own.words.data.tobytes()
                texts = [raw[a:b] for a, b in zip(own.words.starts[first].tolist(), own.words.ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "word"])

    asked = docs.select(F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"))
    return asked.mapInArrow(words, "key long, word string").join(needed, "key", "left_semi").groupBy("key").agg(F.min("word").alias("word"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's best phrases.

    A candidate has two to four words and occurs ``a >= least`` times; its lowest-scoring cut gives
    ``l``, ``r`` and ``score``. Candidates inside a longer one that occurs at least 0.8 times as often
    are left out. Ranks go by score, ``a`` and phrase. Null and empty texts have no words, a null
    language is ``und``; repeated rows count each for itself; texts of any length are whole; other
    columns are not looked at; no frequent phrase, no rows. A rank's ties are settled by the phrase,
    so all phrases that tie with the last rank are looked up.
    """
    counts = stage_table(phrase_counts(docs, text, lang, least, range_bytes), "counts")
    n = counts.filter("k1 = 0").select("lang", F.col("f").alias("n"))
    phrase = counts.filter("k1 != 0").select("lang", F.filter(F.array(*_KEYS), lambda k: k != 0).alias("p"), "f")
    known = phrase.select("lang", "p", "f")
    found = phrase.filter(F.size("p") > 1)
    # A word that starts or ends many phrases is a hot key here; adaptive execution splits it.
    cut = found.select("lang", "p", "f", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("p", F.lit(1), F.col("k")), "tail": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    cut = cut.join(known.select("lang", F.col("p").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("p").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(CAST(2000000 AS DECIMAL(18, 0)) * CAST(f AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = cut.groupBy("lang", "p", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = found.filter(F.size("p") > 2).select("lang", "f", "p", F.explode(F.sequence(F.lit(2), F.size("p") - 1)).alias("w"))
    inner = inner.select("lang", "f", "p", "w", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("w") + 1)).alias("i"))
    longer = inner.groupBy("lang", F.expr("slice(p, i, w)").alias("p")).agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "p"], "left").filter(F.coalesce(5 * F.col("longer").cast("decimal(20,0)") < 4 * F.col("f").cast("decimal(20,0)"), F.lit(True)))
    order = [F.desc("best.score"), F.desc("f")]
    near = kept.withColumn("_near", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_near") <= top)
    near = stage_table(near.select("lang", "p", "f", "best"), "near")
    words = near.select("lang", "p", F.posexplode("p").alias("i", "key"))
    named = words.join(_texts(docs, words.select("key").distinct(), text, lang), "key").groupBy("lang", "p").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))  # four at most
    full = near.join(named, ["lang", "p"]).withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"]), " "))
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", F.col("best.score").cast("long").alias("score"))
