"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A three-letter gram binds
(multiplies) the vectors of its letters, each rotated by its place; a text bundles (adds) its grams,
and a language bundles the texts it was learned from. A text takes the language with the closest
prototype by cosine. Case is folded; whatever is no letter is one gap, a symbol of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import Tables, mix, slices, text_bytes

DIMENSIONS = 1024
GRAM = 3
MAX_LANGUAGES = 4096  # prototypes are broadcast: at most this many times 8 kB
UNDECIDED = "und"
CELLS, BLOCK, ROWS = 1 << 24, 4096, 8192  # of a dense table of counts; grams, and rows, taken at once
_GAP = 0x20
_tables = Tables()


def _fold() -> np.ndarray:
    """Code point to folded letter, or to the gap."""
    if "fold" not in _tables:
        table = np.full(0x110000, _GAP, np.int32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _tables["fold"] = table
    return _tables["fold"]


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mix(mix(symbols.astype(np.uint64) + np.uint64(1))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(letters: np.ndarray) -> np.ndarray:
    """Rows of letters of one gram each, bound into float vectors."""
    symbols, own = np.unique(letters, return_inverse=True)
    base = letter_vectors(symbols)
    own = own.reshape(letters.shape)
    out = np.ones((len(letters), DIMENSIONS), np.int8)
    for place in range(letters.shape[1]):
        out *= np.roll(base, letters.shape[1] - 1 - place, axis=1)[own[:, place]]
    return out.astype(np.float32)


def gram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram number, count) of the distinct grams of each text, and the letters of the grams.

    Every text is set between gaps, so one with a letter has a gram; one without letters has none.
    """
    data, offsets = text_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[offsets]
    n = len(offsets) - 1
    # A gap before every text, and one at the end of all.
    symbols = np.full(len(codes) + n + 1, _GAP, np.int32)
    rows = np.repeat(np.arange(n), np.diff(at))
    symbols[np.arange(len(codes)) + rows + 1] = _fold()[codes]
    row = np.concatenate((np.repeat(np.arange(n), np.diff(at) + 1), [n]))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != _GAP) | (symbols[:-1] != _GAP)
    symbols, row = symbols[keep], row[keep]
    if len(symbols) < GRAM:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, np.zeros((0, GRAM), np.int32)
    present = np.flatnonzero(np.bincount(symbols))
    dense = np.searchsorted(present, symbols)
    size = len(present)
    code = (dense[:-2] * size + dense[1:-1]) * size + dense[2:]
    # The row of a gram is that of its middle letter; a gap in the middle belongs to the text before it.
    middle, gap = row[1:-1], symbols[1:-1] == _GAP
    middle = np.where(gap, row[:-2], middle)
    inside = ~gap | (row[2:] == row[:-2])
    key = np.sort(middle[inside].astype(np.int64) * size**GRAM + code[inside])
    new = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    grams = key % size**GRAM
    distinct = np.flatnonzero(np.bincount(grams, minlength=1)) if size**GRAM <= 1 << 24 else np.unique(grams)
    letters = present[np.stack((distinct // size**2, distinct // size % size, distinct % size), axis=1)]
    return key // size**GRAM, np.searchsorted(distinct, grams), counts, letters


def bundled(column: pa.Array, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Vectors of groups of texts; ``group`` is the group of each row.

    Few groups with many grams in common take one dense product; else the counts are taken as they are,
    in blocks of grams, so memory follows the number of counts. Sums are whole numbers, and equal.
    """
    row, gram, count, letters = gram_counts(column)
    out = np.zeros((n_groups, DIMENSIONS), np.float32)
    if not len(letters):
        return out
    own = group[row]
    if n_groups * len(letters) <= CELLS:
        table = np.bincount(own * len(letters) + gram, count, n_groups * len(letters)).astype(np.float32)
        return table.reshape(n_groups, len(letters)) @ gram_vectors(letters)
    order = np.lexsort((own, gram // BLOCK))
    own, gram, count = own[order], gram[order], count[order].astype(np.float32)
    edges = np.searchsorted(gram // BLOCK, np.arange(-(-len(letters) // BLOCK) + 1))
    for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        vectors = gram_vectors(letters[b * BLOCK : (b + 1) * BLOCK])
        for x in range(lo, hi, BLOCK):
            part = slice(x, min(x + BLOCK, hi))
            first = np.flatnonzero(np.concatenate(([True], own[part][1:] != own[part][:-1])))
            out[own[part][first]] += np.add.reduceat(vectors[gram[part] - b * BLOCK] * count[part, None], first, axis=0)
    return out


def _parts(column: pa.Array):
    """Slices of about 1 MB and at most ``ROWS`` rows."""
    for lo, hi in slices(column, 1 << 20):
        for x in range(lo, hi, ROWS):
            yield x, min(x + ROWS, hi)


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, vector) of every language that has a text; rows without either teach nothing."""
    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            for lo, hi in _parts(batch.column(1)):
                table = bundled(batch.column(1).slice(lo, hi - lo), np.asarray(names.indices)[lo:hi].astype(np.int64), len(names.dictionary))
                for name, vector in zip(names.dictionary.to_pylist(), table):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    asked = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = asked.mapInArrow(bundle, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("place", "value"))
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))


def predict(docs: DataFrame, prototypes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` (cosine, at least 0) of each row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Equally close
    languages: the first in order of names. Repeated rows give repeated results. Texts of any length
    are whole; other columns are not looked at.
    """
    learned = prototypes.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()  # a guard, not a cap
    if len(learned) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [r["lang"] for r in learned]
    table = np.array([r["vector"] for r in learned], np.float64).reshape(len(names), DIMENSIONS)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
    shared = docs.sparkSession.sparkContext.broadcast((names, table.astype(np.float32)))

    def compare(batches):
        names, table = shared.value
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                n = len(part)
                vectors = bundled(part.column(1), np.arange(n), n)
                size = np.linalg.norm(vectors, axis=1)
                if names:
                    cosine = vectors @ table.T
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(n), best] / np.maximum(size, 1e-30), 0.0, 1.0)
                    own = np.array(names, object)[best]
                else:
                    score, own = np.zeros(n), np.full(n, UNDECIDED, object)
                lost = size == 0
                own[lost], score[lost] = UNDECIDED, 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.string()), pa.array(score.astype(np.float64))], names=["_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[doc_id]
    asked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return asked.mapInArrow(compare, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", doc_id)
