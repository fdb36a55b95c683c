"""Near duplicates by BagMinHash signatures of word shingles, banded and verified on multiset overlap.

A document is a bag of five-word shingles, weighted by their counts. Each (shingle, weight level)
runs a Poisson process whose points carry a time, a register and a place within the level. Levels
double: level 0 is the first copy, level l the copies 2**(l-1)+1 to 2**l; a point counts if the
shingle has that many copies. A register keeps its earliest point. Two documents agree in a register
with probability equal to the weighted Jaccard similarity of their bags. Processes run only until
all registers of a document are filled, which takes about ``k * ln k`` points however long it is.

Equal word sequences form one class first; bands are taken over class representatives. Within a
bucket members are compared with changing centers rather than with each other, so a group of n
members costs about n comparisons. What is then still apart from others of its bucket is compared with
all of them in blocks, so no link between different texts is lost in a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.words import SPACED, Words, member, mix, slices, window_hashes
from siftline.session import stage_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
ROUNDS = 3
BLOCK = 1000  # members of a bucket that are compared in one go
SLICE_BYTES, SLICE_ROWS = 1 << 20, 512  # of texts taken at once; a row draws some 1,800 points however short it is
SLACK = 0.01  # for prints of 32 bits that fall together
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def shingle_bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of each distinct shingle; a text of 1 to 4 words is one shingle."""
    hashes = words.hashes()
    starts = words.window_starts(SHINGLE)
    grams = window_hashes(hashes, SHINGLE)[starts]
    rows = words.row_of()[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        lone = np.array([window_hashes(hashes[words.at[r] : words.at[r + 1]], int(words.counts[r]))[0] for r in short], np.uint64)
        grams, rows = np.concatenate((grams, lone)), np.concatenate((rows, short))
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, grams = rows[order], grams[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(rows), 1), bool), (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1]))))
    return rows[new], grams[new], np.diff(np.append(new, len(rows)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """BagMinHash registers, one row of ``k`` per document; 0 in documents without shingles."""
    out = np.zeros((n_rows, k), np.uint64)
    if not len(rows):
        return out
    levels = np.ceil(np.log2(counts)).astype(np.int64)  # 0 for one copy
    many = levels + 1
    pick = np.repeat(np.arange(len(rows)), many)
    level = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
    base = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(base, 1).astype(np.float64)
    row, count = rows[pick], counts[pick]
    state = mix(grams[pick] + level.astype(np.uint64) * _GOLDEN)
    weight = np.bincount(rows, counts, n_rows)
    best = np.full(n_rows * k, np.inf)
    # All registers are filled by this time but for about e**-6 of the documents; those go on.
    limit = k * (np.log(k) + 6) / np.maximum(weight, 1)
    time = -np.log(_uniform(state)) / rate
    while True:
        active = np.flatnonzero(time <= limit[row])
        points = []
        while len(active):
            draw = mix(state[active] ^ _U(0xA5A5A5A5A5A5A5A5))
            place = base[active] + (_uniform(mix(draw + _GOLDEN)) * rate[active]).astype(np.int64)
            valid = place < count[active]
            points.append((row[active][valid] * k + (draw[valid] % _U(k)).astype(np.int64), time[active][valid], draw[valid]))
            state[active] = mix(state[active] + _GOLDEN)
            time[active] += -np.log(_uniform(state[active])) / rate[active]
            active = active[time[active] <= limit[row[active]]]
        if points:
            spot, when, mark = (np.concatenate(x) for x in zip(*points))
            order = np.argsort(when, kind="stable")[::-1]  # the earliest is written last
            spot, when, mark = spot[order], when[order], mark[order]
            later = when < best[spot]
            best[spot[later]] = when[later]
            out.reshape(-1)[spot[later]] = mark[later]
        open_rows = (weight > 0) & np.isinf(best.reshape(n_rows, k)).any(axis=1)
        if not open_rows.any():
            return out
        limit[~open_rows] = 0
        limit[open_rows] *= 2
        keep = open_rows[row]
        row, count, base, rate, state, time = (x[keep] for x in (row, count, base, rate, state, time))


def _signed(docs: DataFrame, doc_id: str, text: str, bands: int, band_rows: int) -> DataFrame:
    """Id, number of words, two-word fingerprint of the word sequence, band hashes."""
    def sign(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES, SLICE_ROWS):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(1), SPACED)
                n = len(part)
                table = signatures(*shingle_bags(words), n, bands * band_rows)
                grouped = table.reshape(n * bands, band_rows)
                folded = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, n)
                for j in range(band_rows):
                    folded = mix(folded + grouped[:, j])
                has = words.counts > 0
                marks = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(folded.view(np.int64)), mask=pa.array(~has))
                # The whole word sequence, twice with different multipliers.
                keys = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                place = (np.arange(len(words)) - np.repeat(words.at[:-1], words.counts)).astype(np.uint64)
                hashes = words.hashes()
                for key, seed in zip(keys, (_U(0x632BE59BD9B4E019), _U(0xE220A8397B1DCDAF))):
                    upto = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(mix(hashes + mix(place * seed + seed)), out=upto[1:])
                    key[:] = upto[words.at[1:]] - upto[words.at[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.counts, pa.int64()), *[pa.array(k.view(np.int64)) for k in keys], marks], names=["id", "n_words", "key_a", "key_b", "bands"],
                )

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(sign, f"id {kind}, n_words long, key_a long, key_b long, bands array<long>")


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle bags of each pair of texts."""
    n = len(left)
    row_a, gram_a, count_a = shingle_bags(Words(left, SPACED))
    row_b, gram_b, count_b = shingle_bags(Words(right, SPACED))
    rows, grams, counts = np.concatenate((row_a, row_b)), np.concatenate((gram_a, gram_b)), np.concatenate((count_a, count_b))
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, grams, counts = rows[order], grams[order], counts[order]
    both = np.flatnonzero((rows[1:] == rows[:-1]) & (grams[1:] == grams[:-1]))
    shared = np.bincount(rows[both], np.minimum(counts[both], counts[both + 1]), n)
    total = np.bincount(rows, counts, n) - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids whose bags overlap enough, with the overlap; texts are joined, never gathered."""
    def judge(batches):
        for batch in batches:
            size = pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3)))
            upto, start = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 2 * SLICE_BYTES, "right")))
                part = batch.slice(start, end - start)
                score = overlap(part.column(2), part.column(3))
                good = pa.array(score >= similarity)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good), pa.array(score).filter(good)], names=["a", "b", "overlap"])
                start = end

    kind = dict(pairs.dtypes)["a"]
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(judge, f"a {kind}, b {kind}, overlap double")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id of each node's component, by alternating large and small stars.

    Each round shortens paths to the root; the edge table stays as large as the number of nodes and
    links, and is written once a round.
    """
    edges = stage_table(links.select("a", "b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        following = stage_table(small, "links")
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = following


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` (smallest id of its class), ``copy_of``, ``links_found``.

    Classes are the components of links of at least ``similarity`` between word sequences; equal word
    sequences are copies of their smallest id. ``links_found`` counts the links that the search has met
    between the text and other texts; members of a large class are joined without trying all its pairs.
    Rows are told apart by number: repeated ids are rows of their own, a null id is larger than all.
    Null texts and texts without words are each a class of their own. Texts of any length are whole;
    other columns are not looked at. With the default bands a link at 0.8 is missed with probability
    3e-6, above it less.
    """
    numbered = stage_table(docs.select(F.monotonically_increasing_id().alias("number"), F.col(doc_id).alias("id"), F.col(text).alias("text")), "numbered")
    found = _classed(numbered, similarity, bands, band_rows)
    return found.select(F.col("own.id").alias(doc_id), F.col("least.id").alias("class_id"), F.col("first.id").alias("copy_of"), "links_found")


def _classed(numbered: DataFrame, similarity: float, bands: int, band_rows: int) -> DataFrame:
    """``number``, and as (null id, id, number): ``own``, ``first`` of its copies and ``least`` of its class."""
    signed = stage_table(_signed(numbered, "number", "text", bands, band_rows), "signed")
    some = signed.filter("n_words > 0")
    copies = some.groupBy("key_a", "key_b").agg(F.min("id").alias("rep"))
    reps = some.join(copies.select(F.col("rep").alias("id")), "id", "left_semi")
    texts = numbered.select(F.col("number").alias("id"), "text")
    links, roots = _linked(reps, texts, similarity)
    members = signed.join(copies, ["key_a", "key_b"], "left").select("id", F.when(F.col("n_words") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links_found"))
    known = degree.join(roots, "node", "left")
    placed = members.join(known, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("number"), "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("links_found", F.lit(0).cast("long")).alias("links_found"))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "number").alias("own")
    placed = stage_table(placed.join(numbered.select("number", own), "number"), "placed")
    first = placed.groupBy("rep").agg(F.min("own").alias("first"))
    least = placed.groupBy("root").agg(F.min("own").alias("least"))
    return placed.join(first, "rep").join(least, "root").select("number", "own", "first", "least", "links_found")


def _linked(reps: DataFrame, texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links between representatives and the components they form."""
    spread = reps.select("id", "n_words", F.explode("bands").alias("band"))
    sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.min_by("id", F.xxhash64("id", "band", F.lit(r))).alias(f"c{r}") for r in range(1, ROUNDS)], F.min("id").alias("c0")).filter("n > 1")
    buckets = stage_table(spread.join(sizes, "band"), "buckets")
    # Only texts that share a bucket are moved again. Ids grow with the corpus, so no side is broadcast.
    texts = stage_table(texts.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    stars = buckets.select("id", F.explode(F.array_distinct(F.array(*[f"c{r}" for r in range(ROUNDS)]))).alias("center")).filter("id <> center")
    tried = stage_table(stars.select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct(), "tried")
    links = stage_table(_verified(tried, texts, similarity), "verified")
    roots = components(links)
    pairs = _still_apart(buckets, roots, texts, similarity).join(tried, ["a", "b"], "left_anti")
    late = stage_table(_verified(pairs, texts, similarity), "verified")
    if not late.isEmpty():
        links = links.unionByName(late)
        roots = components(links)
    return links, roots


def _still_apart(buckets: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a bucket in different components that may reach ``similarity``, each once.

    Shingles that no other such document has can't be shared, which bounds the overlap of a bag with
    any other: one with too many of them has no link at all, and needs no pair to show it.
    """
    placed = buckets.select("id", "band", "n_words").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    rest = stage_table(placed.join(mixed, "band"), "rest")
    bags = _bags(texts.join(rest.select("id").distinct().hint("merge"), "id", "left_semi"))
    alone = bags.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), F.first("copies").alias("copies")).filter("n = 1").groupBy("id").agg(F.sum("copies").alias("alone"))
    weight = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))
    bounded = rest.join(alone, "id", "left").select("id", "band", "root", weight.alias("weight"), (weight - F.coalesce("alone", F.lit(0))).alias("shared"))
    able = stage_table(bounded.filter(F.col("shared") >= similarity * F.col("weight") - 1e-9), "able")
    # Members outside the largest component of their bucket meet all others of it, in blocks.
    major = able.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("roots"),
    ).filter("roots > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    minor_blocks = F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")
    members = able.join(major, "band").join(_prints(texts.join(able.select("id").distinct().hint("merge"), "id", "left_semi")), "id")
    members = members.select("id", "band", "root", "prints", (F.col("root") != F.col("major")).alias("minor"), blocks.alias("blocks"), minor_blocks.alias("minor_blocks"))
    dealt = stage_table(members, "members")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = dealt.filter("minor").select("band", own("minor_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "id", "root", "prints")
    right = dealt.select("band", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("i"), own("blocks").alias("j"), "id", "root", "prints")
    kind, key = dict(able.dtypes)["id"], ["band", "i", "j"]

    def meet(minors: pa.Table, all_members: pa.Table) -> pa.Table:
        """Pairs whose bags of prints come near the similarity; the texts decide later."""
        out = {"a": [], "b": []}
        roots, ids = all_members.column("root").to_pylist(), all_members.column("id").to_pylist()
        column = all_members.column("prints").combine_chunks()
        values, at = np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(column)))))
        sizes = np.diff(at)
        for x, root, prints in zip(minors.column("id").to_pylist(), minors.column("root").to_pylist(), minors.column("prints")):
            bag = np.sort(np.asarray(prints.values))
            hit = np.zeros(len(values) + 1, np.int64)
            np.cumsum(member(values, bag) >= 0, out=hit[1:])
            shared = hit[at[1:]] - hit[at[:-1]]
            for k in np.flatnonzero(shared >= (similarity - SLACK) * (sizes + len(bag) - shared)).tolist():
                if roots[k] != root:
                    out["a"].append(min(x, ids[k]))
                    out["b"].append(max(x, ids[k]))
        return pa.table(out, schema=pa.schema([("a", minors.schema.field("id").type), ("b", minors.schema.field("id").type)]))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"a {kind}, b {kind}").distinct()


def _prints(texts: DataFrame) -> DataFrame:
    """(id, prints): 32 bits of each copy of each shingle, for a first comparison."""
    def prints(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES, SLICE_ROWS):
                part = batch.slice(lo, hi - lo)
                rows, grams, counts = shingle_bags(Words(part.column(1), SPACED))
                copy = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                values = mix(np.repeat(grams, counts) + copy.astype(np.uint64) * _GOLDEN).astype(np.uint32).view(np.int32)
                at = np.searchsorted(np.repeat(rows, counts), np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))], names=["id", "prints"])

    return texts.select("id", "text").mapInArrow(prints, f"id {dict(texts.dtypes)['id']}, prints array<int>")


def _bags(texts: DataFrame) -> DataFrame:
    """(id, gram, copies) of each distinct shingle."""
    def bags(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES, SLICE_ROWS):
                part = batch.slice(lo, hi - lo)
                rows, grams, counts = shingle_bags(Words(part.column(1), SPACED))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(grams.view(np.int64)), pa.array(counts)], names=["id", "gram", "copies"])

    return texts.select("id", "text").mapInArrow(bags, f"id {dict(texts.dtypes)['id']}, gram long, copies long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, but one row stays of each class: the one of the smallest id.

    Of rows that repeat an id one stays; rows without id stay only where no row of their class has one.
    Rows without words all stay. Columns may have any names.
    """
    staged = stage_table(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")), "numbered")
    numbered = staged.select("number", F.col("row")[doc_id].alias("id"), F.col("row")[text].alias("text"))
    found = _classed(numbered, similarity, BANDS, BAND_ROWS)
    kept = found.filter(F.col("own.number") == F.col("least.number")).select("number")
    return staged.join(kept, "number", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
