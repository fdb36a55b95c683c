"""Collocations, packing and ranked search against brute force."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import collocations, lexical, packing
from siftline.llm.plans import PACK_TOKENIZER
from tests.llm.conftest import texts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


def collocations_by_hand(docs, least, top):
    counts, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    frequent = {k: c for k, c in counts.items() if c >= least and len(k[1]) > 1}
    longer = defaultdict(int)
    for (lang, p), c in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], c)
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        score, k = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
    return sorted((lang, i + 1, *r[3:]) for lang, rows in out.items() for i, r in enumerate(sorted(rows)[:top]))


def test_collocations(spark, odd, nothing, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "é,", "of.", "x\x0by", "a\tb"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(400)]
    docs += [("hot pair " + w, "en") for w in vocabulary for _ in range(40)] + [("same line of many words", "de")] * 90 + [(None, "fr"), ("", None)]
    frame = spark.createDataFrame(docs, "text string, lang string")
    for ranges, shard in ((1 << 24, 1 << 23), (1000, 2000)):
        monkeypatch.setattr(collocations, "SAMPLE_ROWS", 1.0)
        monkeypatch.setattr(collocations, "SAMPLE_WORDS", 7)
        monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
        for least, top in ((5, 2000), (3, 40)):
            got = collocations.collocations(frame, least=least, top=top, range_bytes=ranges)
            assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
            assert sorted(map(tuple, got.collect())) == collocations_by_hand(docs, least, top)
    assert sorted(map(tuple, collocations.collocations(odd, least=2).collect())) == collocations_by_hand([(r["text"], r["lang"]) for r in odd.collect()], 2, 2000)
    assert collocations.collocations(nothing).count() == 0


def test_frequent_partitions():
    rng = np.random.default_rng(5)
    keys = rng.integers(1, 6, (4, 3000)).astype(np.uint64)
    for d in range(1, 4):
        keys[d, (rng.random(3000) < 0.2) | (keys[d - 1] == 0)] = 0
    weights = rng.integers(1, 4, 3000)
    want = Counter()
    for i in range(3000):
        for d in range(1, 5):
            if keys[d - 1, i]:
                want[tuple(keys[:d, i].tolist())] += int(weights[i])
    member, depth, total = collocations.frequent(keys, weights, 30)
    got = {tuple(keys[:d, m].tolist()): t for m, d, t in zip(member.tolist(), depth.tolist(), total.tolist())}
    assert len(got) == len(member) and got == {k: c for k, c in want.items() if c >= 30}
    distinct, sums = collocations.added_up(keys)
    back, again = collocations.unpacked(len(sums), collocations.packed(distinct, sums))
    assert (back == distinct).all() and (again == sums).all() and sums.sum() == 3000
    assert [len(x) for x in collocations.frequent(keys[:, :0], weights[:0], 30)] == [0, 0, 0]


def test_chunks_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain, encoder, rng = Tokenizer.from_file(PACK_TOKENIZER), packing.Encoder(PACK_TOKENIZER), random.Random(3)
    signs = ["a", "B", "'", "s", "'s", "'re", "LL", " ", "\t", "\n", ".", ",", "!", "?", ";", ":", "-", "é", "́", "漢", "😀", "1", "２", "Σ", "İ", "<|endoftext|>", "<|", "|>", "\xa0", "　", "\x85", "\x00", "…", "_", "ﬁ", "‍"]
    texts = [None, "", *["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(4000)]]
    for keep in (packing.CHUNKS_KEPT, 10):
        packing.CHUNKS_KEPT, kept = keep, packing.CHUNKS_KEPT
        for part in (texts, texts[:50], texts):
            ids, at = encoder.encode(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]
        packing.CHUNKS_KEPT = kept


def test_places_by_sum_of_squares():
    rng, capacity = random.Random(6), 30
    sizes = [rng.randint(1, capacity) for _ in range(600)]
    where, offset, gaps = packing.sum_of_squares(sizes, capacity)
    left: list[int] = []
    for size, own, at in zip(sizes, where.tolist(), offset.tolist()):
        def total(change):
            return sum(c * c for g, c in Counter(change).items() if 0 < g < capacity)
        options = {capacity: total([*left, capacity - size])}
        for g in set(left):
            if g >= size:
                options[g] = total([*left[: left.index(g)], g - size, *left[left.index(g) + 1 :]])
        gap = capacity - at
        assert options[gap] == min(options.values()) and gap == min(g for g in options if options[g] == options[gap])
        if own == len(left):
            left.append(capacity)
        assert left[own] == gap
        left[own] -= size
    assert left == gaps.tolist()
    assert len(gaps) <= 1.05 * sum(sizes) / capacity + 2


def packed_right(docs, rows, size):
    """Checks cuts, checksums and gapless places; the number of sequences."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PACK_TOKENIZER)
    want = Counter()
    for d, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), size)):
            part = ids[a : a + size]
            want[d, p, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing(spark, odd, nothing, monkeypatch):
    docs = texts_of(odd)
    rows = packing.pack(odd, PACK_TOKENIZER).collect()
    packed_right(docs, rows, 4096)
    assert all(zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) == r["ids_crc32"] for r in rows)
    assert packing.pack(nothing, PACK_TOKENIZER).count() == 0
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = texts_of(frame)
    for shard, last in ((1 << 16, 1 << 12), (60, 30)):
        monkeypatch.setattr(packing, "SHARD_PIECES", shard)
        monkeypatch.setattr(packing, "LAST_PIECES", last)
        packed = packing.pack(frame, PACK_TOKENIZER, size=512)
        rows = packed.collect()
        n = packed_right(docs, rows, 512)
        bound = -(-sum(r["length"] for r in rows) // 512)
        assert n <= bound + (4 if shard > 60 else 12)  # small shards leave more open
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert len(whole) == n
    for r in rows:
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    same = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    rows = packing.pack(same, PACK_TOKENIZER, size=7).collect()  # four ids each: no sequence is ever full
    assert packed_right(texts_of(same), rows, 7) == 300


def ranks_by_hand(docs, items, k):
    def terms(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(LOWER))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * b[x] // (1000 * b[x] + 20 * m)) for x in set(terms(text)) if b[x])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, *_, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tiles", [(512, 512, 4096), (3, 5, 2)])
def test_search(spark, odd, nothing, monkeypatch, tiles):
    for name, size in zip(("ITEM_TILE", "DOC_TILE", "TERM_TILE"), tiles):
        monkeypatch.setattr(lexical, name, size)
    rng = random.Random(2)
    word = lambda: rng.choice(["Alpha", "beta", "b2", "é", "x", f"t{rng.randint(0, 60)}"])
    docs = [(rng.choice([d, d, 5]), " ".join(word() for _ in range(rng.randint(0, 12)))) for d in range(160)] + [(None, "alpha x"), (None, "alpha x"), (900, None), (901, "-")]
    items = [(i if i else None, " ".join(word() for _ in range(rng.randint(0, 6)))) for i in range(14)] + [(3, "alpha"), (3, None), (None, "ALPHA alpha x")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 21, 40):
        for k in (4, 50):
            got = lexical.top_documents(left.repartition(3), right, k=k, block_bytes=block).collect()
            assert sorted(map(tuple, got), key=str) == ranks_by_hand(docs, items, k)
    assert sorted(map(tuple, lexical.top_documents(odd, right).collect()), key=str) == ranks_by_hand(texts_of(odd), items, 50)
    assert lexical.top_documents(nothing, right).count() == 0
    assert lexical.top_documents(left, right.limit(0)).count() == 0


def test_long_documents_divide_exactly():
    n, total = 30_000_000_000, 9_000_000_000_000
    counts = np.array([0, 1, 300, 90_000_000], np.int64)
    assert lexical.lengths(counts, n, total).tolist() == [50 + 50 * c * n // total for c in counts.tolist()]
