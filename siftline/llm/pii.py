"""Personal data, and terms that give it away, by how strongly the corpus ties them to it.

Base patterns find entities (addresses, numbers). Over all documents the operator counts how many hold
an entity, a term (a word outside entities), and both, anywhere in their whole texts. The information
that term t gives about entity e is PMI(e;t) = log2(N n(e,t) / (n(e) n(t))); the entity itself carries
IC(e) = log2(N / n(e)). In the documents that hold the entity, a term that gives away at least
``REMOVE`` of that information is removed at all its places, one that gives away at least
``GENERALISE`` of it is replaced by its shape.

Pairs are formed only where they can count. An entity in fewer than ``SUPPORT`` documents has none, and
as n(e,t) <= n(e), a term with n(t) > N^(1-g) n(e)^g, g = GENERALISE, cannot give away enough of e.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.words import PLAIN, Words, mix, slices
from siftline.session import stage_table

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  # documents in which a term and an entity meet: fewer estimate nothing
FLUSH = 2_000_000  # words that a task counts before it hands them on
REMOVE, GENERALISE = 0.95, 0.8  # shares of the entity's information
SPANS = "array<struct<start:bigint,end:bigint,rank:int,kind:string>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
# Possessive and anchored forms of the contract's patterns: they match the same in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LIKELY = r"@|[0-9][0-9.\x20-]{5}|\+[0-9]"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at - _LOCAL_BACK.match(text[done:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        else:
            done = max(done, begin)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(x if x < 10 else x - 9 for x in (2 * int(d) for d in even))) % 10 == 0


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, rank of the kind, kind) of all base matches, in code points, by start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, k, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(kind: str, value: str) -> str:
    """An entity's name: its value without case and separators."""
    return f"{kind}:{value.lower() if kind == 'email' else re.sub('[^0-9.]', '', value) if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def terms(text: str, found: list) -> list[tuple[str, int, int]]:
    """(term, start, end) of the lower-cased words outside all entities, in code points."""
    begins, ends = [], []  # the union of the entities
    for a, b, *_ in found:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    out = []
    for m in _TERM.finditer(text.translate(_FOLD)):
        k = bisect_left(ends, m.start() + 1)
        if k == len(ends) or begins[k] >= m.end():
            out.append((m[0], *m.span()))
    return out


def _prints(words: list[str]) -> list[int]:
    return Words(pa.array(words, pa.string()), PLAIN).hashes().view(np.int64).tolist()


def _scanned(docs: DataFrame, carry: list[str], text: str) -> DataFrame:
    """A row number, ``own`` (the carried columns), ``spans``, ``entities``, and the text of rows that hold any."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("kind", pa.string())])

    def scan(batches):
        for batch in batches:
            column = batch.column(2)
            likely = pc.fill_null(pc.match_substring_regex(column, _LIKELY), False).to_numpy(zero_copy_only=False)
            spans, names, bodies = [[]] * len(batch), [[]] * len(batch), [None] * len(batch)
            for i in np.flatnonzero(likely).tolist():
                body = column[i].as_py()
                found = entities(body)
                if found:
                    spans[i] = [dict(zip(("start", "end", "rank", "kind"), x)) for x in found]
                    names[i], bodies[i] = sorted({_key(kind, body[a:b]) for a, b, _, kind in found}), body
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(names, pa.list_(pa.string())), pa.array(bodies, pa.string())], names=["row", "own", "spans", "entities", "body"],
            )

    asked = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in carry]).alias("own"), F.col(text).alias("text"))
    rest = T.StructType.fromDDL(f"spans {SPANS}, entities array<string>, body string")
    return stage_table(asked.mapInArrow(scan, T.StructType([asked.schema["row"], asked.schema["own"], *rest])), "scanned")


def _row_terms(held: DataFrame) -> DataFrame:
    """(row, term) of the distinct terms of each row."""
    def distinct_terms(batches):
        for batch in batches:
            for row, spans, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = sorted({t for t, *_ in terms(body, [tuple(x.values()) for x in spans])})
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array(_prints(own), pa.int64())], names=["row", "term"])

    return held.select("row", "spans", "body").mapInArrow(distinct_terms, "row long, term long")


def term_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many documents each word occurs, over all of them; words as fingerprints."""
    def count(batches):
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                words = Words(batch.column(0).slice(lo, hi - lo), PLAIN, lower=True)
                # One entry per document and word: the row mixed into the print tells documents apart.
                own, rows = words.hashes(), words.row_of().astype(np.uint64)
                order = np.argsort(own ^ mix(rows + np.uint64(1)), kind="stable")
                own, rows = own[order], rows[order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])
                more = np.sort(own[new])
                first = np.flatnonzero(np.concatenate((np.ones(min(len(more), 1), bool), more[1:] != more[:-1])))
                terms = np.concatenate((terms, more[first]))
                counts = np.concatenate((counts, np.diff(np.append(first, len(more)))))
                if len(terms) > FLUSH:
                    terms, counts = _merged(terms, counts)
                    if len(terms) > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])
                        terms, counts = terms[:0], counts[:0]
        terms, counts = _merged(terms, counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _merged(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(terms), 1), bool), terms[1:] != terms[:-1])))
    return terms[first], np.add.reduceat(counts, first) if len(first) else counts


def _hits(scanned: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``row`` and ``told``: for each row the terms (prints) that give away an entity it holds, with their share."""
    every = scanned.select("row", F.explode("entities").alias("entity"))
    living = every.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= SUPPORT)
    held = stage_table(every.join(living, "entity"), "held")  # a crowded entity is a hot key here: adaptive execution splits it
    most = held.agg(F.max("n_entity")).first()[0]
    if most is None:
        return scanned.limit(0).select("row", F.lit(None).cast("array<struct<term:bigint,share:double>>").alias("told"))
    reach = lambda n: F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) * F.pow(n.cast("double"), F.lit(GENERALISE)) * (1 + 1e-9)
    own = stage_table(_row_terms(scanned.join(held.select("row").distinct(), "row", "left_semi")), "terms")
    rare = counts.filter((F.col("n") >= SUPPORT) & (F.col("n") <= reach(F.lit(most)))).withColumnRenamed("n", "n_term")
    # Terms of many documents are hot keys on the left but have no partner; they leave before the join.
    crowded = counts.filter(F.col("n") > reach(F.lit(most))).select("term")
    near = own.join(crowded, "term", "left_anti").join(rare, "term")
    pairs = stage_table(held.join(near, "row").filter(F.col("n_term") <= reach(F.col("n_entity"))), "pairs")
    meet = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).filter(F.col("n_both") >= SUPPORT)
    carried = F.log2(F.lit(float(total)) / F.col("n_entity"))
    given = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    shares = meet.select("entity", "term", F.when(carried > 0, given / carried).otherwise(0.0).alias("share")).filter(F.col("share") >= GENERALISE)
    found = pairs.select("row", "entity", "term").join(shares, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    return found.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("told"))  # the terms of one text at most


def _found(docs: DataFrame, carry: list[str], text: str) -> DataFrame:
    """``own`` and all ``spans`` of each row of ``docs``."""
    scanned = _scanned(docs, carry, text)
    hits = _hits(scanned, term_documents(docs, text), scanned.count())

    def place(batches):
        for batch in batches:
            spans = batch.column(1).to_pylist()
            for i, (body, told) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if told:
                    share = {x["term"]: x["share"] for x in told}
                    own = terms(body, [tuple(x.values()) for x in spans[i]])
                    for (_, a, b), p in zip(own, _prints([t for t, *_ in own])):
                        if p in share:
                            rank, kind = (4, "term") if share[p] >= REMOVE else (5, "hint")
                            spans[i].append({"start": a, "end": b, "rank": rank, "kind": kind})
                    spans[i].sort(key=lambda x: (x["start"], x["rank"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.schema.field(1).type)], names=["own", "spans"])

    told = hits.withColumnRenamed("row", "_hit")
    placed = scanned.join(told, F.col("row") == F.col("_hit"), "left").select("own", "spans", "body", "told")
    return placed.mapInArrow(place, T.StructType([scanned.schema["own"], scanned.schema["spans"]]))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and ``spans`` of each row: base matches, and terms (``term`` to remove, ``hint`` to generalise).

    Null and empty texts have no spans. Rows are judged each for itself, repeated and null ids too; equal
    rows count as so many documents. A term that gives away two entities of a text takes the stricter of
    its two actions. Texts of any length are whole; other columns are not looked at.
    """
    return _found(docs, [doc_id], text).select(F.col("own")[doc_id].alias(doc_id), "spans")


MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "", "hint": "[WORD]"}


def sanitised(text: str, spans: list) -> str:
    """``text`` with each span replaced by its mask; a span that starts inside another goes with it."""
    out, at = [], 0
    for start, end, _, kind in spans:
        if start >= at:
            out += [text[at:start], MASKS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` sanitised; a null text stays null.

    Rows are carried by number, so ids may repeat or be null and columns may have any names.
    """
    def rewrite(batches):
        for batch in batches:
            bodies, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [b if b is None or not s else sanitised(b, [tuple(x.values()) for x in s]) for b, s in zip(bodies, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["own", "new"])

    found = _found(docs, docs.columns, text)
    done = found.select("own", F.col("own")[text].alias("body"), "spans").mapInArrow(rewrite, T.StructType([found.schema["own"], T.StructField("new", T.StringType())]))
    return done.select(*[F.col("new").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns])
