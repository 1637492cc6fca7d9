"""Personal data by bootstrapped contextual extraction.

Base patterns give the seed entities (email, IP address, payment card, phone number).
Their contexts, the words to their left and right, are lexical patterns. Spark holds the
graph of patterns and instances (identifier-like strings: four digits or more, in groups over
single spaces, dots, hyphens and brackets; or anything with @ or (at) inside) and scores it in
rounds, each with the patterns of the seeds and of what the round before found: a pattern's confidence for a kind is the summed score of its instances over
all occurrences of its word in the corpus, whatever follows; an instance's score is the
noisy-or of its patterns'. So a word that stands nearly always beside a phone number is a
pattern, and a common word is not. Patterns of high confidence, seen with enough different
members, then give their kind to identifier-like strings that no base pattern matches.

Defined results: a null or empty text has no spans. Spans are code points, end exclusive.
Base spans always stay; a found span never overlaps a base span. Rows are extracted by
themselves; repeated rows agree, though they do count for the patterns' confidence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from claimlens.llm import _text as t
from claimlens.llm._spark import SKETCH_BITS, add_columns, document_sketch, emit_rows, in_sketch, sketch_slot, stored

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that fails from its first digit fails from every later one, so a run is tried once
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = t.table_of(b"._%+-" + bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))
_ID = t.table_of(b"._+@-" + bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = t.table_of(b"0123456789")
_JOINED = re.compile(rb"\)?[ .-]?\(?")
_AT = re.compile(rb" ?(?:\(at\)|\[at\]) ?")
_TRAIL = t.table_of(b"._+@-")
#: digits an identifier-like string without @ must have
LEAST_DIGITS = 4
ROUNDS = 3
#: what a pattern needs: confidence, and different strings of its kind
CONFIDENCE, SEEDS = 0.6, 5
#: the score from which an instance counts as found
FOUND = 0.8
#: weight of an imagined occurrence without an entity, against rare patterns
PRIOR = 1.0


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: bytes, local: np.ndarray) -> list[tuple[int, int]]:
    """Every match has one @, with the local part up to it: look at the @ signs only."""
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and local[text[start - 1]]:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find(b"@", max(at + 1, done))
    return out


def base_spans(text: bytes, local: list[bool] | np.ndarray = _LOCAL) -> list[tuple[int, int, int]]:
    """(start byte, kind, end byte), sorted: leftmost, not overlapping within a kind."""
    found = [(a, 0, b) for a, b in _emails(text, local)] if b"@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m[0].split(b".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].translate(None, b" -")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(None, b"+ ().-")) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _trimmed(data: np.ndarray, i: int, j: int) -> tuple[int, int]:
    while j > i and _TRAIL[data[j - 1]]:
        j -= 1
    while i < j and _TRAIL[data[i]]:
        i += 1
    return i, j


def _candidates(data: np.ndarray, off: np.ndarray, digits: np.ndarray, base: list) -> list[tuple[int, int, int, int]]:
    """(document, start, end, -1) of the identifier-like strings beside the base spans."""
    raw, low = data.tobytes(), t.LOWER[data].tobytes()
    a, b, first = t.words(data, off, _ID)
    ats = np.concatenate([[0], np.cumsum(data == 64)])
    doc = np.repeat(np.arange(len(off) - 1), first[1:] - first[:-1])
    some = (digits[b] > digits[a]) | (ats[b] > ats[a])
    # a piece of few digits and no @ counts only beside another piece with digits
    a, b, doc = a[some], b[some], doc[some]
    near = np.zeros(len(a) + 1, bool)
    near[1:-1] = (a[1:] - b[:-1] <= 3) & (doc[1:] == doc[:-1])
    use = near[1:] | near[:-1] | (digits[b] - digits[a] >= LEAST_DIGITS) | (ats[b] > ats[a])
    pieces = list(zip(doc[use].tolist(), a[use].tolist(), b[use].tolist()))
    for m in _AT.finditer(low) if b"at)" in low or b"at]" in low else ():
        d = int(np.searchsorted(off, m.start(), "right")) - 1
        i, j = m.start(), m.end()
        while i > off[d] and _ID[data[i - 1]]:
            i -= 1
        while j < off[d + 1] and _ID[data[j]]:
            j += 1
        i, j = _trimmed(data, i, j)
        if i < m.start() and j > m.end() and m.end() <= off[d + 1]:
            pieces.append((d, i, j))
    free, done = [], 0
    # longer ones first from the same place, so that a string with (at) takes in its parts
    for d, i, j in sorted(pieces, key=lambda x: (x[1], -x[2])):
        i, j = _trimmed(data, max(i, done), j)
        if i < j and all(j <= x + off[d] or i >= y + off[d] for x, _, y in base[d]):
            free.append((d, i, j))
            done = j
    out = []
    for d, i, j in free:
        if out and out[-1][0] == d and _digit(raw[out[-1][2] - 1]) and _digit(raw[i]) and i > out[-1][2] and _JOINED.fullmatch(raw, out[-1][2], i):
            out[-1] = (d, out[-1][1], j)
        else:
            out.append((d, i, j))
    rows = []
    for d, i, j in out:
        word = low[i:j]
        if digits[j] - digits[i] < LEAST_DIGITS and b"@" not in word and not _AT.search(word):
            continue
        if word.count(b")") > word.count(b"(") and i > off[d] and raw[i - 1] == 40:
            i -= 1
        elif word.count(b"(") > word.count(b")") and j < off[d + 1] and raw[j] == 41:
            j += 1
        rows.append((d, i, j, -1))
    return rows


def _digit(byte: int) -> bool:
    return 48 <= byte <= 57


def _instances(block: t.Block):
    """Base spans per document, and the graph's rows of the block: an occurrence is
    (document, start, end, kind or -1, string, left word, right word). Words are runs of
    letters and digits, as hashes; 0 where the text ends."""
    data, off = block.data, block.offsets
    low = t.LOWER[data]
    starts, ends, first = t.words(low, off, t.ALNUM)
    hashes = t.word_hashes(low, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    local = _LOCAL.tolist()
    base: list[list[tuple[int, int, int]]] = [[] for _ in range(len(block))]
    marks = np.concatenate([[0], np.cumsum(_DIGIT[data] | (data == 64))])
    for i in np.flatnonzero(marks[off[1:]] > marks[off[:-1]]):
        base[i] = base_spans(data[off[i]:off[i + 1]].tobytes(), local)
    rows = [(i, int(off[i]) + a, int(off[i]) + b, k) for i, spans in enumerate(base) for a, k, b in spans]
    rows += _candidates(data, off, digits, base)
    if not rows:
        return base, None
    doc, s, e, kind = (np.array(x, np.int64) for x in zip(*rows))
    left = np.searchsorted(ends, s, "right") - 1
    right = np.searchsorted(starts, e, "left")
    none = np.zeros(1, t.U64)
    padded = np.concatenate([hashes, none])
    at_left = np.where(left >= first[doc], padded[left], t.U64(0))
    at_right = np.where(right < first[doc + 1], padded[np.minimum(right, len(hashes))], t.U64(0))
    string = t.range_hashes(t.byte_values(low), s, e)
    return base, (doc, s, e, kind, string.view(np.int64), at_left.view(np.int64), at_right.view(np.int64))


_SPAN = StructType([StructField("start", LongType()), StructField("kind", LongType()), StructField("end", LongType())])
_OCCURRENCE = StructType([StructField(n, LongType()) for n in ("start", "end", "kind", "string", "left", "right")])


def _points(block: t.Block) -> np.ndarray:
    """Code points before each byte of a block (of its whole, not of each document)."""
    return np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])


def extract(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``base`` (array of start, kind, end, sorted) and ``near`` (array of the
    occurrences that take part in the graph), in code points."""

    def fn(block: t.Block) -> list:
        base, rows = _instances(block)
        points = _points(block)
        n = len(block)
        lengths = np.array([len(x) for x in base], np.int64)
        flat = [(a + int(block.offsets[i]), k, b + int(block.offsets[i]), i) for i, x in enumerate(base) for a, k, b in x]
        a, k, b, i = (np.array(x, np.int64) for x in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 4
        zero = points[block.offsets[:-1]]
        spans = pa.StructArray.from_arrays([pa.array(points[a] - zero[i]), pa.array(k), pa.array(points[b] - zero[i])], ["start", "kind", "end"])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(offsets), spans)]
        if rows is None:
            doc, cols = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 6
        else:
            order = np.lexsort((rows[1], rows[0]))
            doc = rows[0][order]
            cols = [points[rows[1]][order] - zero[doc], points[rows[2]][order] - zero[doc]] + [x[order] for x in rows[3:]]
        near = pa.StructArray.from_arrays([pa.array(x) for x in cols], list(_OCCURRENCE.names))
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), near))
        return out

    return add_columns(docs, fn, [StructField("base", ArrayType(_SPAN)), StructField("near", ArrayType(_OCCURRENCE))], keep)


def word_totals(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, total): occurrences in all texts of each word of ``words``. Each task counts
    the words whose bit is in a sketch of ``words``, and the join takes the exact ones."""
    sketch = document_sketch(words, "word")

    def fn(block: t.Block) -> dict | None:
        data = t.LOWER[block.data]
        starts, ends, _ = t.words(data, block.offsets, t.ALNUM)
        word, n = np.unique(t.word_hashes(data, starts, ends), return_counts=True)
        return {"word": word.view(np.int64), "n": n.astype(np.int64)}

    counted = emit_rows(docs.select("text"), fn, "word long, n long")
    slot = counted.withColumn("slot", sketch_slot(F.col("word")))

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_sketch(sketch, batch.column(2).to_numpy(zero_copy_only=False)))).drop_columns(["slot"])

    near = slot.mapInArrow(kept, "word long, n long")
    return near.groupBy("word").agg(F.sum("n").alias("total")).join(words, "word")


def bootstrap(docs: DataFrame, occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(string, kind, score) of strings that are not seeds and reach FOUND.
    ``occurrences``: (string, kind or -1, left, right), a row per occurrence."""
    edges = stored(
        occurrences.select("string", "kind", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("left").alias("word")), F.struct(F.lit(1).alias("side"), F.col("right").alias("word")))).alias("p"))
        .select("string", "kind", "p.side", "p.word").where("word != 0")
        .groupBy("string", "kind", "side", "word").agg(F.count("*").alias("n")), "pii_edges", 2 * occurrences.count())
    n = edges.count()
    # only these words can get enough members in any round; their totals are counted once
    words = edges.groupBy("side", "word").agg(F.count("*").alias("strings")).where(F.col("strings") >= SEEDS).select("word").distinct()
    totals = stored(word_totals(docs, words), "pii_totals", n)
    seeds = edges.where("kind >= 0").select("side", "word", F.col("kind").alias("as_kind"))
    scores = None
    for k in range(rounds):
        members = seeds
        if scores is not None:
            found = scores.where(F.col("score") >= FOUND).select("string", "as_kind")
            members = seeds.unionByName(edges.where("kind < 0").join(found, "string").select(*seeds.columns))
        patterns = stored(members.groupBy("side", "word", "as_kind").agg(F.count("*").alias("members")).where(F.col("members") >= SEEDS)
                          .drop("members").join(totals, "word"), "pii_patterns", n)
        graph = stored(edges.join(patterns, ["side", "word"]), "pii_graph", len(KINDS) * n)
        own = F.when(F.col("kind") >= 0, (F.col("kind") == F.col("as_kind")).cast("double"))
        if scores is None:
            scored = graph.withColumn("s", F.coalesce(own, F.lit(0.0)))
        else:
            scored = graph.join(scores, ["string", "as_kind"], "left").withColumn("s", F.coalesce(own, "score", F.lit(0.0))).drop("score")
        good = (scored.groupBy("side", "word", "as_kind").agg((F.sum(F.col("s") * F.col("n")) / (F.first("total") + PRIOR)).alias("confidence"))
                .where(F.col("confidence") >= CONFIDENCE))
        scores = stored(graph.where("kind < 0").join(good, ["side", "word", "as_kind"]).select("string", "as_kind", "side", "word", "confidence").distinct()
                        .groupBy("string", "as_kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("score")), "pii_scores", len(KINDS) * n)
    best = scores.where(F.col("score") >= FOUND).groupBy("string").agg(F.max(F.struct("score", -F.col("as_kind"))).alias("b"))
    return best.select("string", (-F.col("b.col2")).alias("kind"), F.col("b.score").alias("score"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``found`` (both arrays of start, kind, end) of every row."""
    rows = stored(extract(docs.select("doc_id", "text"), ["doc_id"]).withColumn("row", F.monotonically_increasing_id()), "pii_rows")
    near = rows.select("row", F.explode("near").alias("o")).select("row", "o.*")
    strings = bootstrap(docs, near.select("string", "kind", "left", "right"))
    hits = (near.where("kind < 0").drop("kind").join(strings, "string").groupBy("row")
            .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found")))
    none = F.array().cast(ArrayType(_SPAN))
    return rows.select("row", "doc_id", "base").join(hits, "row", "left").select("doc_id", "base", F.coalesce(F.col("found").cast(ArrayType(_SPAN)), none).alias("found"))


def written(spans_: str) -> object:
    """kind:start:end of an array of spans, by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans_), lambda x: F.concat_ws(":", F.element_at(names, (x["kind"] + 1).cast("int")), x["start"], x["end"])), ",")
