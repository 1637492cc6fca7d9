"""Byte-level deduplication by a column-wise suffix construction over many documents.

Wanted: every byte covered by a 100-byte string that starts earlier (smaller doc_id, or
earlier in the same document).

Alignment. Each 100-byte window names an anchor: the least by hash of its 32-byte windows,
the leftmost of equals. That choice depends on the window's bytes alone, so equal windows name
equal anchors at equal offsets. Consecutive windows with the same anchor form a run; its bytes,
aligned at the anchor, are a string of the collection (at most 168 bytes, and one string for
all copies of it). Anchors that occur once die here; Spark counts them.

Construction. The strings of a shard are taken column by column from the right, inserting one
symbol of each string per round: the strings, in the order of what follows, are dealt stably by
the new symbol (the column of the collection's Burrows-Wheeler transform), and the common
prefix of neighbours becomes one more than the least between them where the symbols agree,
else nothing. After the round of a column, neighbours with a common prefix of 100 or more are
one class of equal windows, and the class's earliest place is known. As equal windows stand in
the same column, a round touches each string once; the textbook insertion into a transform of
all suffixes would touch all earlier ones again in every round. Shards arrive as rows sorted by
anchor, are read once in order, and hold ``BATCH`` strings at a time; they are what the
construction's external files are, kept by Spark's shuffle so that a lost executor's are made
again.

An anchor with more than ``CROWD`` different strings is dealt over several shards, and the
classes of those shards are joined by their windows' bytes in one more step.

Defined results: a null or empty text has no bytes; texts below 100 bytes lose nothing. Rows
with the same doc_id and text are one document. A null doc_id comes after all others, in the
order of the text's hash. Documents are compared by doc_id and found again by doc_id and the
hash of the text (``body``): different texts under one id lose what a smaller id has or what
starts earlier in the same text, and nothing to each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from claimlens.llm import _text as t
from claimlens.llm._spark import (SPANS, add_columns, add_with_hits, document_sketch, free_name, hash_sketch, hash_slots, in_sketch, ship,
                                  sketch_slot, stored)

WIDTH = 100
SEED_WIDTH = 32
#: strings worked on at a time, and different strings of one anchor in one shard
BATCH, CROWD = 1 << 13, 1 << 14
#: text bytes hashed at a time: the arrays stay in the processor's cache
STEP = 1 << 18
NO_SYMBOL = 256


def _runs(block: t.Block, width: int, seed: int):
    """Runs of windows with the same anchor: anchor hash, document, first window, number of
    windows, place of the anchor (places count in the block), and a hash of all that is in it."""
    values = t.byte_values(block.data)
    at, doc = t.windows(block.offsets, width)
    if not len(at):
        return None
    each = np.arange(len(values) - seed + 1)
    small = t.range_hashes(values, each, each + seed)
    anchor = t.sliding_argmin(small, width - seed + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    k = np.flatnonzero(new)
    first, n, place = at[k], np.diff(np.append(k, len(at))), anchor[k]
    words = t.range_hashes(values, first, first + n + width - 1) ^ t.mix((place - first).astype(t.U64))
    return small[place], doc[k], first, n, place, words


_OCCURRENCE = "anchor long, key long, body long, place int, back int, n int, words long, times long, mixed boolean"


def occurrences(docs: DataFrame, sketch: bytes | None = None, by_words: bool = False, every: bool = False,
                width: int = WIDTH, seed: int = SEED_WIDTH) -> DataFrame:
    """Runs: anchor, key, body, place of the anchor in the text, ``back`` (bytes from the first window
    to the anchor), n (windows), words. ``sketch`` lets through the anchors in it and a few more.
    With ``every`` a row per run; else a row per document and anchor (with ``by_words`` and
    words): its first run, how many ``times`` there are, and whether their words are ``mixed``."""

    def run(batches):
        for block in t.blocks(batches, limit=STEP):
            found = _runs(block, width, seed)
            if found is None:
                continue
            if sketch is not None:
                ok = in_sketch(sketch, hash_slots(found[0]))
                found = [x[ok] for x in found]
            anchor, doc, first, n, place, words = found
            times, mixed = np.ones(len(anchor), np.int64), np.zeros(len(anchor), bool)
            if not every and len(anchor):
                order = np.argsort(t.inside(anchor ^ (t.mix(words) if by_words else t.U64(0)), doc), kind="stable")
                a, d, w = anchor[order], doc[order], words[order]
                new = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (by_words & (w[1:] != w[:-1])))
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(a)))
                mixed = np.minimum.reduceat(w, at) != np.maximum.reduceat(w, at)
                anchor, doc, first, n, place, words = (x[order][at] for x in found)
            yield pa.RecordBatch.from_pydict({
                "anchor": anchor.view(np.int64), "key": block.ids("key")[doc], "body": block.ids("body")[doc], "place": (place - block.offsets[doc]).astype(np.int32),
                "back": (place - first).astype(np.int32), "n": n.astype(np.int32), "words": words.view(np.int64),
                "times": times, "mixed": mixed})

    return ship(docs).select("key", "body", "text").mapInArrow(run, _OCCURRENCE)


def _first() -> list:
    """Of the occurrences of a group, one in the least document (of texts under one id, any:
    all columns see the same rows in the same order, so they come from the same one)."""
    return [F.min("key").alias("key")] + [F.min_by(c, "key").alias(c) for c in ("body", "place", "back", "n")]


def _passed(docs: DataFrame, sketch: bytes) -> DataFrame:
    slots = docs.select("key", "body", "text", sketch_slot(F.col("key")).alias("slot"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_sketch(sketch, batch.column(3).to_numpy(zero_copy_only=False)))).drop_columns(["slot"])

    return ship(slots).mapInArrow(run, "key long, body long, text binary")


_STRING = "anchor long, words long, key long, body long, place int, back int, n int, part long, string binary"


def strings(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """The bytes of the wanted runs (anchor, words, key, body, place, back, n, part), each read
    from the document (key, body)."""
    lists = wanted.groupBy("key", "body").agg(F.collect_list(F.struct("anchor", "words", "place", "back", "n", "part")).alias("runs"))
    texts = _passed(docs, document_sketch(wanted, "key")).dropDuplicates(["key", "body"]).join(lists, ["key", "body"])

    def run(batches):
        for block in t.blocks(batches, limit=STEP):
            runs = block.column("runs")
            count = runs.value_lengths().to_numpy(zero_copy_only=False)
            flat = runs.flatten()
            doc = np.repeat(np.arange(len(block)), count)
            place, back, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("place", "back", "n"))
            start, size = block.offsets[doc] + place - back, n + width - 1
            data = block.data[t.ragged(start, size)]
            raw = pa.py_buffer(np.ascontiguousarray(data))
            off = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                **{c: flat.field(c) for c in ("anchor", "words")}, **{c: block.ids(c)[doc] for c in ("key", "body")},
                **{c: flat.field(c) for c in ("place", "back", "n", "part")},
                "string": pa.Array.from_buffers(pa.binary(), len(size), [None, off, raw])})

    return ship(texts).mapInArrow(run, _STRING)


def classes(group: np.ndarray, back: np.ndarray, n: np.ndarray, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray,
            width: int = WIDTH, seed: int = SEED_WIDTH):
    """The construction. String i (of ``group[i]``, sorted) lies at ``data[offsets[i]:offsets[i+1]]``,
    its anchor ``back[i]`` bytes in, and starts n[i] windows. Returns a matrix over (string,
    column): the least ``rank`` among the strings with an equal window there; -1: no window."""
    reach = width - seed                    # columns run from -reach (before the anchor) to width - 1
    m, columns = len(group), reach + width
    symbols = np.full((columns, m), NO_SYMBOL, np.int32)
    size = offsets[1:] - offsets[:-1]
    owner = np.repeat(np.arange(m), size)
    symbols[t.ragged(reach - back, size), owner] = data
    least = np.full((reach + 1, m), -1, np.int64)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    base = group * (NO_SYMBOL + 1)          # groups stay where they are, so this is the same in every round
    for column in range(columns - 1, -1, -1):
        symbol = symbols[column][order]
        dealt = np.argsort(base + symbol, kind="stable")
        key = (base + symbol)[dealt]
        alike = np.zeros(m, bool)
        alike[1:] = (key[1:] == key[:-1]) & (symbol[dealt][1:] != NO_SYMBOL)
        now = np.zeros(m + 1, np.int32)
        k = np.flatnonzero(alike)
        p, q = dealt[k - 1], dealt[k]       # p < q: the least common prefix in (p, q]
        low = common[q]
        far = np.flatnonzero(q > p + 1)
        if len(far):
            low[far] = np.minimum.reduceat(common, np.stack([p[far] + 1, q[far] + 1], axis=1).ravel())[::2]
        now[k] = low + 1
        order, common = order[dealt], now
        if column <= reach:
            first = np.flatnonzero(now[:m] < width)
            best = np.minimum.reduceat(rank[order], first)
            least[column, order] = np.repeat(best, np.diff(np.append(first, m)))
    starts = np.arange(reach + 1)[:, None] - reach
    least[(starts < -back) | (starts >= n - back)] = -1
    return least.T


_CLASS = "anchor long, words long, col int, n int, first_key long, first_body long, first_place int, window long"


def construct(shards: DataFrame, crowded: bool, width: int = WIDTH, seed: int = SEED_WIDTH) -> DataFrame:
    """(anchor, words, col, n, first_key, first_body, first_place): the string's windows in
    columns col to col + n - 1 first occur in document first_key, first_body with the anchor at
    first_place; this place names the class. With
    ``crowded`` a row per window, with the hash of its bytes in ``window``."""
    reach = width - seed

    def solve(rows: pa.Table):
        anchor, part, key, body, place, back, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("anchor", "part", "key", "body", "place", "back", "n"))
        data, offsets = t.bytes_of(rows.column("string").combine_chunks())
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        by_place = np.lexsort((place, body, key))
        rank = np.empty(len(key), np.int64)
        rank[by_place] = np.arange(len(key))
        least = classes(np.cumsum(fresh) - 1, back, n, data, offsets, rank, width, seed)
        flat = least.ravel()
        change = np.ones(len(flat), bool)
        if not crowded:
            change[1:] = flat[1:] != flat[:-1]
            change[:: reach + 1] = True
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, len(flat)))
        at, size = at[flat[at] >= 0], size[flat[at] >= 0]
        who, col, first = at // (reach + 1), at % (reach + 1) - reach, by_place[flat[at]]
        window = np.zeros(len(at), np.int64)
        if crowded:
            start = offsets[who] + back[who] + col
            window = t.range_hashes(t.byte_values(data), start, start + width).view(np.int64)
        return pa.RecordBatch.from_pydict({
            "anchor": anchor[who], "words": rows.column("words").to_numpy()[who], "col": col.astype(np.int32), "n": size.astype(np.int32),
            "first_key": key[first], "first_body": body[first], "first_place": place[first].astype(np.int32), "window": window})

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count > BATCH:
                rows = pa.Table.from_batches(held)
                anchor, part = rows.column("anchor").to_numpy(), rows.column("part").to_numpy()
                edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
                cut = edges[edges <= BATCH]
                cut = int(cut[-1]) if len(cut) else int(edges[0]) if len(edges) else 0
                if not cut:
                    break           # one group so far, at most CROWD or so
                yield solve(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), count - cut
        if count:
            yield solve(pa.Table.from_batches(held))

    return ship(shards).mapInArrow(run, _CLASS)


def first_places(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The anchors that repeat, and (anchor, words, col, n, first_key, first_body,
    first_place) of all their strings."""
    seams = stored(occurrences(docs).groupBy("anchor").agg(
        F.sum("times").alias("times"), *_first(), F.min("words").alias("words"), F.max("words").alias("w1"), F.max("mixed").alias("mixed"))
        .where("times > 1").select("anchor", "words", "key", "body", "place", "back", "n", (~F.col("mixed") & (F.col("words") == F.col("w1"))).alias("alike")),
        "suffix_anchors")
    mixed = seams.where("not alike").select("anchor")
    split = (occurrences(docs, hash_sketch(mixed, "anchor"), by_words=True).groupBy("anchor", "words").agg(*_first())
             .join(mixed, "anchor"))
    split = stored(split, "suffix_mixed")
    crowds = (split.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > CROWD)
              .select("anchor", F.ceil(F.col("kinds") / CROWD).alias("parts")))
    parted = split.join(crowds, "anchor", "left").withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod("words", "parts"))).drop("parts")
    wanted = seams.where("alike").drop("alike").withColumn("part", F.lit(-1).cast("long")).unionByName(parted)
    texts = strings(docs, wanted, width)
    few = texts.where("part < 0").repartition("anchor").sortWithinPartitions("anchor")
    plain = construct(few, False, width).drop("window")
    many = texts.where("part >= 0").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    crowd = stored(construct(many, True, width), "suffix_crowds")
    best = crowd.groupBy("anchor", "col", "window").agg(F.min(F.struct("first_key", "first_body", "first_place")).alias("b")).select("anchor", "col", "window", "b.*")
    merged = crowd.drop("first_key", "first_body", "first_place").join(best, ["anchor", "col", "window"]).select(*plain.columns)
    return seams.select("anchor"), stored(plain.unionByName(merged), "suffix_classes")


def _keyed(docs: DataFrame) -> tuple:
    """The number that orders a row's text, a null doc_id after all others, and the text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    late = F.lit(2 ** 62) + F.xxhash64(text).bitwiseAND(F.lit(2 ** 61 - 1))
    return F.coalesce(F.col("doc_id").cast("long"), late), F.xxhash64(text)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of the bytes that stay."""
    key, body = _keyed(docs)
    own = docs.select("doc_id", key.alias("key"), body.alias("body"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return _judged(own, _removed(own, width), width)


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (the bytes that stay; a cut may part a character) and
    ``removed`` (the runs of bytes that go). A column of ``docs`` with such a name is replaced."""
    key, body, slot, hit, hit_body, runs = [free_name(docs, f"suffix_{c}") for c in ("key", "body", "slot", "hit", "hit_body", "runs")]
    number, digest = _keyed(docs)
    named = docs.withColumns({key: number, body: digest}).withColumn(slot, sketch_slot(F.col(key)))
    own = named.select("doc_id", F.col(key).alias("key"), F.col(body).alias("body"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    lists = _removed(own, width)
    sketch = document_sketch(lists, "hit")
    lists = lists.withColumnsRenamed({"hit": hit, "hit_body": hit_body, "runs": runs})

    def cut(block: t.Block) -> list:
        marked = _covered(block, runs, width)
        left = np.concatenate([[0], np.cumsum(np.diff(block.offsets) - t.per_document(marked, block.offsets))]).tolist()
        raw = block.data[~marked].tobytes()
        return [pa.array([raw[a:b] for a, b in zip(left, left[1:])], pa.binary()), t.runs_per_document(marked, block.offsets)]

    return add_with_hits(named, lists, {key: hit, body: hit_body}, sketch, slot, cut,
                         [StructField("kept", BinaryType()), StructField("removed", SPANS)], docs.columns)


def _removed(own: DataFrame, width: int) -> DataFrame:
    """(hit, hit_body, runs): per text with hits, the (start, n) of the windows that start earlier."""
    anchors, places = first_places(own, width)
    again = occurrences(own, hash_sketch(anchors, "anchor"), every=True).select("anchor", "words", "key", "body", "place")
    met = again.join(places, ["anchor", "words"]).withColumn("start", F.col("place") + F.col("col"))
    twins = stored(own.groupBy("key").agg(F.min("body").alias("b0"), F.max("body").alias("b1")).where("b0 < b1").select("key"), "suffix_twins")
    before = "first_key < key or (first_key = key and first_place < place)"
    if twins.isEmpty():
        gone = met.where(before).select("key", "body", "start", "n")
    else:
        met = stored(met.join(twins.withColumn("twin", F.lit(True)), "key", "left"), "suffix_met")
        plain = met.where(f"(twin is null or first_key < key) and ({before})").select("key", "body", "start", "n")
        gone = plain.unionByName(_again_in_text(met.where("twin and first_key = key")))
    return stored(gone.groupBy(F.col("key").alias("hit"), F.col("body").alias("hit_body"))
                  .agg(F.collect_set(F.struct("start", "n")).alias("runs")), "suffix_removed")


def _again_in_text(met: DataFrame) -> DataFrame:
    """(key, body, start, n) of the windows that start earlier in the same text, for texts
    that share the id of their classes' first document: window by window, as the first place
    of a class may be in another text."""
    each = (met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select("key", "body", "first_body", (F.col("first_place") + F.col("col") + F.col("i")).alias("first_start"), (F.col("start") + F.col("i")).alias("start")))
    own = ["key", "body", "first_body", "first_start"]
    least = stored(each.groupBy(*own).agg(F.min("start").alias("s0"), F.max("start").alias("s1")).where("s0 < s1").drop("s1"), "suffix_twin_windows")
    return each.join(least, own).where("s0 < start").select("key", "body", "start", F.lit(1).alias("n"))


def _covered(block: t.Block, name: str, width: int) -> np.ndarray:
    """Whether each byte of a block stands in a window of the column ``name``."""
    runs = block.column(name)
    count = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = runs.flatten()
    doc = np.repeat(np.arange(len(block)), count)
    start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + block.offsets[doc]
    n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.zeros(len(block.data) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _judged(own: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """A text without hits is judged where it is read; the others, by a sketch, are shuffled
    to meet their hits."""
    sketch = document_sketch(lists, "hit")
    fields = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())]

    def plain(block: t.Block) -> list:
        near = in_sketch(sketch, block.ids("slot"))
        raw, off = block.data.tobytes(), block.offsets.tolist()
        kept = [None if k else hashlib.sha256(raw[a:b]).hexdigest() for k, a, b in zip(near.tolist(), off, off[1:])]
        rest = [raw[a:b] if k else None for k, a, b in zip(near.tolist(), off, off[1:])]
        zero = np.zeros(len(block), np.int64)
        return [np.diff(block.offsets), zero, zero, pa.array(kept, pa.string()), pa.array(rest, pa.binary())]

    passed = add_columns(own.withColumn("slot", sketch_slot(F.col("key"))), plain, fields + [StructField("rest", BinaryType())], ["doc_id", "key", "body"])
    met = passed.join(lists, (F.col("key") == F.col("hit")) & (F.col("body") == F.col("hit_body")), "left").withColumnsRenamed({f.name: f"old_{f.name}" for f in fields})

    def final(block: t.Block) -> list:
        gone = _covered(block, "runs", width)
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        firsts = block.offsets[:-1][np.diff(block.offsets) > 0]
        begin[firsts] = gone[firsts]
        removed, spans = t.per_document(gone, block.offsets), t.per_document(begin, block.offsets)
        left = np.concatenate([[0], np.cumsum(np.diff(block.offsets) - removed)]).tolist()
        raw, old = block.data[~gone].tobytes(), block.column("old_kept_sha256").to_pylist()
        kept = [o if o is not None else hashlib.sha256(raw[a:b]).hexdigest() for o, a, b in zip(old, left, left[1:])]
        return [block.ids("old_n_bytes"), removed, spans, pa.array(kept)]

    return add_columns(met, final, fields, ["doc_id"], text="rest")
