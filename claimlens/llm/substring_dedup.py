"""Substring deduplication by level-wise doubling.

A word window that repeats in another document can only be part of a repeated window of
twice the length if it does so at its own length; so only windows that repeat are extended.

Level ``half`` (25 words): of all 25-word windows, each text keeps those that are the least
by hash among the 25-word windows of some 50-word window (the leftmost of equals). The choice
depends on the words alone, so equal 50-word windows name the same anchor, about one window
in thirteen. Each anchor carries the run of 50-word windows that name it, and a hash of the
run's words. Anchors that stand in one document alone die here.

Level 50: where all runs of an anchor have the same words, its windows repeat exactly where
the anchor does, and take its least doc_id. Where the runs differ, their windows are listed
and counted one by one.

Higher levels (100, 200, ...): as long as the text goes on and a window repeats in another
document, its length doubles; ``longest`` is the last length that did. Every repeated window is
extended, but for those that need not be: where all runs of an anchor have the same words, a
document that repeats a longer window from a later start of the run repeats it from the first
start as well. The lengths of a start are hashed in one pass over the text; each level
shuffles the survivors of the one before. What is removed is settled at level 50: a word of a
longer repeated window stands in a repeated 50-word window.

Least values come from partial aggregation and go back by a join, so a passage in a third of
all documents is never gathered in a task. Texts are shuffled only for documents that a fixed
sketch of the hit ids lets through.

Defined results: a null or empty text has no words; a text of fewer words than a window loses
none; documents are compared by doc_id, so rows with the same doc_id never remove each other's
words; a null doc_id is larger than any other. A row is found again by its doc_id and the hash
of its text (``body``), so rows that share an id but not the text are kept apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from claimlens.functions.lineage import buckets_for
from claimlens.llm import _text as t
from claimlens.llm._spark import (SPANS, add_columns, add_with_hits, document_sketch, emit_rows, free_name, hash_sketch, hash_slots, in_sketch, ship,
                                  sketch_slot, stored)

WIDTH = 50
#: stands for a null doc_id
LAST = 2 ** 63 - 1
#: an intermediate table has at most a file for so many bytes of the documents' files, and for so
#: many of its rows, which are short: each file that a task writes starts a process beside the JVM
FILE_BYTES, FILE_ROWS = 16 << 20, 400_000


def _held(df: DataFrame, name: str, files: int, at_most: int | None = None) -> DataFrame:
    """``df``, stored in ``files`` files at most, and in no more than ``at_most`` rows need."""
    return stored(df, name, files=files if at_most is None else min(files, max(1, -(-at_most // FILE_ROWS))))


def _words(block: t.Block):
    starts, ends, first = t.words(block.data, block.offsets, t.NOT_SPACE)
    return t.word_hashes(block.data, starts, ends), starts, ends, first


def _runs(hashes: np.ndarray, first: np.ndarray, width: int):
    """Runs of windows that name the same anchor: anchor hash, document, first window
    (word number in the block), number of windows."""
    half = width // 2
    at, doc = t.windows(first, width)
    if not len(at):
        return None
    each = np.arange(len(hashes) - half + 1)
    small = t.range_hashes(hashes, each, each + half)
    anchor = t.sliding_argmin(small, width - half + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    k = np.flatnonzero(new)
    return small[anchor[k]], doc[k], at[k], np.diff(np.append(k, len(at))), anchor[k]


def anchors(docs: DataFrame, sketch: bytes | None = None, width: int = WIDTH) -> DataFrame:
    """(anchor, doc_id, body, start, n, words): level ``width // 2``. ``start`` counts words in
    the document; ``words`` is the hash of all words of the run, and where the anchor lies in it.
    ``sketch`` lets through the anchors in it and a few more."""

    def fn(block: t.Block) -> dict | None:
        hashes, _, _, first = _words(block)
        runs = _runs(hashes, first, width)
        if runs is None:
            return None
        if sketch is not None:
            near = in_sketch(sketch, hash_slots(runs[0]))
            runs = [x[near] for x in runs]
        anchor, doc, at, n, place = runs
        words = t.range_hashes(hashes, at, at + n + width - 1) ^ t.mix((place - at).astype(t.U64))
        return {"anchor": anchor.view(np.int64), "doc_id": block.ids()[doc], "body": block.ids("body")[doc],
                "start": (at - first[doc]).astype(np.int32), "n": n.astype(np.int32), "words": words.view(np.int64)}

    return emit_rows(docs, fn, "anchor long, doc_id long, body long, start int, n int, words long")


def _with_runs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, body, text, runs) of the documents of ``rows``; ``runs`` holds their (start, n),
    as long as the text at most. A sketch lets through the texts to be shuffled: all that are
    needed, and a few more."""
    sketch = document_sketch(rows, "body")
    slots = docs.select("doc_id", "body", "text", sketch_slot(F.col("body")).alias("slot"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_sketch(sketch, batch.column(3).to_numpy(zero_copy_only=False)))).drop_columns(["slot"])

    return ship(slots).mapInArrow(run, "doc_id long, body long, text binary").join(_lists(rows), ["doc_id", "body"])


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def _listed(block: t.Block, first: np.ndarray, width: int, name: str = "runs"):
    """Word numbers (over the block) of the windows in the column ``name`` and their documents,
    then the same of the runs' first windows."""
    runs = block.column(name)
    count = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = runs.flatten()
    start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(block)), count)
    return t.ragged(start + first[doc], n), np.repeat(doc, n), start + first[doc], doc


def windows_of(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, doc_id, body, start) of the listed windows of (doc_id, body, text, runs)."""

    def fn(block: t.Block) -> dict:
        hashes, _, _, first = _words(block)
        at, doc, _, _ = _listed(block, first, width)
        return {"window": t.range_hashes(hashes, at, at + width).view(np.int64), "doc_id": block.ids()[doc],
                "body": block.ids("body")[doc], "start": (at - first[doc]).astype(np.int32)}

    return emit_rows(texts, fn, "window long, doc_id long, body long, start int")


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, body, start, n, least): runs of windows that also start in another document;
    ``least`` is the smallest doc_id with them. ``docs``: (doc_id without nulls, body, text)."""
    files = buckets_for(docs, FILE_BYTES)
    spread = _held(anchors(docs, width=width).groupBy("anchor")
                    .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("words").alias("w0"), F.max("words").alias("w1"))
                    .where("least < most").select("anchor", "least", (F.col("w0") == F.col("w1")).alias("alike")), "substring_anchors", files)
    again = anchors(docs, hash_sketch(spread, "anchor"), width).drop("words")
    alive = _held(again.join(spread, "anchor").select("doc_id", "body", "start", "n", "least", "alike"), "substring_alive", files)
    alike = alive.where("alike").select("doc_id", "body", "start", "n", "least")
    mixed = alive.where("not alike").select("doc_id", "body", "start", "n")
    listed = _held(windows_of(_with_runs(docs, mixed), width), "substring_windows", files)
    n = listed.count()
    # stored, so that the join below has an exchange of its own on either side and a window that
    # very many documents share can be split
    least = _held(listed.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                  .where("least < most").select("window", "least"), "substring_shared", files, n // 2)
    single = listed.join(least, "window").select("doc_id", "body", "start", F.lit(1).alias("n"), "least")
    return _held(alike.unionByName(single), "substring_repeats", files, alive.count() + n)


def _longer(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, body, windows): for each listed start, the hashes of the windows of 2, 4, 8, ...
    times ``width`` words, while the text goes on."""

    def fn(block: t.Block) -> dict:
        hashes, _, _, first = _words(block)
        _, _, at, doc = _listed(block, first, width)
        room, order, found, size = first[doc + 1] - at, [], [], 2 * width
        who = np.arange(len(at))
        while (room[who] >= size).any():
            who = who[room[who] >= size]
            order.append(who)
            found.append(t.range_hashes(hashes, at[who], at[who] + size))
            size *= 2
        owner = np.concatenate([np.zeros(0, np.int64), *order])
        values = np.concatenate([np.zeros(0, t.U64), *found])
        by = np.argsort(owner, kind="stable")       # shorter windows first
        offsets = np.searchsorted(owner[by], np.arange(len(at) + 1)).astype(np.int32)
        return {"doc_id": block.ids()[doc], "body": block.ids("body")[doc],
                "windows": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[by].view(np.int64)))}

    return emit_rows(texts, fn, "doc_id long, body long, windows array<long>")


def longest_repeats(docs: DataFrame, repeats: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, body, longest): the last length, doubling from ``width``, at which a window of
    the document repeats in another document."""
    own = ["doc_id", "body"]
    starts = repeats.select(*own, "start", F.lit(1).alias("n"))
    files = buckets_for(docs, FILE_BYTES)
    level, alive = 0, _longer(_with_runs(docs, starts), width)
    out = repeats.select(*own, F.lit(width).cast("long").alias("longest"))
    while True:
        candidates = alive.where(F.size("windows") > level).withColumn("window", F.col("windows")[level])
        if not level:
            candidates = _held(candidates, "substring_longer", files)
            left = candidates.count()
        many = _held(candidates.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                     .where("least < most").select("window"), "substring_shared", files, left // 2)
        alive = _held(candidates.join(many, "window").drop("window"), "substring_level", files, left)
        left = alive.count()
        if not left:
            return out.groupBy(*own).agg(F.max("longest").alias("longest"))
        level += 1
        out = out.unionByName(alive.select(*own, F.lit(width << level).cast("long").alias("longest")))


def dedup(docs: DataFrame, width: int = WIDTH, levels: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the words that stay,
    joined by one space, as UTF-8), and ``longest`` (null: nothing repeats; only with ``levels``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("body"),
                      text.cast("binary").alias("text"))
    repeats = repeated_runs(own, width)
    digest = _judged(own, repeats.where("least < doc_id").select("doc_id", "body", "start", "n"), width)
    if levels:
        digest = digest.join(longest_repeats(own, repeats, width), ["doc_id", "body"], "left")
    return digest.drop("body").withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (the words that stay, joined by one space) and ``removed``
    (the runs of words that go, by word number). A column of ``docs`` with such a name is replaced."""
    key, body, slot, hit, hit_body, runs = [free_name(docs, f"substring_{c}") for c in ("key", "body", "slot", "hit", "hit_body", "runs")]
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), body: F.xxhash64(text)}).withColumn(slot, sketch_slot(F.col(body)))
    own = named.select(F.col(key).alias("doc_id"), F.col(body).alias("body"), text.cast("binary").alias("text"))
    gone = repeated_runs(own, width).where("least < doc_id").select("doc_id", "body", "start", "n")
    lists = stored(_lists(gone).withColumnsRenamed({"doc_id": hit, "body": hit_body, "runs": runs}), "substring_removed")

    def cut(block: t.Block) -> list:
        starts, ends, first = t.words(block.data, block.offsets, t.NOT_SPACE)
        marked = t.cover(_listed(block, first, width, runs)[0], width, len(starts))
        raw, kept = block.data.tobytes(), []
        for lo, hi in zip(first.tolist(), first[1:].tolist()):
            stay = np.flatnonzero(~marked[lo:hi]) + lo
            kept.append(b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
        return [pa.array(kept, pa.string()), t.runs_per_document(marked, first)]

    return add_with_hits(named, lists, {key: hit, body: hit_body}, document_sketch(lists, hit_body), slot, cut,
                         [StructField("kept", StringType()), StructField("removed", SPANS)], docs.columns)


def _judged(own: DataFrame, removed: DataFrame, width: int) -> DataFrame:
    """A text without hits is judged where it is read, and goes on as its digest; only
    texts that the sketch lets through are shuffled to meet their hits."""
    sketch = document_sketch(removed, "body")
    slots = own.withColumn("slot", sketch_slot(F.col("body")))

    def digests(block: t.Block, gone) -> list:
        hashes, starts, ends, first = _words(block)
        stay = np.ones(len(starts), bool) if gone is None else ~t.cover(gone(first), width, len(starts))
        n = first[1:] - first[:-1]
        left = t.per_document(stay, first)
        raw, out = block.data.tobytes(), []
        a, b, own_first = starts[stay].tolist(), ends[stay].tolist(), np.cumsum(left) - left
        for lo, k in zip(own_first.tolist(), left.tolist()):
            out.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(a[lo:lo + k], b[lo:lo + k])])).hexdigest())
        return [n, n - left, pa.array(out)]

    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]

    def plain(block: t.Block) -> list:
        near = in_sketch(sketch, block.ids("slot"))
        if near.all():
            return [np.zeros(len(block), np.int64), np.zeros(len(block), np.int64), pa.nulls(len(block), pa.string()), block.column("text")]
        cols = digests(block, None)
        return [*cols[:2], cols[2] if not near.any() else pa.array(np.where(near, None, cols[2].to_numpy(zero_copy_only=False)), pa.string()),
                pa.array([x if k else None for x, k in zip(block.column("text").to_pylist(), near)], pa.binary())]

    first_pass = add_columns(slots, plain, fields + [StructField("rest", BinaryType())], ["doc_id", "body"])
    met = (first_pass.join(_lists(removed), ["doc_id", "body"], "left")
           .withColumnsRenamed({"n_words": "n0", "n_removed": "r0", "kept_sha256": "k0"}))

    def final(block: t.Block) -> list:
        n, gone, kept = digests(block, lambda first: _listed(block, first, width)[0])
        done = block.column("k0").is_valid().to_numpy(zero_copy_only=False)
        old = block.column("k0").to_pylist()
        return [np.where(done, block.ids("n0"), n), np.where(done, block.ids("r0"), gone),
                pa.array([o if d else k for o, d, k in zip(old, done.tolist(), kept.to_pylist())])]

    return add_columns(met, final, fields, ["doc_id", "body"], text="rest")
