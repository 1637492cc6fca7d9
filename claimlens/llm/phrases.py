"""Phrase collocation mining with mergeable Misra-Gries summaries.

First pass: every n-gram occurrence of one to ``longest`` words is a 64-bit hash (of group
and words); hashes are dealt to partitions, and each task adds up its own occurrences per
partition. A partition's summaries are merged with ``mass / threshold + 1`` counters, where
the mass is all its occurrences: when more different keys are held, the same amount is taken
from all of them, so each loses less than the threshold in all, and no n-gram that occurs
``threshold`` times is lost. What was taken is known, so a key survives if its counter plus
that reaches the threshold. Memory of a task is bounded by the mass of a partition, whatever
the number of different n-grams.

Second pass: the texts are read again, and the n-grams whose hash survives are counted
exactly, by their words. The filter is a bit sketch of fixed size; it lets some others pass,
which the exact count then drops (when it fills up at very large inputs more is counted
and the results stay the same).

Summaries travel as 32 bits per n-gram: the partition is made from the hash's upper bits, the
key from its lower ones. A key that two n-grams share counts both, so it survives the sooner.

Scoring joins the exact counts with themselves. Arithmetic is decimal, hence exact.

Defined results: a null text is an empty one and has no words; a null group counts as ``und``;
repeated rows and rows with the same identifier count each; ties in the score go by count,
then by the phrase's bytes; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from claimlens.llm import _text as t
from claimlens.llm._spark import numbered, ship, stored

U64, U32 = np.uint64, np.uint32

#: pieces end at these bytes; words end there and at blanks
BREAK = t.table_of(b".,;:!?\n\x0b\x0c\r")
WORD = ~(BREAK | t.table_of(b" \t"))
TAB, SPACE = 9, 32

#: bytes of text behind one partition of the first pass (about as many n-grams occur per three bytes)
PART_BYTES = 16 << 20
#: bytes of text that a task works on at once (a longer document stands alone)
BLOCK = 1 << 19
#: n-grams held before a task sends what it has added up
HELD = 1 << 20
#: bits of the sketch of survivors (16 MB)
SKETCH_BITS = 1 << 27
#: n-grams whose words a task of the second pass holds
HELD_PHRASES = 1 << 19


def _seed(group: str) -> int:
    raw = np.frombuffer(f"g{group}".encode("utf-8", "surrogatepass"), np.uint8)
    return int(t.range_hashes(t.byte_values(raw), np.array([0]), np.array([len(raw)]))[0])


class Grams:
    """The n-grams of a block: ``first`` (word number), ``size``, ``hash``."""

    def __init__(self, block: t.Block, group: str, longest: int):
        data = t.LOWER[block.data]
        self.start, self.end, first = t.words(data, block.offsets, WORD)
        data[data == TAB] = SPACE
        self.data, m = data, len(self.start)
        codes = block.column(group).cast(pa.string()).fill_null("und").dictionary_encode()
        self.groups = codes.dictionary.to_pylist()
        code = codes.indices.to_numpy(zero_copy_only=False)
        self.group = np.repeat(code, np.diff(first))
        seeds = np.array([_seed(g) for g in self.groups], U64)
        word = t.word_hashes(data, self.start, self.end)
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[data], out=breaks[1:])
        joined = np.zeros(m, bool)      # the word after this one stands in the same piece
        if m > 1:
            joined[:-1] = breaks[self.end[:-1]] == breaks[self.start[1:]]
            ends = first[1:-1]
            joined[ends[(ends > 0) & (ends <= m)] - 1] = False
        self.words_of = np.bincount(self.group, minlength=len(self.groups))
        here, hashed = np.arange(m), t.mix(word ^ seeds[self.group]) if m else np.zeros(0, U64)
        self.first, self.hash, self.size = [here], [hashed], [np.full(m, 1, np.int8)]
        for n in range(2, longest + 1):
            go = joined[here + n - 2]
            here, hashed = here[go], hashed[go]
            hashed = t.mix(hashed * U64(0x9E3779B97F4A7C15) + word[here + n - 1])
            self.first.append(here)
            self.hash.append(hashed)
            self.size.append(np.full(len(here), n, np.int8))
        self.first, self.hash, self.size = map(np.concatenate, (self.first, self.hash, self.size))

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words of the n-grams ``at``, joined by one space."""
        first, size = self.first[at], self.size[at].astype(np.int64)
        word = t.ragged(first, size)
        last = np.cumsum(size) - 1
        length = self.end[word] - self.start[word] + 1      # with the blank that follows
        length[last] -= 1
        raw = self.data[t.ragged(self.start[word], length)]
        ends = np.zeros(len(at) + 1, np.int64)
        ends[1:] = np.cumsum(length)[last]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes()))


def _part(hashed: np.ndarray, parts: int) -> np.ndarray:
    return ((hashed >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def summaries(docs: DataFrame, parts: int, group: str, longest: int) -> DataFrame:
    """(part, mass, ones, many, counts): a task's n-grams of one partition, those that it
    saw once, and the others with their counts."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part, low = _part(keys, parts), (keys & U64(0xFFFFFFFF)).astype(U32)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(cut, np.append(cut[1:], len(part))):
            once = counts[a:b] == 1
            rows.append((int(part[a]), int(counts[a:b].sum()), low[a:b][once].tobytes(), low[a:b][~once].tobytes(),
                         counts[a:b][~once].astype(U32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                          ["part", "mass", "ones", "many", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in t.blocks(batches, limit=BLOCK):
            hashed = Grams(block, group, longest).hash
            if len(hashed):
                held.append(hashed)
                n += len(hashed)
            if n >= HELD:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return ship(docs.select("text", group)).mapInArrow(run, "part long, mass long, ones binary, many binary, counts binary")


class MisraGries:
    """Counters of at most ``capacity`` keys. ``taken`` is what each key may have lost."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, U32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n += len(keys)
        if self.n >= max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Adds up what is waiting; if too many keys are left, takes the count of the
        first one too many from all."""
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.n = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts
        if len(keys) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += least
            keys, counts = keys[counts > least], counts[counts > least] - least
        self.keys, self.counts = keys, counts


def survivors(summed: DataFrame, threshold: int) -> DataFrame:
    """(part, keys): of each partition, the keys that may occur ``threshold`` times or more.
    The mass is summed where a partition's summaries meet, so they travel once."""
    tasks = int(summed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (summed.repartition(tasks, "part").withColumn("all", F.sum("mass").over(Window.partitionBy("part")))
             .drop("mass").sortWithinPartitions("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            summary.settle()
            keys = summary.keys[summary.counts + summary.taken >= threshold]
            return pa.RecordBatch.from_pydict({"part": [now], "keys": [keys.tobytes()]})

        now, summary = None, None
        for batch in batches:
            part, ones, many, counts, all_ = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "ones", "many", "counts", "all"))
            for i in range(batch.num_rows):
                if part[i].as_py() != now:
                    if now is not None:
                        yield done()
                    now, summary = part[i].as_py(), MisraGries(all_[i].as_py() // threshold + 1)
                once = np.frombuffer(ones[i].as_py(), U32)
                summary.merge(once, np.ones(len(once), np.int64))
                summary.merge(np.frombuffer(many[i].as_py(), U32), np.frombuffer(counts[i].as_py(), U32).astype(np.int64))
        if now is not None:
            yield done()

    return ship(dealt).mapInArrow(run, "part long, keys binary")


def _slots(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The sketch's bit for a partition's key."""
    return (t.mix((part.astype(U64) << U64(32)) | key.astype(U64)) & U64(SKETCH_BITS - 1)).astype(np.int64)


def sketch(found: DataFrame) -> bytes:
    """A bit per survivor, of SKETCH_BITS bits whatever their number, put together in
    pieces of 8 KB."""
    wide = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = np.frombuffer(keys, U32)
                slot = np.unique(_slots(np.full(len(key), part), key))
                cut = np.flatnonzero(np.diff(slot // wide, prepend=-1))
                if len(slot):
                    yield pa.RecordBatch.from_pydict({"piece": slot[cut] // wide, "bits": [
                        (x % wide).astype(np.uint16).tobytes() for x in np.split(slot, cut[1:])]})

    return _gather(ship(found).mapInArrow(run, "piece long, bits binary"), wide)


def _gather(pieces: DataFrame, wide: int) -> bytes:
    """Pieces put together, each in a task of its own, then as one bit string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made.setdefault(piece, np.zeros(wide, bool))[np.frombuffer(bits, np.uint16)] = True
        if made:
            yield pa.RecordBatch.from_pydict({"piece": list(made), "bits": [np.packbits(x, bitorder="little").tobytes() for x in made.values()]})

    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = bytearray(SKETCH_BITS // 8)
    for r in ship(pieces.repartition(tasks, "piece")).mapInArrow(run, "piece long, bits binary").collect():      # SKETCH_BITS in all
        out[r["piece"] * wide // 8:(r["piece"] + 1) * wide // 8] = r["bits"]
    return bytes(out)


def _spans(block: t.Block, bits: np.ndarray, parts: int, group: str, longest: int) -> pa.Table:
    """(of, part, phrase, n) of a block's n-grams that are in the sketch; the empty phrase counts words."""
    g = Grams(block, group, longest)
    part = _part(g.hash, parts)
    slot = _slots(part, (g.hash & U64(0xFFFFFFFF)).astype(U32))
    pick = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
    order = pick[np.argsort(g.hash[pick], kind="stable")]
    begin = np.flatnonzero(np.append(True, g.hash[order][1:] != g.hash[order][:-1])) if len(order) else np.zeros(0, np.int64)
    one, k = order[begin], len(g.groups)
    of = pa.array(g.groups, pa.string()).take(pa.array(np.append(g.group[g.first[one]], np.arange(k))))
    return pa.table({"of": of, "part": np.append(part[one], np.zeros(k, np.int64)),
                     "phrase": pa.concat_arrays([g.texts(one).cast(pa.string()), pa.array([""] * k, pa.string())]),
                     "n": np.append(np.diff(np.append(begin, len(order))), g.words_of)})


def _summed(tables: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def counted(docs: DataFrame, bits: bytes, parts: int, group: str, longest: int, threshold: int) -> DataFrame:
    """(of, size, phrase, n) of the n-grams that occur ``threshold`` times or more, and a row
    of size 0 for each group with its number of words. A task's counts for one partition
    and group travel as one row: the phrases, a line each, and their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(held: list[pa.Table]) -> pa.RecordBatch:
        all_ = _summed(held, ["part", "of", "phrase"]).sort_by([("part", "ascending"), ("of", "ascending")])
        part, of = all_["part"].to_numpy(), all_["of"].combine_chunks().dictionary_encode()
        code = of.indices.to_numpy()
        cut = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        raw, off = t.bytes_of(all_["phrase"].combine_chunks())
        lines = np.insert(raw, off[1:], 10)     # an end after every phrase
        ends = off + np.arange(len(off))
        n = all_["n"].to_numpy().astype(np.int64)
        stop = np.append(cut[1:], len(part))
        return pa.RecordBatch.from_pydict({
            "part": part[cut], "of": of.dictionary.take(pa.array(code[cut])),
            "lines": pa.array([lines[ends[a]:ends[b]].tobytes() for a, b in zip(cut, stop)], pa.binary()),
            "counts": pa.array([n[a:b].tobytes() for a, b in zip(cut, stop)], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, rows = np.frombuffer(sent.value, np.uint8), [], 0
        for block in t.blocks(batches, limit=BLOCK):
            held.append(_spans(block, table, parts, group, longest))
            rows += held[-1].num_rows
            if rows >= HELD_PHRASES:
                yield send(held)
                held, rows = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield send(held)

    def unpack(of: str, lines: bytes, counts: bytes) -> pa.Table:
        raw = np.frombuffer(lines, np.uint8)
        ends = np.flatnonzero(raw == 10)
        off = np.append(0, ends - np.arange(len(ends))).astype(np.int32)
        text = pa.StringArray.from_buffers(len(ends), pa.py_buffer(off.tobytes()), pa.py_buffer(raw[raw != 10].tobytes()))
        return pa.table({"of": pa.repeat(pa.scalar(of, pa.string()), len(ends)), "phrase": text, "n": np.frombuffer(counts, np.int64)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            all_ = _summed(held, ["of", "phrase"])
            size = pc.if_else(pc.equal(all_["phrase"], ""), 0, pc.add(pc.count_substring(all_["phrase"], " "), 1)).cast(pa.int32())
            all_ = pa.table({"of": all_["of"], "size": size, "phrase": all_["phrase"], "n": all_["n"]})
            yield from all_.filter(pc.or_(pc.equal(size, 0), pc.greater_equal(all_["n"], threshold))).to_batches(max_chunksize=1 << 16)

        now, held, rows = None, [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if x["part"] != now:
                    if held:
                        yield from done()
                    now, held, rows = x["part"], [], 0
                held.append(unpack(x["of"], x["lines"], x["counts"]))
                rows += held[-1].num_rows
                if rows >= 4 * HELD_PHRASES:
                    held = [_summed(held, ["of", "phrase"])]
                    rows = 0
        if held:
            yield from done()

    each = ship(docs.select("text", group)).mapInArrow(count, "part long, of string, lines binary, counts binary")
    return (ship(each.repartition(tasks, "part").sortWithinPartitions("part"))
            .mapInArrow(merge, "of string, size int, phrase string, n long"))


def frequent(docs: DataFrame, group: str = "lang", longest: int = 3, threshold: int = 10) -> DataFrame:
    """(of, size, phrase, n): all phrases of up to ``longest`` words that occur ``threshold``
    times or more in their group, with their exact counts; size 0: the group's words."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(4 * tasks, -(-length // PART_BYTES))      # several for each task, so that they even out
    bits = sketch(survivors(summaries(docs, parts, group, longest), threshold))
    return stored(counted(docs, bits, parts, group, longest, threshold), "phrase_counts")


def _words(phrase, first, n):
    return F.array_join(F.slice(phrase, first, n), " ")


def collocations(docs: DataFrame, group: str = "lang", shortest: int = 2, longest: int = 3, threshold: int = 10,
                 scale: int = 1_000_000, inside_percent: int = 50) -> DataFrame:
    """(of, phrase, size, a, l, r, n, score) of all phrases that occur ``threshold`` times or more
    and do not mostly (``inside_percent``) stand inside a longer one. ``score`` is
    floor(scale * a * a / (l * r)) at the cut where that is least (of equals, the first cut)."""
    counts = frequent(docs, group, longest, threshold)
    phrases = counts.where(f"size >= {shortest}").select("of", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    # parts of candidates that a longer one mostly holds
    held = phrases.where(f"size > {shortest}").select("of", "a", "words", "size", F.explode(F.sequence(F.lit(shortest), F.col("size") - 1)).alias("m"))
    held = held.select("of", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1),
                                                        lambda i: _words(F.col("words"), i, F.col("m")))).alias("phrase"))
    held = held.groupBy("of", "phrase").agg(F.max("a").alias("longer"))
    left = (phrases.join(held, ["of", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent)).drop("longer"))

    cuts = left.select("of", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("of", "phrase", "size", "a", "k", _words(F.col("words"), F.lit(1), F.col("k")).alias("head"),
                       _words(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    known = counts.where("size > 0")
    cuts = (cuts.join(known.select("of", F.col("phrase").alias("head"), F.col("n").alias("l")), ["of", "head"])
            .join(known.select("of", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["of", "tail"]))
    wide = {c: f"cast({c} as decimal(15, 0))" for c in ("a", "l", "r")}
    score = F.expr(f"({scale} * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})")
    best = cuts.withColumn("score", score).groupBy("of", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    total = counts.where("size = 0").select("of", F.col("n").alias("n"))
    return best.join(total, "of").select("of", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def top(docs: DataFrame, group: str = "lang", most: int = 2000, **options) -> DataFrame:
    """The first ``most`` collocations of each group by score, count and phrase, with their ``rank``."""
    found = collocations(docs, group, **options).drop("size")
    ranked, _ = numbered(found, "of", [F.col("score"), F.col("a"), F.col("phrase")], "phrase_ranks", down=(0, 1))
    return ranked.where(F.col("pos") < most).withColumn("rank", F.col("pos") + 1).drop("tree", "pos", "size")
