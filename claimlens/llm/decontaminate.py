"""Benchmark decontamination with training suffix arrays.

Each block of training documents (a shard of bounded size) gets a suffix array over
its words; each different window of the benchmark is binary-searched in it, over all its
words. The ranges of different windows do not overlap, so a block has at most as many places
as words, however often a window repeats on either side. From a place the longest match is
found by bisecting the items' sorted suffixes with that window. Documents that hold any window of ``width`` words of an item (items of fewer
words: the whole item) are contaminated.

``matches`` lists the matches themselves: from each word where a window stands, the longest one
with an item that has it, less those that lie inside one that began before. A document thus has
at most as many as words, however many items share a window (``item_ids`` has them all).

Only the benchmark, the stated query set, is sent to the tasks, in blocks of at most
``QUERY_BYTES`` of text each; a task holds one block at a time. Documents are never
shuffled: a document's hits, in whatever shard order, are decided in its own row.

Words are compared by 64-bit hashes, longer matches by hashes of them; suffixes are ordered by those hashes, which is
as good an order as the alphabet's for finding equal runs.

Defined results: a null or empty text has no words and no hits; a null or empty item
has no window; an item_id that occurs twice counts once; an empty benchmark hits
nothing; repeated documents are judged alike; of several items with an equally long match at
a word, one is named; columns of ``docs`` that are named as an added one are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from claimlens.llm import _text as t
from claimlens.llm._spark import add_columns, free_name

#: benchmark text of one query block
QUERY_BYTES = 8 << 20
#: words that one sort key of a suffix holds at most
DEPTH = 4


@dataclass
class QueryBlock:
    """Benchmark windows. ``suffixes`` are their places in ``hashes`` (all words), sorted by the
    words up to the item's end (``stop``; it begins at ``begin`` and is ``names[owner]``), windows of
    full width first. Window g, each different
    one once, has ``size[g]`` words, stands at ``suffixes[group[g]:group[g + 1]]``, and in the
    items ``item[held[g]:held[g + 1]]`` (places in ``names``)."""

    hashes: np.ndarray
    suffixes: np.ndarray
    stop: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    group: np.ndarray
    size: np.ndarray
    held: np.ndarray
    item: np.ndarray
    names: list[str]
    width: int


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = t.LOWER[data]
    starts, ends, first = t.words(data, offsets, t.ALNUM)
    return t.word_hashes(data, starts, ends), first


def _query_block(rows: list, width: int) -> QueryBlock:
    data, off = t.bytes_of(pa.array([r[1] or "" for r in rows], pa.string()))
    hashes, first = _hash_words(data, off)
    n = first[1:] - first[:-1]
    order, _ = suffix_array(hashes, first)
    item = np.searchsorted(first, order, "right") - 1
    size = np.minimum(n, width)[item]
    starts = first[1:][item] - order >= size
    starts &= (n[item] >= width) | (order == first[:-1][item])
    order, item, size = order[starts], item[starts], size[starts]
    by = np.argsort(size < width, kind="stable")
    order, item, size = order[by], item[by], size[by]
    fresh = np.ones(len(order), bool)
    fresh[1:] = size[1:] != size[:-1]
    for k in range(width):
        same = np.flatnonzero(~fresh)
        same = same[size[same] > k]
        fresh[same] = hashes[order[same] + k] != hashes[order[same - 1] + k]
    group = np.flatnonzero(fresh)
    pair = np.unique((np.cumsum(fresh) - 1) * max(len(rows), 1) + item)
    held = np.searchsorted(pair // max(len(rows), 1), np.arange(len(group) + 1))
    return QueryBlock(hashes, order, first[1:][item], first[:-1][item], item, np.append(group, len(order)), size[group], held, pair % max(len(rows), 1),
                      [str(r[0]) for r in rows], width)


def query_blocks(benchmark: DataFrame, width: int, limit: int = QUERY_BYTES) -> list:
    """The benchmark as broadcast query blocks, read one block at a time."""
    sc, out, rows, size = benchmark.sparkSession.sparkContext, [], [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        rows.append(r)
        size += 4 * len(r[1] or "")
        if size >= limit:
            out.append(sc.broadcast(_query_block(rows, width)))
            rows, size = [], 0
    if rows or not out:
        out.append(sc.broadcast(_query_block(rows, width)))
    return out


def _packed(ids: np.ndarray, stop: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """For each word, the first ``depth`` words from it as one key: ``bits`` each, zero after
    ``stop`` (the end of its text)."""
    n = len(ids)
    padded = np.zeros(n + depth, t.U64)
    padded[:n] = ids
    key, at = np.zeros(n, t.U64), np.arange(n)
    for k in range(depth):
        key = (key << t.U64(bits)) | np.where(at + k < stop, padded[k:n + k], t.U64(0))
    return key


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The different words in order, each word's number among them from 1, the bits of a
    number, and how many numbers make a key."""
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    bits = max(len(vocabulary).bit_length(), 1)
    return vocabulary, ids.astype(np.int64) + 1, bits, min(64 // bits, DEPTH)


def suffix_array(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (word numbers) in order, and the sort key of each. A suffix ends with its
    document. Ties after the words of a key are split by the ranks of the suffixes as many, then
    twice as many, ... words on, until every suffix has its place."""
    return _suffixes(*_numbered(hashes)[1:], first)


def _suffixes(ids: np.ndarray, bits: int, depth: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    stop = np.repeat(first[1:], first[1:] - first[:-1])
    key = _packed(ids, stop, bits, depth)
    order = np.argsort(key, kind="stable")
    keys = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = keys[1:] != keys[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]       # the first place of its group
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        who = order[places]
        ahead = np.where(who + depth < stop[who], rank[np.minimum(who + depth, n)], -1)
        if not (ahead >= 0).any():
            break       # equal to the end of their documents
        again = np.lexsort((who, ahead, rank[who]))
        who, ahead = who[again], ahead[again]
        group = rank[who]
        order[places] = who
        now = np.ones(len(who), bool)
        now[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        if (now == fresh[places]).all():
            break
        fresh[places] = now
        rank[who] = places[np.flatnonzero(now)[np.cumsum(now) - 1]]
        depth *= 2
    return order, keys


def _bound(words: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, stop: np.ndarray, order: np.ndarray,
           lo: np.ndarray, hi: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """For each window ``words[at:at + size]`` the first place in ``order[lo:hi]``, whose suffixes
    have its first ``depth`` words, that is not before it (``right``: that is after all of its)."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        place, sign, undecided = order[mid], np.zeros(len(live), np.int64), np.arange(len(live))
        for k in range(depth, int(size.max())):
            undecided = undecided[(sign[undecided] == 0) & (size[live[undecided]] > k)]
            if not len(undecided):
                break
            p = place[undecided] + k
            there = np.where(p < stop[place[undecided]], ids[np.minimum(p, len(ids) - 1)], 0)
            sign[undecided] = there - words[at[live[undecided]] + k]
        on = sign <= 0 if right else sign < 0
        lo[live[on]], hi[live[~on]] = mid[on] + 1, mid[~on]
        live = live[lo[live] < hi[live]]
    return lo


class _Hashed:
    """Hashes of any ranges of ``values``, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = t._powers(0xD1342543DE82EF95, max(10, len(values).bit_length()))
        self.total = np.zeros(len(values) + 1, t.U64)
        np.cumsum(values * up[:len(values)], out=self.total[1:])

    def __call__(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.down[start]


def _longest(q: QueryBlock, window: np.ndarray, place: np.ndarray, hashes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest match from each place, where a window of full width was found, with any
    suffix of that window's, and that suffix: the neighbours of its place in their order have it."""
    ours, theirs = _Hashed(hashes), _Hashed(q.hashes)
    lo, hi, longest = q.group[window], q.group[window + 1], np.zeros(len(place), np.int64)
    live, which = np.arange(len(place)), lo.copy()
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        a, b = place[live], q.suffixes[mid]
        room_a, room_b = stop[a] - a, q.stop[mid] - b
        room, common = np.minimum(room_a, room_b), np.full(len(live), q.width)
        for k in range(int(room.max()).bit_length(), -1, -1):
            who = np.flatnonzero(common + (1 << k) <= room)
            who = who[ours(a[who] + common[who], 1 << k) == theirs(b[who] + common[who], 1 << k)]
            common[who] += 1 << k
        more = common > longest[live]
        longest[live[more]], which[live[more]] = common[more], mid[more]
        full = common == room
        x, y = (v[np.minimum(i + common, len(v) - 1)] for v, i in ((hashes, a), (q.hashes, b)))
        before = np.where(full, room_b < room_a, y < x)         # the item's suffix is before the document's
        lo[live[before]], hi[live[~before]] = mid[before] + 1, mid[~before]
        live = live[lo[live] < hi[live]]
    return longest, which


def search(q: QueryBlock, hashes: np.ndarray, first: np.ndarray, numbered: tuple, order: np.ndarray, keys: np.ndarray):
    """Every verbatim occurrence of each different window: (window, word number, length of the
    longest match from there with an item that holds the window, place of that item's suffix)."""
    if not len(q.size) or not len(hashes):
        return (np.zeros(0, np.int64),) * 4
    vocabulary, ids, bits, depth = numbered
    stop = np.repeat(first[1:], first[1:] - first[:-1])
    at = np.minimum(np.searchsorted(vocabulary, q.hashes), len(vocabulary) - 1)
    words = np.where(vocabulary[at] == q.hashes, at + 1, 0)
    strange = np.concatenate([[0], np.cumsum(words == 0)])
    start = q.suffixes[q.group[:-1]]
    known = np.flatnonzero(strange[start + q.size] == strange[start])
    start, size = start[known], q.size[known]
    low = _packed(words, np.full(len(words), len(words)), bits, depth)[start]
    free = (bits * np.maximum(depth - size, 0)).astype(t.U64)       # bits that a short window leaves open
    wide = (t.U64(1) << free) - t.U64(1)
    low &= ~wide
    lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, low | wide, "right")
    some = np.flatnonzero(lo < hi)
    known, start, size, lo, hi = (x[some] for x in (known, start, size, lo, hi))
    lo = _bound(words, start, size, ids, stop, order, lo, hi, depth, False)
    hi = _bound(words, start, size, ids, stop, order, lo, hi, depth, True)
    window, place = np.repeat(known, hi - lo), order[t.ragged(lo, hi - lo)]
    length, which = q.size[window], q.group[window]
    full = np.flatnonzero(length == q.width)
    if len(full):
        # an item of just the full width is sorted with the longer ones
        length[full], which[full] = _longest(q, window[full], place[full], hashes, stop)
    return window, place, length, which


#: (document, item) pairs that are made at a time
PAIRS = 1 << 20


def _items(q: QueryBlock, doc: np.ndarray, window: np.ndarray, found: list[set]) -> None:
    """Adds to ``found`` the items of each document's windows, each different window once."""
    pair = np.unique(doc * len(q.size) + window)
    doc, window = pair // len(q.size), pair % len(q.size)
    count = q.held[window + 1] - q.held[window]
    upto = np.cumsum(count)
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - count[a] + PAIRS, "right")))
        n = count[a:b]
        both = np.unique(np.repeat(doc[a:b], n) * len(q.names) + q.item[t.ragged(q.held[window[a:b]], n)])
        for d, i in zip((both // len(q.names)).tolist(), (both % len(q.names)).tolist()):
            found[d].add(q.names[i])
        a = b


class _Best:
    """The longest match from each word of a block of documents, over the query blocks."""

    def __init__(self, n: int):
        self.length, self.item, self.at, self.names = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), []

    def add(self, q: QueryBlock, place: np.ndarray, length: np.ndarray, which: np.ndarray) -> None:
        by = np.argsort(length, kind="stable")
        by = by[length[by] > self.length[place[by]]]
        place, length, which = place[by], length[by], which[by]         # of one place, the longest is last and stays
        self.length[place] = length
        self.item[place], self.at[place] = len(self.names) + q.owner[which], q.suffixes[which] - q.begin[which]
        self.names += q.names

    def listed(self, first: np.ndarray) -> pa.ListArray:
        """Per document, the matches that are not inside one that began before."""
        start = np.flatnonzero(self.length)
        end = start + self.length[start]
        reach = np.maximum.accumulate(np.concatenate([[0], end]))[:-1]
        start = start[end > reach]
        doc = np.searchsorted(first, start, "right") - 1
        upto = np.searchsorted(start, first).astype(np.int32)
        names = pa.array(self.names, pa.string()).take(pa.array(self.item[start]))
        return pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays(
            [names, pa.array(start - first[doc]), pa.array(self.length[start]), pa.array(self.at[start])], MATCH.names))


def _judge(blocks: list, wanted: list[str]):
    listing = {"n_items", "item_ids", "matches"} & set(wanted)

    def fn(block: t.Block) -> list:
        hashes, first = _hash_words(block.data, block.offsets)
        numbered = _numbered(hashes)
        order, keys = _suffixes(*numbered[1:], first)
        docs = len(block)
        starts, sizes, found, longest = [], [], [set() for _ in range(docs)], np.zeros(docs, np.int64)
        best = _Best(len(hashes))
        for held in blocks:
            q = held.value
            window, place, length, which = search(q, hashes, first, numbered, order, keys)
            doc = np.searchsorted(first, place, "right") - 1
            np.maximum.at(longest, doc, length)
            starts.append(place)
            sizes.append(q.size[window])
            if listing and len(window):
                _items(q, doc, window, found)
                best.add(q, place, length, which)
            if len(blocks) > 1:
                held.unpersist_value()
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, np.concatenate(starts), 1)
        np.add.at(edge, np.concatenate(starts) + np.concatenate(sizes), -1)
        hit = np.cumsum(edge[:-1]) > 0
        made = {"n_words": first[1:] - first[:-1], "n_hit": t.per_document(hit, first), "longest_match": longest}
        if listing:
            made |= {"n_items": np.array([len(x) for x in found], np.int64), "matches": best.listed(first),
                     "item_ids": pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
        return [made[c] for c in wanted]

    return fn


class _Held:
    """A broadcast query block whose local copy can be let go between uses."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> QueryBlock:
        return self.broadcast.value

    def unpersist_value(self) -> None:
        if hasattr(self.broadcast, "_value"):
            del self.broadcast._value


#: a match: its item, its first word in the document and its words, its first word in the item
MATCH = StructType([StructField("item_id", StringType()), StructField("start", LongType()),
                    StructField("length", LongType()), StructField("item_start", LongType())])

COLUMNS = {"n_words": LongType(), "n_hit": LongType(), "longest_match": LongType(), "n_items": LongType(),
           "item_ids": ArrayType(StringType()), "matches": ArrayType(MATCH)}


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: list[str] | None = None,
            names: dict[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with, per row: n_words, n_hit (words inside any
    occurrence of a window), longest_match (words), n_items, item_ids (sorted; the items with
    occurring windows), matches (by start; see MATCH and above). ``names``: the names of the
    columns that are wanted; default: all, by their own."""
    names = names or {c: c for c in COLUMNS}
    held = [_Held(b) for b in query_blocks(benchmark, width)]
    return add_columns(docs, _judge(held, list(names)), [StructField(n, COLUMNS[c]) for c, n in names.items()], keep)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    hit = free_name(docs, "benchmark_n_hit")
    return matches(docs, benchmark, width, names={"n_hit": hit}).where(F.col(hit) == 0).select(*docs.columns)
