"""Array helpers for text inside Arrow tasks.

A task sees Arrow batches; ``blocks`` cuts them into pieces of bounded byte
size, so that the work arrays of a task stay small whatever the partition.
Every helper works on a whole block at once (all its documents), never on
prefixes, and never lets a word, n-gram or window reach across documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
U64 = np.uint64


def table_of(chars: bytes) -> np.ndarray:
    """256 booleans: which byte values are in ``chars``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: word bytes of `[^\x20\x09-\x0D]+`
NOT_SPACE = ~table_of(b" \t\n\x0b\x0c\r")
#: word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = table_of(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
#: byte map that lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Consecutive documents: ``data`` holds their bytes, document i spans
    ``offsets[i]:offsets[i+1]``; ``rows`` is the Arrow slice it came from."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def ids(self, name: str = "doc_id") -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a binary or string Arrow array; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``limit`` text bytes (one larger document stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = bytes_of(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield Block(batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i])
            i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word of a block, and ``first``: document i has
    words ``first[i]:first[i+1]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below 2^bits."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(1, U64)
        for _ in range(bits):
            p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """64-bit hash of every ``values[starts:ends]`` from one prefix sum; equal
    ranges hash alike wherever they stand."""
    n = len(values)
    up, down = _powers(base, max(10, int(n).bit_length()))
    total = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(_BYTE_VALUE[data], starts, ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index of each window of ``size`` items inside one document, and its
    document's number."""
    n = np.maximum(first[1:] - first[:-1] - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n), doc


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``values[i:i+width]``, by the upper 32 bits of the
    values, the leftmost of equals (windows that would run over the end are left out).
    The lower half holds the position meanwhile, so one running minimum gives both."""
    key = (values & U64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=U64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:len(key) - step], key[step:])
        have += step
    return (key & U64(0xFFFFFFFF)).astype(np.int64)


def cover(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Booleans over ``total`` items: which stand in a window of ``length`` at one of ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges starts[i] .. starts[i]+lengths[i]-1."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(np.asarray(starts, np.int64) - ends + lengths, lengths)
    out += np.arange(total)
    return out


def runs_per_document(marked: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Per document, the (start, end) of its maximal marked runs, counted from its first unit, end
    exclusive. ``first``: where each document's units begin, and their number."""
    some = np.flatnonzero(np.diff(first) > 0)
    before, after = np.zeros(len(marked), bool), np.zeros(len(marked), bool)
    before[1:], after[:-1] = marked[:-1], marked[1:]
    before[first[some]] = False
    after[first[some + 1] - 1] = False
    start, end = np.flatnonzero(marked & ~before), np.flatnonzero(marked & ~after) + 1
    base = first[np.searchsorted(first, start, "right") - 1]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first).astype(np.int32)),
                                    pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"]))


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true items each document has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; does it occur at an earlier index."""
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def inside(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only within the same document of a block."""
    return mix(keys + (doc.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


LETTER_ASCII = table_of(bytes(range(65, 91)) + bytes(range(97, 123)))
