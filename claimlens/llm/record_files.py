"""Token ids in length-delimited binary record files, with an offset index.

Record file: for each sequence, in ascending doc_id order over all files,

    u64 payload bytes | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload

all little-endian. The payload is the sequence's ids, ``width`` bytes each (2 if the
vocabulary fits, else 4). A checksum is CRC-32, masked as rotr(crc, 15) + 0xA282EAD8, so
that checksums of data that hold checksums stay good.

Index file beside it (same name, ``.idx``): ``IDX1``, u32 width, u64 records, then per
record u8 (1: doc_id is null), i64 doc_id, u64 offset in the record file, u32 ids. A
reader that shuffles takes any record by its offset, without scanning.

Every task writes files of its own, named by a fresh id, to the shared folder; its row in
the manifest says which. A task that runs again writes new files, and files without a row
in the manifest are never read, so lost executors and repeated tasks do no harm.

Words between white space are encoded once per worker and kept in a bounded memo; the
tokenizer cuts at white space itself, so this gives the ids of the whole text. Before that,
what the tokenizer does anyway is done to the bytes, so that fewer words differ: letters in
lower case (not those before a combining mark), and a space where a letter meets punctuation.

Defined results: a null or empty text is the end id alone; a null doc_id comes first;
rows with the same doc_id are sequences of their own, next to each other; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from claimlens.llm import _text as t
from claimlens.llm._spark import ship, stored
from claimlens.plans.session import ensure_checkpoint_dir

MASK_DELTA = 0xA282EAD8
HEADER = 16
INDEX = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u4")])
#: a worker keeps the ids of at most so many words, each of at most so many bytes
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64
#: stands between words that are encoded together; its own piece, hence its own ids
MARK = "\x01"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Where ``path`` (a plain path, or a URI as Spark writes it) lies."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


_PUNCT = t.table_of(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")      # no apostrophe: it may start a piece with letters
_ASCII = t.table_of(bytes(range(97, 123)))
#: special tokens begin so; a text with one stays as it is
SPECIAL = b"<|"


def simplified(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the case folded and letters parted from punctuation, where that
    leaves the ids as they are: ASCII and the Latin-1 letters (0xC3 and a second byte)."""
    n = len(data)
    if not n or SPECIAL in data.tobytes():
        return data, offsets
    after = np.append(data[1:], np.uint8(32))
    before = np.append(np.uint8(32), data[:-1])
    calm = (after < 0x80) | (after == 0xC3)
    second = (before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
    out = data.copy()
    out[(data >= 65) & (data <= 90) & calm] += 32
    out[second & (data <= 0x9E) & calm] += 32
    lead = np.append(second[1:], False)         # the first byte of a Latin-1 letter
    ascii_letter = _ASCII[t.LOWER[data]]
    ends, begins, mark = ascii_letter | second, ascii_letter | lead, _PUNCT[data]
    cut = np.flatnonzero((ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])) + 1
    shift = np.searchsorted(cut, offsets)
    return np.insert(out, cut, 32), offsets + shift


class WordEncoder:
    """Ids of whole texts by the ids of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.mark = self._ids([MARK])[0]
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.first, self.count, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.type), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes], group: int = 200) -> list[np.ndarray]:
        text = [w.decode("utf-8", "replace") for w in words]
        out: list = [None] * len(words)
        plain = [i for i, s in enumerate(text) if MARK not in s]
        if len(self.mark) != 1:
            plain = []
        groups = [plain[i:i + group] for i in range(0, len(plain), group)]
        for own, ids in zip(groups, self._ids([f" {MARK} ".join(text[i] for i in g) for g in groups])):
            ids = np.array(ids, self.type)
            cut = np.flatnonzero(ids == self.mark[0])
            for i, part in zip(own, np.split(ids, cut)):
                out[i] = part
            for i in own[1:]:
                out[i] = out[i][1:]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._ids([text[i] for i in rest])):
            out[i] = np.array(ids, self.type)
        return out

    def _remember(self, words: list[bytes]) -> None:
        parts = self._encode(words)
        n, m = len(self.memo), sum(map(len, parts))
        while n + len(words) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        counts = np.array([len(p) for p in parts], np.int64)
        self.count[n:n + len(words)] = counts
        self.first[n:n + len(words)] = self.used + np.cumsum(counts) - counts
        if m:
            self.ids[self.used:self.used + m] = np.concatenate(parts)
        self.used += m
        self.memo.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it."""
        words: list[bytes] = []
        first = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words += text.split()
            first[i + 1] = len(words)
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        new = {words[i] for i in missing}
        long = [w for w in new if len(w) > MEMO_BYTES]
        new = new.difference(long)
        if new:
            self._remember(list(new))
        if not long:
            at[missing] = [self.memo[words[i]] for i in missing]
            start, count, pool = self.first[at], self.count[at], self.ids
        else:       # long words stand behind the memo for this call alone
            parts = self._encode(long)
            where = {w: i for i, w in enumerate(long)}
            at[missing] = [self.memo[w] if w in self.memo else -1 - where[w] for w in (words[i] for i in missing)]
            counts = np.array([len(p) for p in parts], np.int64)
            begin = self.used + np.cumsum(counts) - counts
            pool = np.concatenate([self.ids[:self.used], *parts])
            back = np.maximum(-1 - at, 0)
            known = np.maximum(at, 0)
            start = np.where(at >= 0, self.first[known], begin[back])
            count = np.where(at >= 0, self.count[known], counts[back])
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        return pool[t.ragged(start, count)], ends[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _frame(ids: np.ndarray) -> bytes:
    payload = ids.tobytes()
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


MANIFEST = "path string, width int, first_id long, records long, ids long"


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, root: str | None = None) -> DataFrame:
    """Writes the sequences of ``docs`` in ascending doc_id order; returns the manifest,
    a row per record file. ``root``: a folder all executors share (default: below
    spark.checkpoint.dir). Spark's range sort makes the files' order and size."""
    root = (root or f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/claimlens").rstrip("/") + f"/records_{uuid.uuid4().hex[:12]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name, out, index = encoder(tokenizer), f"{root}/{uuid.uuid4().hex}.rec", None, []
        at = total = records = 0
        first_id = None
        for block in t.blocks(batches):
            data, off = simplified(block.data, block.offsets)
            raw, off = data.tobytes(), off.tolist()
            ids, begin = enc.encode([raw[a:b] for a, b in zip(off, off[1:])])
            end = np.array([end_id], enc.type)
            doc_ids = block.column("doc_id")
            rows = np.zeros(len(block), INDEX)
            rows["null"] = doc_ids.is_null().to_numpy(zero_copy_only=False)
            rows["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            rows["ids"] = begin[1:] - begin[:-1] + 1
            size = rows["ids"].astype(np.int64) * enc.width + HEADER
            rows["offset"] = at + np.cumsum(size) - size
            if out is None:
                fs, path = filesystem(name)
                fs.create_dir(os.path.dirname(path), recursive=True)
                out, first_id = fs.open_output_stream(path), None if rows["null"][0] else int(rows["doc_id"][0])
            out.write(b"".join(_frame(np.concatenate([ids[a:b], end])) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())))
            index.append(rows.tobytes())
            at += int(size.sum())
            total += int(rows["ids"].sum())
            records += len(block)
        if out is not None:
            out.close()
            with fs.open_output_stream(path[:-4] + ".idx") as side:
                side.write(b"IDX1" + enc.width.to_bytes(4, "little") + records.to_bytes(8, "little") + b"".join(index))
            yield pa.RecordBatch.from_pydict({"path": [name], "width": pa.array([enc.width], pa.int32()), "first_id": pa.array([first_id], pa.int64()),
                                              "records": pa.array([records], pa.int64()), "ids": pa.array([total], pa.int64())})

    return stored(ship(docs).select("doc_id", "text").orderBy("doc_id").mapInArrow(run, MANIFEST), "records")


class RecordFile:
    """Reads a record file and its index; ``record`` takes any record by its number."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        with fs.open_input_stream(at[:-4] + ".idx") as side:
            raw = side.read()
        if raw[:4] != b"IDX1":
            raise ValueError(f"{path}: no index")
        self.width, n = int.from_bytes(raw[4:8], "little"), int.from_bytes(raw[8:16], "little")
        self.index = np.frombuffer(raw, INDEX, n, 16)
        self.file, self.path = fs.open_input_file(at), path

    def span(self, lo: int, hi: int) -> list[np.ndarray]:
        """The ids of records lo to hi, read at once; raises if a checksum is wrong."""
        if lo >= hi:
            return []
        own = self.index[lo:hi]
        base, size = int(own["offset"][0]), own["ids"].astype(np.int64) * self.width
        self.file.seek(base)
        data, out = self.file.read(int(own["offset"][-1] + size[-1]) + HEADER - base), []
        for a, n in zip((own["offset"] - base).tolist(), size.tolist()):
            head, payload = data[a:a + 8], data[a + 12:a + 12 + n]
            if (int.from_bytes(head, "little") != n or masked(head) != int.from_bytes(data[a + 8:a + 12], "little")
                    or masked(payload) != int.from_bytes(data[a + 12 + n:a + HEADER + n], "little")):
                raise ValueError(f"{self.path}: broken record at {base + a}")
            out.append(np.frombuffer(payload, f"<u{self.width}"))
        return out

    def record(self, k: int) -> np.ndarray:
        return self.span(k, k + 1)[0]


def read(manifest: DataFrame, step: int = 2000) -> DataFrame:
    """Per record, from the files: doc_id, start (ids before it in all files), n_tokens,
    ids_crc32 (of the ids as u32). A task reads whole files, ``step`` records at a time."""
    order = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f, before = RecordFile(row["path"]), row["before"]
                for lo in range(0, len(f.index), step):
                    own = f.index[lo:lo + step]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in f.span(lo, lo + len(own))]
                    n = own["ids"].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own["doc_id"].astype(np.int64), mask=own["null"] > 0), "start": before + np.cumsum(n) - n,
                        "n_tokens": n, "ids_crc32": np.array(crc, np.int64)})
                    before += int(n.sum())

    files = ship(placed).repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
