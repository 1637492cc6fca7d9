"""Small tables with awkward rows, and plain-Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["ka", "lo", "mi", "tu", "ra", "se", "no", "vi", "pe", "du", "é", "ñö", "zu", "the", "of"]

#: columns whose names the operators also use inside
CLASHING = ["n_words", "start", "runs", "key", "body", "slot", "hash", "size", "score", "feature", "mix_whole", "quality_n_words", "simhash", "benchmark_n_hit"]


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def awkward_texts(seed: int = 1) -> list[tuple[int, str | None]]:
    """(doc_id, text): copies, near copies, shared passages, periodic junk, empties."""
    rng = random.Random(seed)
    shared, long = prose(rng, 130), prose(rng, 4000)
    out: list[tuple[int, str | None]] = []
    add = lambda text: out.append((len(out) * 3 + 1, text))
    add(" ".join(long))
    for k in range(12):
        own = prose(rng, rng.randint(5, 200))
        add(" ".join(own[: len(own) // 2] + shared[k: k + 100] + own[len(own) // 2:]))
    whole = " ".join(prose(rng, 120))
    for _ in range(9):
        add(whole)
    near = prose(rng, 300)
    for _ in range(6):
        other = list(near)
        other[rng.randrange(300)] = "changed"
        add("\t".join(other))
    add(" ".join(shared[:50]))
    add(" ".join(shared[:49]))
    add(None)
    add("")
    add(" \n\t ")
    add("one")
    add("Eaea " * 400)
    add(("Eaea " * 150) + "end")
    add("ab" * 300)
    add("x" * 5000)
    add(" ".join(long[100:1500]))
    add("first line here\nsecond line\nfirst line here\n\n\nsecond line\n \n \nfirst line here ")
    add("## a b *** c | d <e> & $5 100% no break")
    add("ÀÉÎ Õü " * 30)
    add("日本語 の 文 です " * 20)
    add("   lead  and\x0btrail\x0c ")
    return out


SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])


def documents(spark: SparkSession, texts, langs=None, sources=None, clash: bool = True, parts: int = 3):
    rows = [(i, s, (langs or {}).get(i, "en"), (sources or {}).get(i, f"src{(i or 0) % 4}"), len(s or "")) for i, s in texts]
    schema = SCHEMA
    if clash:
        schema = StructType(SCHEMA.fields + [StructField(c, IntegerType()) for c in CLASHING])
        rows = [(*r, *range(len(CLASHING))) for r in rows]
    return spark.createDataFrame(rows, schema).repartition(parts)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def crc_fold(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def substring_brute(texts, width: int = 50) -> dict:
    held = [(i, words(s)) for i, s in texts]
    least: dict = {}
    for i, w in held:
        for a in range(len(w) - width + 1):
            k = tuple(w[a:a + width])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in held:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if least[tuple(w[a:a + width])] < i:
                gone[a:a + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffix_brute(texts, width: int = 100) -> dict:
    seen, out = set(), {}
    for i, s in sorted(texts, key=lambda r: r[0]):
        b = (s or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            k = b[a:a + width]
            if k in seen:
                gone[a:a + width] = b"\x01" * width
            seen.add(k)
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out
