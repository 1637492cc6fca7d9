"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 hashes
of the text's shingles. Two fingerprints are linked if they differ in at most
``radius`` bits. Candidates come from 2^(radius+1) - 1 tables: bit position i carries a
vector m(i) of radius + 1 bits, and table v keeps the positions with <m(i), v> = 1
(mod 2). For any ``radius`` differing positions there is a v orthogonal to all of their
vectors, so every pair within the radius has equal kept bits in some table: recall
is 1 by construction, not by chance.

Copies share a fingerprint and are one node. In a bucket of up to ``BUCKET`` distinct
fingerprints the pairs are compared in the join itself, and only links leave it. The
fingerprints of larger buckets are linked another exact way, without comparing a bucket's
members: each is listed under the masks at half the radius (for radius 2, itself and its
64 neighbours at one bit), and two that share such a middle are at most ``radius`` apart,
and those that are at most ``radius`` apart share one. A middle has at most 65 fingerprints.

Defined results: no words (null or empty text) gives fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; a null doc_id has no id to
be least, so it takes part in its component but never names it unless it is alone
(component_id null); repeated rows share all values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField
from xxhash import xxh64_intdigest

from claimlens.llm import _text as t
from claimlens.llm._spark import add_columns, free_name, stored
from claimlens.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: distinct fingerprints of one table's bucket that are compared with each other
BUCKET = 64
#: shingle hashes whose bits are counted at once
SLICE = 1 << 14


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()        # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    size = min(size, len(words))
    first, last = starts[:len(words) - size + 1].tolist(), (starts[size:] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(first)
    for i in range(0, n, SLICE):
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[i:i + SLICE], last[i:i + SLICE])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


def _fingerprints(size: int):
    def fn(block: t.Block) -> list:
        raw, off = block.data.tobytes(), block.offsets.tolist()
        return [np.array([fingerprint(raw[a:b], size) for a, b in zip(off, off[1:])], t.U64).view(np.int64)]

    return fn


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: list[str] | None = None, name: str = "fingerprint") -> DataFrame:
    """The columns ``keep`` of ``docs`` and each whole text's fingerprint as a signed long."""
    return add_columns(docs, _fingerprints(size), [StructField(name, LongType())], keep)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask of 64 bits for each nonzero v; positions get the nonzero vectors in turn."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, at_most: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column ``fingerprint``, each
    once; ``at_most`` bounds their number, if known) that differ in at most ``radius`` bits."""
    if radius != 2:
        raise ValueError("the way for large buckets is written for a radius of 2")
    masks = [_signed(m) for m in covering_masks(radius)]
    keyed = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("v", "key"))
    sizes = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    placed = stored(keyed.join(sizes, ["v", "key"]), "simhash_buckets", None if at_most is None else len(masks) * at_most)
    few = placed.where(F.col("n") <= bucket).select("v", "key", "fingerprint")
    near = (few.withColumnRenamed("fingerprint", "a").join(few.withColumnRenamed("fingerprint", "b"), ["v", "key"])
            .where((F.col("a") < F.col("b")) & (_apart(F.col("a"), F.col("b")) <= radius)).select("a", "b"))
    crowd = placed.where(F.col("n") > bucket).select("fingerprint").distinct()
    flips = [0] + [_signed(1 << i) for i in range(64)]
    middle = crowd.select("fingerprint", F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(F.lit(f)) for f in flips])).alias("middle"))
    shared = middle.join(middle.groupBy("middle").agg(F.count("*").alias("n")).where("n > 1").select("middle"), "middle")
    far = (shared.withColumnRenamed("fingerprint", "a").join(shared.withColumnRenamed("fingerprint", "b"), "middle")
           .where(F.col("a") < F.col("b")).select("a", "b"))
    return near.unionByName(far).distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fingerprint and other columns) with component_id."""
    return _classes(prints, radius).drop("component")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """The same, and ``component``, which tells groups apart that have no id at all."""
    prints = stored(prints, "simhash_prints")
    n = prints.count()
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "simhash_nodes", n)
    groups = components(links(nodes.select("fingerprint"), radius, at_most=n)).withColumnRenamed("node", "fingerprint")
    member = nodes.join(groups, "fingerprint", "left").withColumn("least", F.coalesce("least", "fingerprint"))
    named = member.groupBy("least").agg(F.min("least_id").alias("component_id"))
    table = stored(member.join(named, "least").select(F.col("fingerprint").alias("f"), "component_id", F.col("least").alias("component")), "simhash_classes", n)
    return prints.join(table, F.col("fingerprint") == F.col("f")).drop("f")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least doc_id (one without
    an id only if its group has no id at all), then with the least hash of its text. Of rows
    that have both alike, any one stays."""
    name, group = free_name(docs, "simhash_body"), free_name(docs, "simhash_group")
    body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    prints = fingerprints(docs.select("doc_id", "text", body.alias("body")), size, ["doc_id", "body"])
    rows = _classes(prints, radius).groupBy("component", "doc_id", "body").agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body", "rows")).alias("best"))
    best = stored(best.select(F.col("best.doc_id").alias(group), F.col("best.body").alias(name), "best.rows"), "simhash_kept")
    same = F.col("doc_id").eqNullSafe(F.col(group)) & (body == F.col(name))
    alone = docs.join(best.where("rows = 1").select(group, name), same, "left_semi")
    repeated = docs.join(best.where("rows > 1").select(group, name), same, "left_semi").withColumn(name, body)
    one = repeated.groupBy("doc_id", name).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(group))
    return alone.unionByName(one.select(f"{group}.*"))
