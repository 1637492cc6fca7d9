"""Exact deduplication by a content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal
ones next to each other, and neighbours are compared as a whole (the sort and the window
compare all bytes; no hash decides). A splitter is a text's first letters and, as many
texts may begin alike, a hash of the whole: the driver sees splitters, so they are short. Of each run of equals one row stays: the one with the
smallest identifier, or on request the largest.

A text that alone makes up more than half a partition, by rows or by bytes, is sorted in
pieces: a second sort key deals its rows to as many runs as it needs, splitters then fall
inside the group, and the runs' representatives, a few rows, are compared in full once
more. Which texts these are comes from counts per hash (at most four for each partition);
a collision there would only split a text that need not be.

DataFrame expressions only; no Python runs on the rows.

Defined results: texts are equal when they are identical after lower-casing A-Z; a null
text equals an empty one; a null identifier loses against any other; of repeated rows (same
identifier, equal text) exactly one stays, whichever; an empty table gives an empty table;
columns of any name pass through, also those called as the added ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimlens.llm._spark import lower_ascii, stored

#: bytes of text per partition of the sort, and what a row counts besides its text
PARTITION_BYTES, ROW_BYTES = 128 << 20, 64
#: letters of a text in a splitter
HEAD = 16


def _runs(docs: DataFrame, keep: list[str], largest: bool) -> DataFrame:
    """One row per row of ``docs``, stored: its columns ``keep`` in ``row``, the digest of
    its text, the number of its run's rows, the identifier that stays in that run, whether
    this row does, and whether the run is all of its group (else ``norm`` has the text of the
    row that stays)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("id"),
                       lower_ascii(F.col("text")).alias("norm"), F.monotonically_increasing_id().alias("number"))
    hashed, size = F.xxhash64("norm"), F.octet_length("norm").cast("long") + ROW_BYTES
    total = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("bytes")).first()
    total = {"rows": max(total["rows"], 1), "bytes": total["bytes"] or 1}
    counts = rows.groupBy(hashed.alias("hash")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).where("rows > 1")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["bytes"] // PARTITION_BYTES))
    share = F.greatest(F.col("rows") * n / F.lit(total["rows"]), F.col("bytes") * n / F.lit(total["bytes"]))
    heavy = counts.where(share > 0.5).select("hash", F.ceil(2 * share).alias("pieces"))
    heavy = stored(heavy, "dedup_heavy", 4 * n)
    dealt = (rows.withColumn("hash", hashed).join(heavy, "hash", "left").withColumn("head", F.substring("norm", 1, HEAD))
             .withColumn("piece", F.coalesce(F.pmod(F.xxhash64("number"), "pieces"), F.lit(-1))))
    ordered = (Window.partitionBy("head", "hash", "norm", "piece")
               .orderBy(F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (dealt.select("row", "id", "head", "hash", "norm", "piece").repartitionByRange(n, "head", "hash", "piece")
            .select("row", "piece", "norm", F.row_number().over(ordered).alias("place"),
                    F.first("id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("rows")))
    stays = F.col("place") == 1
    return stored(runs.select("row", "piece", "rows", "keep_id", stays.alias("stays"), F.sha2("norm", 256).alias("digest"),
                              F.when(stays & (F.col("piece") >= 0), F.col("norm")).alias("norm")), "dedup_runs")


def groups(docs: DataFrame, keep: list[str] | None = None, largest: bool = False) -> DataFrame:
    """A row per row of ``docs``: its columns ``keep`` (default: all) as the struct ``row``,
    ``keep_id`` (the identifier of the row that stays), ``group_size``, ``kept``, ``text_sha256``."""
    runs = _runs(docs, list(docs.columns) if keep is None else keep, largest)
    out = [F.col("digest").alias("text_sha256")]
    light = runs.where("piece < 0").select("row", "keep_id", F.col("rows").alias("group_size"), F.col("stays").alias("kept"), *out)
    id_ = F.col("keep_id")
    if largest:
        best = F.max(F.struct(id_.isNotNull().alias("o"), id_.alias("id"), F.col("piece").alias("piece")))
    else:
        best = F.min(F.struct(id_.isNull().alias("o"), id_.alias("id"), F.col("piece").alias("piece")))
    split = (runs.where("piece >= 0 and stays").groupBy("norm").agg(best.alias("best"), F.sum("rows").alias("group_size"))
             .select(F.sha2("norm", 256).alias("digest"), "best", "group_size"))
    split = stored(split, "dedup_split", 1)
    rest = (runs.where("piece >= 0").drop("keep_id").join(split, "digest")
            .select("row", F.col("best.id").alias("keep_id"), "group_size",
                    (F.col("stays") & (F.col("piece") == F.col("best.piece"))).alias("kept"), *out))
    return light.unionByName(rest)


def unique(docs: DataFrame, largest: bool = False) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    return groups(docs, largest=largest).where("kept").select("row.*")
