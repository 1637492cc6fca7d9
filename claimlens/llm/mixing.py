"""Mixing sources to target weights by capped water-filling.

Each source's share of the budget follows its weight, but stops at
``max_epochs`` times its size; what it cannot take goes to the others by weight,
until none is above its limit. In the order of (limit / weight) the sources at
their limit come first, so running sums over the table of sources give the water
level at once.

A source is then read whole ``floor(target / size)`` times, and a seeded part of
its documents once more: documents in the order of a seeded hash while they fit into
the words still missing. The cut is one hash value per source. It is found from sums
over 4096 equal hash ranges and the rows of the single range that holds it, so a source
with a third of all rows is never sorted whole.

The gap that is left is smaller than the first document past the cut. It is filled from
the documents past it: sizes descend, and of each size as many documents as still fit are
taken, in the order of the hash. How many they are follows from one row per (source, size);
only sizes within the gap count, so a source has at most as many as the gap has words. In
the end fewer words are missing than the smallest document that is left has.

DataFrame expressions only; no Python runs on the rows.

Defined results: a null or empty text has size 0 and is taken as often as its hash
says, with 0 words; sources are taken in code point order, null last, and null is
a source of its own; rows of a source with the same doc_id share their hash and are taken
together up to the cut, past it those of the same size, and such rows are left if they do
not fit together; an empty table gives an empty table; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimlens.llm._spark import free_name, stored

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096
#: hash values are the first 15 hex digits of an MD5
HASH_DIGITS = 15
WIDTH = 16 ** HASH_DIGITS // RANGES


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): weights dealt to the sources in code point order, null last."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", F.element_at(F.array(*map(F.lit, cycle)), (order - 1) % len(cycle) + 1).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight). One row per source."""
    limit = max_epochs * F.col("source_size")
    whole = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = sources.select(
        "*", (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights"))
    full = limit * F.col("weights") <= F.col("left") * F.col("weight")
    first = F.min(F.when(~full, F.struct(limit / F.col("weight"), F.col("left"), F.col("weights")))).over(whole)
    shared = F.col("open")["left"] * F.col("weight") / F.col("open")["weights"]
    return (level.select("source", "source_size", "weight", full.alias("full"), first.alias("open"))
            .select("source", "source_size", "weight",
                    F.when(F.col("full"), limit.cast("double")).otherwise(shared).alias("target")))


def plan(sized: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """From rows (source, size, hash), one row per source: source_size, target, how
    often it is read ``whole``, and the hash up to which documents are read once more
    (``cut``); and the ``fillers``."""
    ranged = sized.select("source", "size", "hash", F.expr(f"hash div {WIDTH}").alias("range"))
    sums = stored(ranged.groupBy("source", "range").agg(F.sum("size").alias("size")), "mix_ranges", sized.count())
    n = sums.count()
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = cyclic_weights(sources, cycle).select(F.col("source").alias("s"), "weight")
    targets = water_fill(sources.join(weights, F.col("source").eqNullSafe(F.col("s"))).drop("s"), max_epochs)
    rate = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0).cast("long")
    targets = stored(targets.withColumn("whole", whole)
                     .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")), "mix_targets", n)

    # the range in which the missing words are reached, then the last hash in it that fits
    names = targets.select(F.col("source").alias("s"), "missing")
    at = (sums.join(names, F.col("source").eqNullSafe(F.col("s"))).drop("s")
          .withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("range")))
          .withColumn("before", F.col("upto") - F.col("size")))
    edge = (at.where("before <= missing and missing < upto")
            .select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "missing"))
    inner = (ranged.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
             .groupBy("source", "hash", "before", "missing").agg(F.sum("size").alias("size"))
             .withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("hash"))))
    last = (inner.where("upto <= missing").groupBy(F.col("source").alias("l"))
            .agg(F.max("hash").alias("last"), F.max("upto").alias("have")))
    cuts = (edge.join(last, F.col("s").eqNullSafe(F.col("l")), "left")
            .select("s", F.coalesce("last", F.col("r") * WIDTH - 1).alias("cut"),
                    F.floor(F.col("missing") - F.coalesce("have", "before")).cast("long").alias("gap")))
    cuts = stored(cuts, "mix_cuts", n)
    planned = (targets.join(cuts.drop("gap"), F.col("source").eqNullSafe(F.col("s")), "left")
               .select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")))
    past = (ranged.join(cuts, F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("hash") > F.col("cut")) & F.col("size").between(1, F.col("gap"))).drop("s", "cut"))
    return planned, fillers(past)


def fillers(past: DataFrame) -> DataFrame:
    """(source, hash, sizes): which of the rows ``past`` the cuts (source, size, hash, range,
    gap) fill the gaps: those of the source and hash that have one of the sizes."""
    sizes = past.groupBy("source", "size", "gap").agg(F.count(F.lit(1)).alias("n"))
    # descending sizes, each as often as it is there and fits
    step = "least(x.n, acc.rest div x.size)"
    filled = F.expr(f"""aggregate(sizes, struct(gap AS rest, cast(array() AS array<struct<size: bigint, k: bigint>>) AS taken),
        (acc, x) -> struct(acc.rest - {step} * x.size AS rest,
                           concat(acc.taken, filter(array(struct(x.size AS size, {step} AS k)), y -> y.k > 0)) AS taken),
        acc -> acc.taken)""")
    wanted = (sizes.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
              .select(F.col("source").alias("s"), F.explode(filled).alias("t")).select("s", F.col("t.size").alias("of"), "t.k"))
    wanted = stored(wanted, "mix_wanted", 1)
    near = past.drop("gap").join(wanted, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("of"))).drop("s", "of")
    # a size that very many documents have is not sorted whole: only the first ranges that hold k of them
    own = Window.partitionBy("source", "size")
    ranges = (near.groupBy("source", "size", "range", "k").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .where("before < k").select(F.col("source").alias("s"), F.col("size").alias("of"), F.col("range").alias("r")))
    first = near.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("of")) & (F.col("range") == F.col("r")))
    picked = first.withColumn("upto", F.count(F.lit(1)).over(own.orderBy("hash"))).where("upto <= k")
    return picked.groupBy("source", "hash").agg(F.collect_set("size").alias("sizes"))


def _with_copies(rows: DataFrame, hashed: Column, size: Column, planned: DataFrame, filling: DataFrame) -> tuple[DataFrame, Column, dict[str, str]]:
    """``rows`` met with their source's plan, how often a row is read, and the names that the
    plan's columns have there. Both tables are read from files, so Spark broadcasts them only
    if they are below its own limit."""
    by = {c: free_name(rows, f"mix_{c}") for c in ("source", "whole", "cut", "source_size", "target", "of", "hash", "sizes")}
    table = stored(planned, "mix_plan", 1).select(*[F.col(c).alias(by[c]) for c in ("source", "whole", "cut", "source_size", "target")])
    extra = stored(filling, "mix_fillers", 1).select(F.col("source").alias(by["of"]), F.col("hash").alias(by["hash"]), F.col("sizes").alias(by["sizes"]))
    met = (rows.join(table, F.col("source").eqNullSafe(F.col(by["source"])))
           .join(extra, F.col("source").eqNullSafe(F.col(by["of"])) & (hashed == F.col(by["hash"])), "left"))
    more = F.when(hashed <= F.col(by["cut"]), 1).when(F.col(by["sizes"]).isNotNull(), F.array_contains(by["sizes"], size).cast("int")).otherwise(0)
    return met, F.col(by["whole"]) + more, by


def mix(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it (0 to max_epochs)."""
    hashed, size = seeded_hash(F.col("doc_id"), seed), word_count(F.col("text"))
    sized = stored(docs.select("source", size.alias("size"), hashed.alias("hash")), "mix_sizes")
    met, copies, _ = _with_copies(docs, hashed, size, *plan(sized, cycle, max_epochs))
    n = free_name(met, "mix_copy")
    return met.where(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(n)).drop(n)


def mixed_words(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               seeded_hash(F.col("doc_id"), seed).alias("hash")), "mix_sizes")
    met, copies, by = _with_copies(sized, F.col("hash"), F.col("size"), *plan(sized, cycle, max_epochs))
    return met.select("doc_id", "size", F.col(by["source_size"]).alias("source_size"), F.col(by["target"]).alias("target"),
                      (F.col("size") * copies).alias("taken"))
