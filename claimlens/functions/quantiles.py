"""Per-group continuous quantiles (linear interpolation, like
``percentile`` / ``quantile_cont``) that never hold a whole group in one task.

Spark's built-in ``percentile`` merges a value->count map per group in a
single task, so one peer group holding a third of all providers would land
on one executor. ``exact_group_quantiles`` instead finds the needed order
statistics with bounded work per task:

1. collapse rows to distinct (group, value, multiplicity)   - hashed on value too
2. per group: total count and ``buckets-1`` approximate split points
   (``percentile_approx``: a mergeable sketch of bounded size)
3. bucket every distinct value; count per (group, bucket)   - small table
4. prefix sums over buckets (<= ``buckets`` rows per group) locate the bucket
   holding each target rank
5. only those buckets are sorted (window per (group, bucket), ~1/buckets of a
   group's distinct values) to read the exact values at the target ranks
6. interpolate.

The result is exact; the sketch only decides how the work is split. NULL values
count as members of their group and take no part in its quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.lineage import materialize
from claimlens.functions.sketches import group_sketches, sketch_quantiles


def builtin_group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                            quantiles: Sequence[float], names: Sequence[str],
                            count_name: str = "n", approx: bool = False,
                            accuracy: int = 10000) -> DataFrame:
    """One-pass variant: exact ``percentile`` or the ``percentile_approx`` sketch."""
    v = F.col(value_col).cast("double")
    aggs = []
    for q, name in zip(quantiles, names):
        expr = F.percentile_approx(v, q, accuracy) if approx else F.percentile(v, F.lit(q))
        aggs.append(expr.alias(name))
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(count_name), *aggs)


def exact_group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                          quantiles: Sequence[float], names: Sequence[str],
                          count_name: str = "n", buckets: int = 256,
                          accuracy: int = 10000) -> DataFrame:
    g = list(group_cols)
    vals = df.select(*g, F.col(value_col).cast("double").alias("_v"))

    # 1. distinct values with multiplicity (hashed on group *and* value), stored:
    #    the sketch, the buckets and the located values all read it
    every = materialize(vals.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")), "distinct_values")
    members = every.groupBy(*g).agg(F.sum("_c").alias(count_name))
    vc = every.where(F.col("_v").isNotNull())

    # 2. per group: size, split points, and the 0-based target ranks
    #    floor/ceil of q * (n - 1) for every quantile (target 2i = floor, 2i+1 = ceil)
    splits = [i / buckets for i in range(1, buckets)]
    sketch = vc.groupBy(*g).agg(
        F.sum("_c").alias("_n"),
        F.percentile_approx("_v", splits, accuracy).alias("_bounds"))
    pos = [F.lit(float(q)) * (F.col("_n") - 1).cast("double") for q in quantiles]
    ranks = []
    for p in pos:
        ranks += [F.floor(p).cast("bigint"), F.ceil(p).cast("bigint")]
    # stored: both readers of the buckets read it, and its own size decides the join with it
    sketch = materialize(sketch.select(*g, "_n", "_bounds", F.array(*ranks).alias("_t")), "split_points")

    # 3. bucket = number of split points strictly below the value
    vcb = (vc.join(sketch, g)
             .select(*g, "_v", "_c", "_n", "_t",
                     F.size(F.filter("_bounds", lambda x: x < F.col("_v"))).alias("_b")))

    # 4. rows per bucket, prefix sums over <= `buckets` rows per group, and
    #    only the buckets that hold a target rank
    w_b = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (vcb.groupBy(*g, "_b").agg(F.sum("_c").alias("_cb"), F.first("_t").alias("_t"))
                     .withColumn("_before", F.coalesce(F.sum("_cb").over(w_b), F.lit(0))))
    needed = (per_bucket.where(F.exists("_t", lambda r: (r >= F.col("_before"))
                                         & (r < F.col("_before") + F.col("_cb"))))
                        .select(*g, "_b", "_before"))

    # 5. sort only the located buckets; read the value at each target rank
    w_v = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (vcb.join(needed, g + ["_b"])
                 .withColumn("_start", F.col("_before") + F.sum("_c").over(w_v) - F.col("_c")))
    hits = placed.select(*g, "_n", "_v", F.explode(F.filter(
        F.transform("_t", lambda r, i: F.struct(i.alias("i"), r.alias("r"))),
        lambda t: (t["r"] >= F.col("_start")) & (t["r"] < F.col("_start") + F.col("_c")))).alias("_hit"))

    # 6. interpolate between the floor and ceil values
    agg = hits.groupBy(*g).agg(
        F.first("_n").alias("_n"),
        *[F.max(F.when(F.col("_hit.i") == j, F.col("_v"))).alias(f"_x{j}") for j in range(2 * len(quantiles))])
    out = [F.col(c) for c in g] + [F.col(count_name)]
    for i, name in enumerate(names):
        lo, hi = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        frac = pos[i] - F.floor(pos[i])
        out.append((lo + frac * (hi - lo)).alias(name))
    return members.join(agg, g, "left").select(*out)


def group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    quantiles: Sequence[float], names: Sequence[str], count_name: str = "n",
                    method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """``exact``: the distributed method above, whatever the sizes. On request:
    ``builtin``, Spark's one-pass ``percentile`` (a group's values in one task),
    ``approx``, its sketch, and ``sketch``, the mergeable one of ``sketches``."""
    if method == "exact":
        return exact_group_quantiles(df, group_cols, value_col, quantiles, names, count_name, accuracy=accuracy)
    if method in ("builtin", "approx"):
        return builtin_group_quantiles(df, group_cols, value_col, quantiles, names, count_name,
                                       approx=method == "approx", accuracy=accuracy)
    if method == "sketch":
        found = sketch_quantiles(group_sketches(df, group_cols, value_col), quantiles, names)
        return found.withColumnRenamed("members", count_name).select(*group_cols, count_name, *names)
    raise ValueError(f"unknown quantile method {method!r}")
