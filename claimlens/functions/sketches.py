"""Quantile sketches that are stored per group and merged upwards.

A KLL sketch holds a few thousand values at most, whatever its group's size, and two
sketches merge into the sketch of both groups. So one pass over the providers gives sketches of
the finest groups; coarser ones, other quantiles and later months come from the stored
sketches, and the providers are not read again.

``RANK_ERROR`` bounds how far the rank of an estimate may lie from the quantile asked for
(the library states 0.33 % for one value at k = 800 with 99 % confidence; the bound here is three times
that, for many groups at once). Exact quantiles stay the default; see ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

K = 800
RANK_ERROR = 0.01


def group_sketches(df: DataFrame, group_cols: Sequence[str], value_col: str, k: int = K) -> DataFrame:
    """(groups, members, sketch); partial sketches are merged in the shuffle, so a group with a third of
    all rows sends one sketch per task. NULL values are members, but not in the sketch."""
    value = F.col(value_col).cast("double")
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("members"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """The same for coarser groups, from the sketches alone."""
    return sketches.groupBy(*group_cols).agg(F.sum("members").alias("members"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The sketches' columns with one more per quantile; NULL for a sketch without values."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.withColumns({name: F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
                                 for q, name in zip(quantiles, names)})
