"""Claims laid out by provider, for jobs that need the rows of few of them.

The fact is range-partitioned and sorted by billing NPI, then servicing NPI, month and
code, so that a provider with a third of all rows spans several files. Statistics of row
groups and pages then rule out most of them for a billing NPI; Parquet Bloom filters
rule out row groups that lie around an NPI without having it, and serve the servicing
NPI, whose values are spread.

A semi-join alone reads every row of the fact. ``rows_of`` reads the keys first and
pushes them into the scan: up to ``KEYS`` of them one by one, which
needs no join at all; beyond that as ``RANGES`` ranges between which nothing is
read, before the semi-join. The result is the same either way, and what the driver sees is
bounded by these two numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.functions.lineage import buckets_for, materialize, stored_path
from claimlens.sources.commit import build_once
from claimlens.sources.tables import read_spending

#: keys pushed one by one (spark.sql.parquet.pushdown.inFilterThreshold is set to as many)
KEYS = 1000
#: ranges pushed for more keys than that
RANGES = 64

ORDER = [S.BILLING_NPI, S.SERVICING_NPI, S.CLAIM_MONTH, S.HCPCS]


def write_clustered(spending: DataFrame, path: str, files: int | None = None, options: dict[str, str] | None = None) -> str:
    """``files`` defaults to one per 128 MB of what ``spending`` reads; ``options`` are further
    Parquet options (sizes of row groups and pages)."""
    bloom = {f"parquet.bloom.filter.enabled#{c}": "true" for c in (S.BILLING_NPI, S.SERVICING_NPI)}
    (spending.repartitionByRange(files or buckets_for(spending), *ORDER).sortWithinPartitions(*ORDER)
     .write.mode("overwrite").options(**bloom, **{"parquet.bloom.filter.adaptive.enabled": "true"}, **(options or {})).parquet(path))
    return path


def build_clustered(spark: SparkSession, claims_path: str, out: str) -> bool:
    """The layout of the claims file, built once for its inputs (``sources.commit``)."""
    return build_once(spark, [claims_path], out, lambda path: write_clustered(read_spending(spark, claims_path), path),
                      note=",".join(ORDER))


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SPENDING_SCHEMA).parquet(path)


def materialize_clustered(spending: DataFrame) -> DataFrame:
    """The layout as a stored table of this session (``functions.lineage``)."""
    return read_clustered(spending.sparkSession, write_clustered(spending, stored_path(spending.sparkSession, "claims_clustered")))


def _any(tests: list[Column]) -> Column:
    """One of ``tests``, as a tree of little depth."""
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[i:i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def rows_of(claims: DataFrame, keys: DataFrame, column: str = S.BILLING_NPI, most: int = KEYS, ranges: int = RANGES) -> DataFrame:
    """The rows of ``claims`` whose ``column`` is among the ``npi`` of ``keys``; repeated keys count
    once, NULL is no key, and no key gives no row. The keys are computed and stored at once."""
    npis = materialize(keys.select(F.col("npi").cast("string").alias("npi")).where(F.col("npi").isNotNull()).distinct(), "keys")
    few = [r[0] for r in npis.limit(most + 1).collect()]
    npi = F.col(column)
    if len(few) <= most:
        return claims.where(npi.isin(few))
    spans = (npis.repartitionByRange(ranges, "npi").groupBy(F.spark_partition_id())
             .agg(F.min("npi"), F.max("npi")).collect())
    near = claims.where(_any([npi.between(lo, hi) for _, lo, hi in sorted(spans, key=lambda r: r[1])]))
    return near.join(npis, near[column] == npis["npi"], "left_semi")
