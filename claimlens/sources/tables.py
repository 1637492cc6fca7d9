"""The three domain tables as one bundle of lazily-read DataFrames."""

from __future__ import annotations

import weakref
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import schemas as S


@dataclass(frozen=True)
class ClaimsTables:
    spending: DataFrame     # claims fact: billing/servicing NPI x month x code
    registry: DataFrame     # provider registry, 11 short-named text columns
    exclusions: DataFrame   # normalised exclusion list, 9 text columns


def registry_view(df: DataFrame) -> DataFrame:
    """IO-4: rename the registry's long headers to the short names.

    Accepts either header style, so a slim file written with long headers
    and one already renamed read the same way."""
    cols = set(df.columns)
    if all(long in cols for long in S.REGISTRY_LONG):
        return df.select(*[F.col(f"`{long}`").alias(short) for long, short in S.REGISTRY_COLUMNS])
    return df.select(*S.REGISTRY_SHORT)


def read_spending(spark: SparkSession, path: str) -> DataFrame:
    """IO-1: claims Parquet. Only the seven used columns are declared, so the
    scan's ReadSchema never widens beyond them. Amounts are rounded to whole
    cents per row (they are money), which makes every sum exact."""
    df = spark.read.parquet(path)
    return df.select(
        F.col(S.BILLING_NPI).cast("string").alias(S.BILLING_NPI),
        F.col(S.SERVICING_NPI).cast("string").alias(S.SERVICING_NPI),
        F.col(S.CLAIM_MONTH).cast("string").alias(S.CLAIM_MONTH),
        F.col(S.HCPCS).cast("string").alias(S.HCPCS),
        F.col(S.TOTAL_CLAIMS).cast("bigint").alias(S.TOTAL_CLAIMS),
        F.col(S.TOTAL_PAID).cast(S.MONEY).alias(S.TOTAL_PAID),
        F.col(S.TOTAL_BENES).cast("bigint").alias(S.TOTAL_BENES),
    )


def load_domain_tables(spark: SparkSession, spending_path: str, registry_path: str,
                       exclusions_path: str) -> ClaimsTables:
    """Production layout: claims Parquet plus the slim registry and the
    normalised exclusion Parquet written by ``claimlens.sources.ingest``."""
    return ClaimsTables(
        spending=read_spending(spark, spending_path),
        registry=registry_view(spark.read.parquet(registry_path)),
        exclusions=spark.read.parquet(exclusions_path).select(*S.EXCLUSION_COLUMNS),
    )


VIEW_NAMES = {"spending": "spending", "registry": "nppes", "exclusions": "leie"}


def register_views(tables: ClaimsTables) -> None:
    """IO-8: the three tables under their usual names, for the user's own SQL."""
    for field, name in VIEW_NAMES.items():
        getattr(tables, field).createOrReplaceTempView(name)


_STAR_CACHE: "weakref.WeakKeyDictionary[SparkSession, dict[str, ClaimsTables]]" = weakref.WeakKeyDictionary()


def load_star_tables(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    """Test layout: derive the three tables from the TPC-H-like star.

    The lazy plans (not data) are kept per live session object and folder,
    so repeated queries skip re-analysing the mapping; a new session never
    sees another session's plans."""
    from claimlens.sources import star
    per_session = _STAR_CACHE.setdefault(spark, {})
    key = sf_dir.rstrip("/")
    if key not in per_session:
        per_session[key] = star.tables_from_star(spark, sf_dir)
    return per_session[key]
