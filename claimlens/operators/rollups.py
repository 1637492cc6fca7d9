"""Shared aggregates of the claims fact. Money columns (``paid``) are
integer cents.

``provider_month`` is the one fact-sized shuffle most signals need; building
every signal from the same DataFrame lets Spark reuse the exchange when the
signals run in one plan (the report), and lets ``persist`` share it across
separate jobs. Partial (map-side) aggregation runs before the shuffle, so a
provider with a third of all claim rows still ships at most one row per
month per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.config import SignalConfig
from claimlens.functions.columns import in_code_ranges, paid_cents


def provider_month(spending: DataFrame) -> DataFrame:
    """(npi, month) -> paid (decimal), claims, beneficiaries, by billing NPI."""
    return (spending
            .groupBy(F.col(S.BILLING_NPI).alias("npi"), F.col(S.CLAIM_MONTH).alias("month"))
            .agg(F.sum(paid_cents(S.TOTAL_PAID)).alias("paid"),
                 F.sum(S.TOTAL_CLAIMS).alias("claims"),
                 F.sum(S.TOTAL_BENES).alias("benes")))


def provider_totals(pm: DataFrame) -> DataFrame:
    """Lifetime totals per billing NPI, re-aggregated from ``provider_month``."""
    return (pm.groupBy("npi")
              .agg(F.sum("paid").alias("paid"),
                   F.sum("claims").alias("claims"),
                   F.sum("benes").alias("benes"),
                   F.min("month").alias("first_month"),
                   F.max("month").alias("last_month")))


def home_health_claims(spending: DataFrame, cfg: SignalConfig) -> DataFrame:
    """Claim rows with a home-health procedure code (filter pushed to the scan)."""
    return spending.where(in_code_ranges(S.HCPCS, cfg.code_ranges))


def home_health_month(spending: DataFrame, cfg: SignalConfig) -> DataFrame:
    """(npi, month) rollup of home-health claims only."""
    return (home_health_claims(spending, cfg)
            .groupBy(F.col(S.BILLING_NPI).alias("npi"), F.col(S.CLAIM_MONTH).alias("month"))
            .agg(F.sum(S.TOTAL_CLAIMS).alias("claims"),
                 F.sum(S.TOTAL_BENES).alias("benes"),
                 F.sum(paid_cents(S.TOTAL_PAID)).alias("paid")))


def claims_rollup(spending: DataFrame, cfg: SignalConfig) -> DataFrame:
    """One pass over the fact for everything keyed by billing NPI:
    (npi, month, hh_code) -> paid, claims, benes, where hh_code is the
    procedure code for home-health rows and NULL for all others. At most
    1 + (home-health codes billed) rows per provider-month, so it is a
    rollup, yet ``provider_month``, ``home_health_month`` and the
    home-health code list all derive from it without touching the fact."""
    hh_code = F.when(in_code_ranges(S.HCPCS, cfg.code_ranges), F.col(S.HCPCS))
    return (spending
            .groupBy(F.col(S.BILLING_NPI).alias("npi"), F.col(S.CLAIM_MONTH).alias("month"),
                     hh_code.alias("hh_code"))
            .agg(F.sum(paid_cents(S.TOTAL_PAID)).alias("paid"),
                 F.sum(S.TOTAL_CLAIMS).alias("claims"),
                 F.sum(S.TOTAL_BENES).alias("benes")))


def monthly_rollup(spending: DataFrame, cfg: SignalConfig) -> DataFrame:
    """One pass over the fact for the sums keyed by billing NPI and month: one row per
    (npi, month) with the sums of all claims and, beside them, the number of rows and the
    sums of those with a home-health code."""
    hh = in_code_ranges(S.HCPCS, cfg.code_ranges)
    sums = {"paid": paid_cents(S.TOTAL_PAID), "claims": F.col(S.TOTAL_CLAIMS), "benes": F.col(S.TOTAL_BENES)}
    return (spending
            .groupBy(F.col(S.BILLING_NPI).alias("npi"), F.col(S.CLAIM_MONTH).alias("month"))
            .agg(*[F.sum(c).alias(name) for name, c in sums.items()],
                 F.count_if(hh).alias("hh_rows"),
                 *[F.sum(F.when(hh, c)).alias(f"hh_{name}") for name, c in sums.items()]))


def provider_month_from_monthly(monthly: DataFrame) -> DataFrame:
    return monthly.select("npi", "month", "paid", "claims", "benes")


def home_health_month_from_monthly(monthly: DataFrame) -> DataFrame:
    return monthly.where(F.col("hh_rows") > 0).select(
        "npi", "month", *[F.col(f"hh_{c}").alias(c) for c in ("claims", "benes", "paid")])


def home_health_month_from_rollup(rollup: DataFrame) -> DataFrame:
    return (rollup.where(F.col("hh_code").isNotNull())
                  .groupBy("npi", "month")
                  .agg(F.sum("claims").alias("claims"), F.sum("benes").alias("benes"),
                       F.sum("paid").alias("paid")))


def home_health_code_pairs(rollup: DataFrame) -> DataFrame:
    """Distinct (npi, hcpcs_code) over home-health claims."""
    return (rollup.where(F.col("hh_code").isNotNull())
                  .select("npi", F.col("hh_code").alias("hcpcs_code")).distinct())


def registry_multiplicity(registry: DataFrame, where=None) -> DataFrame:
    """Rows per NPI in the registry (normally 1). Multiplying rollup sums by
    it reproduces the studied join-then-aggregate results exactly, duplicates
    included, while still aggregating before the join."""
    reg = registry if where is None else registry.where(where)
    return reg.groupBy("npi").agg(F.count(F.lit(1)).alias("mult"))
