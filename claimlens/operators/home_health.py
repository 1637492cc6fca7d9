"""Home-health billing with too few beneficiaries per claim.

Home-health claims (4 procedure code ranges) are rolled up per provider
month; months above 100 claims are kept; a provider whose beneficiaries /
claims over those months is below 0.1 is flagged, with the registry state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.config import DEFAULT_CONFIG, SignalConfig
from claimlens.functions.columns import dollars, round4, safe_ratio
from claimlens.functions.lineage import materialize
from claimlens.operators.rollups import (claims_rollup, home_health_claims, home_health_code_pairs, home_health_month,
                                         home_health_month_from_rollup)
from claimlens.sources.tables import ClaimsTables


def high_volume_months(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                       hm: DataFrame | None = None) -> DataFrame:
    hm = home_health_month(tables.spending, cfg) if hm is None else hm
    return hm.where(F.col("claims") > cfg.min_monthly_claims)


def _flagged_core(tables: ClaimsTables, cfg: SignalConfig, hm: DataFrame | None) -> DataFrame:
    hv = high_volume_months(tables, cfg, hm)
    agg = hv.groupBy("npi").agg(
        F.sum("claims").alias("claims"), F.sum("benes").alias("benes"), F.sum("paid").alias("paid"),
        F.count(F.lit(1)).alias("months_flagged"),
        F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    agg = agg.withColumn("ratio", safe_ratio(F.col("benes"), F.col("claims")))
    return agg.where(F.col("ratio") < cfg.max_bene_ratio)


def home_health_records(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                        hm: DataFrame | None = None) -> DataFrame:
    """S6 with unrounded values."""
    core = _flagged_core(tables, cfg, hm)
    states = tables.registry.select("npi", "state")
    return (core.join(states, "npi", "left")
                .select("npi",
                        F.col("claims").cast("bigint").alias("total_claims"),
                        F.coalesce(F.col("benes"), F.lit(0)).cast("bigint").alias("total_beneficiaries"),
                        F.coalesce(dollars("paid"), F.lit(0.0)).alias("total_paid"),
                        F.col("ratio").alias("bene_to_claims_ratio"),
                        F.col("months_flagged").cast("bigint").alias("months_flagged"),
                        "first_month", "last_month",
                        F.nullif(F.col("state"), F.lit("")).alias("state")))


def rounded(records: DataFrame) -> DataFrame:
    return records.withColumn("bene_to_claims_ratio", round4("bene_to_claims_ratio"))


def geographic_implausibility(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                              hm: DataFrame | None = None) -> DataFrame:
    return rounded(home_health_records(tables, cfg, hm))


def home_health_codes(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                      flagged: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """S6d1: distinct (npi, hcpcs_code) of flagged NPIs over all their
    home-health claims (long form). Distinct pairs are reduced map-side
    before the shuffle (or come from the shared rollup); the flagged set
    then filters the small result."""
    if pairs is None and flagged is not None:
        pairs = (home_health_claims(tables.spending, cfg)
                 .select(F.col(S.BILLING_NPI).alias("npi"), F.col(S.HCPCS).alias("hcpcs_code")).distinct())
    elif pairs is None:
        # one scan of the claims for both: the codes and the flagged providers
        rollup = materialize(claims_rollup(home_health_claims(tables.spending, cfg), cfg), "home_health_rollup")
        pairs = home_health_code_pairs(rollup)
        flagged = geographic_implausibility(tables, cfg, home_health_month_from_rollup(rollup))
    flagged = geographic_implausibility(tables, cfg) if flagged is None else flagged
    return pairs.join(flagged.select("npi"), "npi", "left_semi")


def home_health_months(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                       hm: DataFrame | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """S6d2: high-volume month detail of flagged NPIs (long form)."""
    if flagged is None:     # both sides read the monthly sums: store them once
        hm = materialize(home_health_month(tables.spending, cfg) if hm is None else hm, "home_health_months")
        flagged = geographic_implausibility(tables, cfg, hm)
    hm = home_health_month(tables.spending, cfg) if hm is None else hm
    hv = high_volume_months(tables, cfg, hm).join(flagged.select("npi"), "npi", "left_semi")
    return hv.select("npi", "month",
                     F.col("claims").cast("bigint").alias("claims_count"),
                     F.coalesce(F.col("benes"), F.lit(0)).cast("bigint").alias("unique_beneficiaries"),
                     F.coalesce(dollars("paid"), F.lit(0.0)).alias("monthly_paid"),
                     F.coalesce(round4(safe_ratio(F.col("benes"), F.col("claims"))), F.lit(0.0)).alias("ratio"))
