"""Workforce impossibility.

Organisation-months whose claims imply more than 6 claims per working hour
(22 days x 8 h); per organisation: peak month, totals over impossible
months, and the excess over 1056 claims priced at the month's average cost.

Aggregate first (the shared (npi, month) rollup), then join the registry:
the studied SQL joins the raw fact to the registry before grouping; scaling
the sums by the registry multiplicity gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG, ENTITY_ORGANIZATION, SignalConfig
from claimlens.functions.columns import dollars, round4
from claimlens.operators.rollups import provider_month, registry_multiplicity
from claimlens.sources.tables import ClaimsTables


def impossible_months(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                      pm: DataFrame | None = None) -> DataFrame:
    pm = provider_month(tables.spending) if pm is None else pm
    orgs = registry_multiplicity(tables.registry, F.col("entity_type") == ENTITY_ORGANIZATION)
    om = pm.join(orgs, "npi").select(
        "npi", "month",
        (F.col("claims") * F.col("mult")).alias("monthly_claims"),
        dollars(F.col("paid") * F.col("mult")).alias("monthly_paid"))
    om = om.withColumn("claims_per_hour", F.col("monthly_claims").cast("double") / F.lit(cfg.hours_per_month))
    return om.where(F.col("claims_per_hour") > cfg.max_claims_per_hour)


def workforce_records(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                      pm: DataFrame | None = None) -> DataFrame:
    """S4 with unrounded values."""
    im = impossible_months(tables, cfg, pm)
    claims_d = F.col("monthly_claims").cast("double")
    excess = F.greatest(F.lit(0.0), (claims_d - F.lit(cfg.max_claims_per_month))
                        * F.try_divide(F.col("monthly_paid"), claims_d))
    # peak month: most claims, earliest month on ties (deterministic)
    peak_key = F.struct(F.col("monthly_claims"), F.col("month_desc"))
    agg = (im.withColumn("month_desc", F.translate(F.col("month"), "0123456789", "9876543210"))
             .groupBy("npi").agg(
                F.max("monthly_claims").alias("max_monthly_claims"),
                F.max_by("month", peak_key).alias("peak_month"),
                F.max("claims_per_hour").alias("implied_claims_per_hour"),
                F.max_by("monthly_paid", peak_key).alias("total_paid_peak_month"),
                F.count(F.lit(1)).alias("impossible_months_count"),
                F.sum("monthly_claims").alias("total_claims_impossible"),
                F.sum("monthly_paid").alias("total_paid_impossible"),
                F.sum(excess).alias("estimated_overpayment")))
    zero = F.lit(0.0)
    return agg.select(
        "npi",
        F.col("max_monthly_claims").cast("bigint").alias("max_monthly_claims"),
        "peak_month", "implied_claims_per_hour",
        F.coalesce("total_paid_peak_month", zero).alias("total_paid_peak_month"),
        F.col("impossible_months_count").cast("bigint").alias("impossible_months_count"),
        F.col("total_claims_impossible").cast("bigint").alias("total_claims_impossible"),
        F.coalesce("total_paid_impossible", zero).alias("total_paid_impossible"),
        F.coalesce("estimated_overpayment", zero).alias("estimated_overpayment"))


def rounded(records: DataFrame) -> DataFrame:
    return records.withColumns({c: round4(c) for c in ("implied_claims_per_hour", "total_paid_impossible", "estimated_overpayment")})


def workforce_impossibility(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                            pm: DataFrame | None = None) -> DataFrame:
    return rounded(workforce_records(tables, cfg, pm))
