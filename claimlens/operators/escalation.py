"""S3: rapid billing escalation of newly enumerated providers.

Eligible: registry enumeration month <= first billed month <= enumeration
month + 24 months. Within the first 12 *billed* months, a 3-row rolling
average is compared with the same average 3 rows earlier; from rank 6 on a
growth above 200 % flags the provider.

All windows are partitioned by NPI over the (npi, month) rollup, so a
partition holds at most one provider's months; the windows share one
exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG, SignalConfig
from claimlens.functions.columns import dollars, nonblank, parse_mdy, round4
from claimlens.operators.rollups import provider_month
from claimlens.sources.tables import ClaimsTables


def _by_month():
    return Window.partitionBy("npi").orderBy(F.asc_nulls_last("month"))


def _ranked_months(months: DataFrame) -> DataFrame:
    # months in order, a NULL month last; the running minimum over that order is
    # the first month, so both values come from one window
    return (months.withColumn("first_billing_month", F.min("month").over(_by_month()))
                  .withColumn("month_rank", F.row_number().over(_by_month())))


def escalation_growth(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                      pm: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Per eligible provider-month: rank, rolling average, growth vs lag. With the lifetime
    ``totals`` at hand, a provider whose first month is out of reach is left out before
    its months are sorted."""
    pm = provider_month(tables.spending) if pm is None else pm
    reg = (tables.registry.where(nonblank("enumeration_date"))
           .select("npi", F.col("enumeration_date").alias("enum_date_raw"),
                   parse_mdy("enumeration_date").alias("_enum")))
    reg = (reg.withColumn("enum_ym", F.date_format("_enum", "yyyy-MM"))
              .withColumn("enum_plus_ym", F.date_format(
                  F.add_months("_enum", cfg.enumeration_window_months), "yyyy-MM"))
              .drop("_enum"))
    if totals is not None:
        reg = (reg.join(totals.select("npi", "first_month"), "npi")
                  .where("enum_ym <= first_month AND first_month <= enum_plus_ym").drop("first_month"))
    # join first, then rank: the join already hash-partitions by NPI, so the
    # windows add no exchange (and registry duplicates rank as in the SQL)
    months = _ranked_months(
        pm.select("npi", "month", dollars("paid").alias("monthly_paid")).join(reg, "npi"))
    eligible = months.where(
        F.col("enum_ym").isNotNull()
        & (F.col("enum_ym") <= F.col("first_billing_month"))
        & (F.col("first_billing_month") <= F.col("enum_plus_ym"))
        & (F.col("month_rank") <= cfg.first_billed_months))
    w = _by_month()
    rolled = eligible.withColumn(
        "rolling_avg", F.avg("monthly_paid").over(w.rowsBetween(-(cfg.rolling_rows - 1), 0)))
    rolled = rolled.withColumn("prev_rolling_avg", F.lag("rolling_avg", cfg.growth_lag_rows).over(w))
    counted = (F.col("month_rank") >= cfg.min_growth_rank) & (F.col("prev_rolling_avg") > 0)
    growth = (F.col("rolling_avg") - F.col("prev_rolling_avg")) / F.col("prev_rolling_avg") * 100.0
    return rolled.withColumn("growth_pct", F.when(counted, growth).otherwise(F.lit(0.0)))


def escalation_records(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                       pm: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """S3 with unrounded values."""
    g = escalation_growth(tables, cfg, pm, totals)
    zero = F.lit(0.0)
    excess = F.when(F.col("growth_pct") > cfg.growth_pct_threshold, F.col("monthly_paid")).otherwise(0.0)
    agg = g.groupBy("npi").agg(
        F.max("growth_pct").alias("max_growth"),
        F.max("monthly_paid").alias("peak"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.min("enum_date_raw").alias("enum_date"),
        F.sum("monthly_paid").alias("paid"),
        F.sum(excess).alias("excess"))
    return (agg.where(F.col("max_growth") > cfg.growth_pct_threshold)
               .select("npi", F.col("max_growth").alias("max_growth_pct"),
                       F.coalesce("peak", zero).alias("peak_monthly_paid"), "first_month", "last_month", "enum_date",
                       F.coalesce("paid", zero).alias("total_paid_12mo"),
                       F.coalesce("excess", zero).alias("total_paid_excess_growth_months"),
                       F.col("first_month").alias("first_billing_month")))


def rounded(records: DataFrame) -> DataFrame:
    return records.withColumns({c: round4(c) for c in ("max_growth_pct", "total_paid_12mo", "total_paid_excess_growth_months")})


def rapid_escalation(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                     pm: DataFrame | None = None) -> DataFrame:
    return rounded(escalation_records(tables, cfg, pm))


def escalation_months(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                      pm: DataFrame | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """S3d: first 12 billed months (npi, month, monthly_paid) of flagged NPIs,
    long form (the report folds it into a month -> amount map)."""
    pm = provider_month(tables.spending) if pm is None else pm
    flagged = rapid_escalation(tables, cfg, pm) if flagged is None else flagged
    ranked = (pm.join(flagged.select("npi"), "npi", "left_semi")
                .withColumn("month_rank", F.row_number().over(_by_month())))
    return (ranked.where(F.col("month_rank") <= cfg.first_billed_months)
                  .select("npi", "month", F.coalesce(dollars("paid"), F.lit(0.0)).alias("monthly_paid")))
