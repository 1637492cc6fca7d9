"""Excluded providers still billing.

Tier 1 matches the exclusion NPI against the billing *or* servicing NPI of
each claim row; tier 2 matches exclusion records without an NPI to registry
providers by normalised (last, first, state) and then to claims. A claim
counts from the exclusion month (inclusive) until the reinstatement month
(exclusive), comparing 'YYYY-MM' text.

Plan: the test depends on a claim's NPI and month alone, so each role is
summed per (NPI, month) first, with map-side partial sums, and those
monthly sums meet the exclusion keys. The billing leg is the rollup that the
other signals use too. The keys are stored; up to ``SENT_KEYS`` of them go to the tasks that
read claims, which then sum and shuffle the claims of excluded NPIs alone.

With ``count_rows_once`` a claim row counts once, whatever its roles and however many
exclusions cover its month: periods of one NPI are merged before the join
(gaps and islands), so a month meets at most one.

With ``narrow`` the claims of the exclusion keys alone are read, for claims that are laid out
by provider (``sources.clustered``) and no rollup at hand: each role's leg is
a scan with the keys pushed into it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.config import DEFAULT_CONFIG, SignalConfig
from claimlens.functions.columns import dollars, norm_key, paid_cents, ym_from_yyyymmdd
from claimlens.functions.lineage import materialize
from claimlens.operators.rollups import provider_month
from claimlens.sources.clustered import rows_of
from claimlens.sources.tables import ClaimsTables

TIER_NPI = 1
TIER_NAME = 2

# fixed values: output column names and role labels
RESULT_COLUMNS = ["npi", "excl_date", "excl_type", "match_role",
                  "total_paid_after_exclusion", "total_claims_after_exclusion",
                  "first_claim_month", "last_claim_month"]


def _windows(excl: DataFrame) -> DataFrame:
    rein = F.col("REINDATE")
    return (excl.withColumn("excl_ym", ym_from_yyyymmdd("EXCLDATE"))
                .withColumn("rein_ym", F.when(rein.isNotNull(), ym_from_yyyymmdd(rein))))


def exclusion_keys(tables: ClaimsTables) -> DataFrame:
    """(npi, tier, EXCLDATE, EXCLTYPE, excl_ym, rein_ym) for both tiers."""
    excl = _windows(tables.exclusions)
    npi_txt = F.col("NPI").cast("string")
    tier1 = (excl.where(F.col("NPI").isNotNull() & (npi_txt != ""))
                 .select(npi_txt.alias("npi"), F.lit(TIER_NPI).alias("tier"),
                         "EXCLDATE", "EXCLTYPE", "excl_ym", "rein_ym"))
    no_npi = (excl.where(F.col("NPI").isNull() | (npi_txt == ""))
                  .select(norm_key("LASTNAME").alias("k_last"), norm_key("FIRSTNAME").alias("k_first"),
                          norm_key("STATE").alias("k_state"),
                          "EXCLDATE", "EXCLTYPE", "excl_ym", "rein_ym"))
    reg = tables.registry.select(
        "npi", norm_key("last_name").alias("k_last"), norm_key("first_name").alias("k_first"),
        norm_key("state").alias("k_state"))
    tier2 = (no_npi.join(reg, ["k_last", "k_first", "k_state"])
                   .select("npi", F.lit(TIER_NAME).alias("tier"),
                           "EXCLDATE", "EXCLTYPE", "excl_ym", "rein_ym"))
    return tier1.unionByName(tier2)


def merged_periods(keys: DataFrame) -> DataFrame:
    """The exclusion keys with the periods of one (tier, NPI) that overlap or touch made one:
    from the least start to the greatest end (NULL: still open). The record of such a
    period is its first, by date and type. Records in the order of their start begin
    a new period where they start after the greatest end so far. A period that ends
    before it has begun excludes nobody."""
    never = F.lit("9999-99")
    ends = keys.where(F.col("excl_ym").isNotNull()).withColumn("end", F.coalesce("rein_ym", never)).where("end > excl_ym")
    order = Window.partitionBy("tier", "npi").orderBy("excl_ym", "end", "EXCLDATE", "EXCLTYPE")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = ends.withColumn("begins", F.when(F.col("excl_ym") <= so_far, 0).otherwise(1))
    numbered = begins.withColumn("period", F.sum("begins").over(order))
    merged = numbered.groupBy("tier", "npi", "period").agg(
        F.min(F.struct("EXCLDATE", "EXCLTYPE")).alias("first"), F.min("excl_ym").alias("excl_ym"), F.max("end").alias("end"))
    return merged.select("npi", "tier", F.col("first.EXCLDATE").alias("EXCLDATE"), F.col("first.EXCLTYPE").alias("EXCLTYPE"),
                         "excl_ym", F.nullif("end", never).alias("rein_ym"))


#: exclusion keys up to this number are sent to the tasks that read the claims or their monthly
#: sums (some 170 bytes a key in the driver and in every executor, twice)
SENT_KEYS = 250_000


def _of_keys(spending: DataFrame, npis: DataFrame | None, column: str) -> DataFrame:
    """The claims whose ``column`` is among ``npis`` (None: all claims): a look-up in a table that
    every task holds, so a hot NPI's claims are not gathered."""
    return spending if npis is None else spending.join(F.broadcast(npis), spending[column] == npis["npi"], "left_semi")


def _serviced_by(spending: DataFrame, npis: DataFrame | None) -> DataFrame:
    """``_of_keys`` by servicing NPI. As a condition the look-up moves below a join that claims are
    built by, which a semi-join does not, so other claims are not shuffled there. (For one role
    alone: what holds for both, Spark looks up for the keys as well.)"""
    return spending if npis is None else spending.where(F.col(S.SERVICING_NPI).isin(F.broadcast(npis)))


def servicing_month(spending: DataFrame, count_rows_once: bool = False) -> DataFrame:
    """(npi, month) -> paid, claims by servicing NPI. With ``count_rows_once``
    rows that name the same NPI as the billing one are left out: the billing
    leg has them."""
    serv = F.col(S.SERVICING_NPI)
    rows = spending.where(serv.isNotNull())
    if count_rows_once:
        rows = rows.where(~serv.eqNullSafe(F.col(S.BILLING_NPI)))
    return (rows.groupBy(serv.alias("npi"), F.col(S.CLAIM_MONTH).alias("month"))
                .agg(F.sum(paid_cents(S.TOTAL_PAID)).alias("paid"), F.sum(S.TOTAL_CLAIMS).alias("claims")))


def role_months(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG, pm: DataFrame | None = None,
                npis: DataFrame | None = None) -> DataFrame:
    """(role, npi, month, paid, claims) for both roles; of claims, those of ``npis`` if given."""
    pm = provider_month(_of_keys(tables.spending, npis, S.BILLING_NPI)) if pm is None else pm
    cols = ["npi", "month", "paid", "claims"]
    billing = pm.where(F.col("npi").isNotNull()).select(F.lit("billing").alias("role"), *cols)
    claims = _serviced_by(tables.spending, npis)
    servicing = servicing_month(claims, cfg.count_rows_once).select(F.lit("servicing").alias("role"), *cols)
    return billing.unionByName(servicing)


def excluded_provider(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                      tiers: tuple[int, ...] = (TIER_NPI, TIER_NAME), pm: DataFrame | None = None,
                      narrow: bool = False) -> DataFrame:
    keys = exclusion_keys(tables)
    if tuple(tiers) != (TIER_NPI, TIER_NAME):
        keys = keys.where(F.col("tier").isin(*tiers))
    if cfg.count_rows_once:
        keys = merged_periods(keys)
    keys, npis = materialize(keys, "exclusion_keys"), None
    met = keys
    if narrow:
        pm = provider_month(rows_of(tables.spending, keys, S.BILLING_NPI))
        tables = replace(tables, spending=rows_of(tables.spending, keys, S.SERVICING_NPI))
    elif keys.count() <= SENT_KEYS:
        npis, met = keys.select("npi").distinct(), F.broadcast(keys)    # the monthly sums are not shuffled to meet them
    in_window = ((F.col("month") >= F.col("excl_ym"))
                 & (F.col("rein_ym").isNull() | (F.col("month") < F.col("rein_ym"))))
    m = role_months(tables, cfg, pm, npis).join(met, "npi").where(in_window)
    # one aggregation per (tier, npi): sums over both roles and all matching
    # exclusion records, as the studied two-level aggregation computes
    agg = m.groupBy("tier", "npi").agg(
        F.min(F.struct("EXCLDATE", "EXCLTYPE")).alias("pick"),
        F.max(F.when(F.col("role") == "billing", 1).otherwise(0)).alias("has_billing"),
        F.max(F.when(F.col("role") == "servicing", 1).otherwise(0)).alias("has_servicing"),
        F.sum("paid").alias("paid"),
        F.sum("claims").alias("claims"),
        F.min("month").alias("first_claim_month"),
        F.max("month").alias("last_claim_month"))
    role = (F.when(F.col("tier") == TIER_NAME, F.lit("name_match"))
             .when((F.col("has_billing") == 1) & (F.col("has_servicing") == 1), F.lit("billing+servicing"))
             .when(F.col("has_billing") == 1, F.lit("billing"))
             .otherwise(F.lit("servicing")))
    return agg.select(
        "tier", "npi",
        F.col("pick.EXCLDATE").alias("excl_date"),
        F.col("pick.EXCLTYPE").alias("excl_type"),
        role.alias("match_role"),
        F.coalesce(dollars("paid"), F.lit(0.0)).alias("total_paid_after_exclusion"),
        F.coalesce(F.col("claims"), F.lit(0)).cast("bigint").alias("total_claims_after_exclusion"),
        "first_claim_month", "last_claim_month")
