"""One authorised official behind many organisations.

Officials are keyed by normalised (last, first) name over organisation
registry rows. Groups with at least 5 distinct NPIs and combined billing
above $1M are flagged.

Membership stays in long form (official, npi): an official's NPI list is
never collected into one row, so an official controlling a third of all
organisations costs no more per task than any other. Only the state list
(bounded by the number of states) is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG, ENTITY_ORGANIZATION, SignalConfig
from claimlens.functions.columns import dollars, nonblank, norm_key
from claimlens.operators.rollups import provider_month, provider_totals
from claimlens.sources.tables import ClaimsTables

OFFICIAL_KEY = ["off_last", "off_first"]


def official_npis(tables: ClaimsTables) -> DataFrame:
    """(off_last, off_first, npi, state) for organisation rows."""
    reg = tables.registry
    return (reg.where(nonblank("auth_off_last") & nonblank("auth_off_first")
                      & (F.col("entity_type") == ENTITY_ORGANIZATION))
               .select(norm_key("auth_off_last").alias("off_last"),
                       norm_key("auth_off_first").alias("off_first"),
                       "npi", "state"))


def official_groups(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                    members: DataFrame | None = None) -> DataFrame:
    """Officials with >= min distinct NPIs: (off_last, off_first,
    npi_count, states) with states sorted, NULL dropped."""
    members = official_npis(tables) if members is None else members
    return (members.groupBy(*OFFICIAL_KEY)
                   .agg(F.count_distinct("npi").alias("npi_count"),
                        F.array_sort(F.collect_set("state")).alias("states"))
                   .where(F.col("npi_count") >= cfg.min_official_npis)
                   .withColumn("npi_count", F.col("npi_count").cast("bigint")))


def shared_official(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                    pm: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    if totals is None:
        totals = provider_totals(provider_month(tables.spending) if pm is None else pm)
    members = official_npis(tables)
    groups = official_groups(tables, cfg, members)
    totals = totals.select("npi", "paid", "claims")
    # every member registry row contributes its NPI's billing (inner join:
    # members without claims add nothing)
    spend = (members.select(*OFFICIAL_KEY, "npi").join(totals, "npi")
                    .groupBy(*OFFICIAL_KEY)
                    .agg(F.sum("paid").alias("paid"), F.sum("claims").alias("claims")))
    return (groups.join(spend, OFFICIAL_KEY)
                  .where(dollars("paid") > F.lit(cfg.min_official_combined_paid))
                  .select(*OFFICIAL_KEY, "npi_count", "states",
                          dollars("paid").alias("combined_total_paid"),
                          F.coalesce(F.col("claims"), F.lit(0)).cast("bigint").alias("combined_total_claims")))


def official_members(tables: ClaimsTables, flagged: DataFrame) -> DataFrame:
    """Distinct (off_last, off_first, npi) of flagged officials: the long
    form of the studied ``npi_list``."""
    return (official_npis(tables).select(*OFFICIAL_KEY, "npi").distinct()
            .join(flagged.select(*OFFICIAL_KEY), OFFICIAL_KEY, "left_semi"))


def official_npi_totals(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                        pm: DataFrame | None = None, flagged: DataFrame | None = None,
                        totals: DataFrame | None = None) -> DataFrame:
    """S5d: per member NPI of a flagged official, lifetime paid (0.0 when the
    NPI never billed)."""
    if totals is None:
        totals = provider_totals(provider_month(tables.spending) if pm is None else pm)
    flagged = shared_official(tables, cfg, pm, totals) if flagged is None else flagged
    totals = totals.select("npi", "paid")
    return (official_members(tables, flagged).join(totals, "npi", "left")
            .select(*OFFICIAL_KEY, "npi",
                    F.coalesce(dollars("paid"), F.lit(0.0)).alias("total_paid")))
