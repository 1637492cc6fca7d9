"""Named queries over the driver's star tables: one per operator of the
inventory. Each takes (spark, sf_dir) and returns a DataFrame whose work
grows with the input tables. Queries that read a derived table more than once
write it when they are built. Outputs are flat (lists in long form or
joined to text) so they compare value-by-value against SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG
from claimlens.functions.columns import round4
from claimlens.functions.lineage import materialize, release
from claimlens.operators import escalation, excluded, home_health, official, outlier
from claimlens.operators.excluded import RESULT_COLUMNS as S1_COLUMNS
from claimlens.operators.rollups import provider_month, provider_totals
from claimlens.plans import drilldown
from claimlens.plans import report as R
from claimlens.plans.flags import SignalSet
from claimlens.plans.session import apply_session_conf
from claimlens.sources.clustered import materialize_clustered
from claimlens.sources.star import overlapping_exclusions
from claimlens.sources.tables import ClaimsTables, load_star_tables

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    apply_session_conf(spark)
    release()   # caches of previously built queries (speed only, never results)
    return load_star_tables(spark, sf_dir)


def _signals(spark: SparkSession, sf_dir: str, materialize: bool = False) -> SignalSet:
    return SignalSet(_tables(spark, sf_dir), DEFAULT_CONFIG, materialize_rollups=materialize)


# --- sources ---------------------------------------------------------------
def q_scan_claims(spark, sf_dir):
    return _tables(spark, sf_dir).spending


def q_normalize_exclusions(spark, sf_dir):
    return _tables(spark, sf_dir).exclusions


def q_registry_view(spark, sf_dir):
    return _tables(spark, sf_dir).registry


def q_table_counts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in (("spending", t.spending), ("nppes", t.registry), ("leie", t.exclusions))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- signals ---------------------------------------------------------------
def q_excluded_provider_npi(spark, sf_dir):
    return excluded.excluded_provider(_tables(spark, sf_dir), tiers=(excluded.TIER_NPI,)).select(*S1_COLUMNS)


def q_excluded_provider_name(spark, sf_dir):
    return excluded.excluded_provider(_tables(spark, sf_dir), tiers=(excluded.TIER_NAME,)).select(*S1_COLUMNS)


def q_excluded_provider(spark, sf_dir):
    return _signals(spark, sf_dir).excluded_provider().select(*S1_COLUMNS)


def q_excluded_provider_clustered(spark, sf_dir):
    """S1 from claims laid out by provider: only the claims of exclusion keys are read."""
    t = _tables(spark, sf_dir)
    t = replace(t, spending=materialize_clustered(t.spending))
    return SignalSet(t, DEFAULT_CONFIG, clustered=True).excluded_provider().select(*S1_COLUMNS)


def q_excluded_provider_once(spark, sf_dir):
    t = _tables(spark, sf_dir)
    t = replace(t, exclusions=overlapping_exclusions(t.exclusions))
    return excluded.excluded_provider(t, replace(DEFAULT_CONFIG, count_rows_once=True)).select("tier", *S1_COLUMNS)


def q_peer_group_stats(spark, sf_dir):
    return (outlier.peer_group_stats(_tables(spark, sf_dir))
            .withColumn("median_paid", round4("median_paid")).withColumn("p99_paid", round4("p99_paid")))


def q_peer_group_sketches(spark, sf_dir):
    return outlier.peer_level_ranks(_tables(spark, sf_dir))


def q_billing_outlier(spark, sf_dir):
    return _signals(spark, sf_dir).billing_outlier()


def q_rapid_escalation(spark, sf_dir):
    return _signals(spark, sf_dir).rapid_escalation()


def q_escalation_months(spark, sf_dir):
    ss = _signals(spark, sf_dir)
    ss.pm = materialize(ss.pm, "provider_month")    # read by the signal and by its months
    return escalation.escalation_months(ss.tables, ss.cfg, ss.pm)


def q_workforce_impossibility(spark, sf_dir):
    return _signals(spark, sf_dir).workforce_impossibility()


def q_official_groups(spark, sf_dir):
    return (official.official_groups(_tables(spark, sf_dir))
            .withColumn("states", F.array_join("states", ",")))


def q_shared_official(spark, sf_dir):
    return _signals(spark, sf_dir).shared_official().withColumn("states", F.array_join("states", ","))


def q_official_npi_totals(spark, sf_dir):
    ss = _signals(spark, sf_dir)
    ss.pm = materialize(ss.pm, "provider_month")
    return official.official_npi_totals(ss.tables, ss.cfg, ss.pm)


def q_geographic_implausibility(spark, sf_dir):
    return _signals(spark, sf_dir).geographic_implausibility()


def q_home_health_codes(spark, sf_dir):
    return home_health.home_health_codes(_tables(spark, sf_dir))


def q_home_health_months(spark, sf_dir):
    ss = _signals(spark, sf_dir)
    return home_health.home_health_months(ss.tables, ss.cfg, ss.hm)


# --- flags and report -------------------------------------------------------
def q_all_flags(spark, sf_dir):
    """One row per signal record (before the fan-out to member NPIs)."""
    return (_signals(spark, sf_dir, materialize=True).flag_records()
            .select("signal_type", F.col("order_key").alias("flag_key"), "severity",
                    round4("overpayment").alias("overpayment")))


def q_flag_severity(spark, sf_dir):
    return (_signals(spark, sf_dir, materialize=True).flag_records().groupBy("signal_type", "severity")
            .agg(F.count(F.lit(1)).alias("flag_count")))


def q_flag_overpayment(spark, sf_dir):
    return (_signals(spark, sf_dir, materialize=True).flag_records().groupBy("signal_type")
            .agg(R.money(F.sum("overpayment")).alias("total_overpayment"),
                 R.money(F.max("overpayment")).alias("max_overpayment")))


def q_flags_by_npi(spark, sf_dir):
    return (_signals(spark, sf_dir, materialize=True).flags_by_npi()
            .select("signal_type", "npi", "severity", round4("overpayment").alias("overpayment")))


def q_provider_enrichment(spark, sf_dir):
    ss = _signals(spark, sf_dir, materialize=True)
    return R.provider_enrichment(ss.tables.registry, R.flagged_npis(ss.flags_by_npi()))


def q_provider_lifetime_stats(spark, sf_dir):
    ss = _signals(spark, sf_dir, materialize=True)
    return R.provider_lifetime_stats(provider_totals(ss.pm), R.flagged_npis(ss.flags_by_npi()))


def q_providers_scanned(spark, sf_dir):
    return R.providers_scanned(provider_month(_tables(spark, sf_dir).spending))


FLAT_REPORT = ["npi", "provider_name", "entity_type", "taxonomy_code", "state", "enumeration_date",
               "total_paid_all_time", "total_claims_all_time", "total_unique_beneficiaries_all_time",
               "n_signals", "top_severity", "severity_rank", "most_severe_signal",
               "estimated_overpayment_usd", "claim_type", "statute_reference"]


def q_provider_report(spark, sf_dir):
    return R.provider_report(_signals(spark, sf_dir, materialize=True), evidence=False).select(*FLAT_REPORT)


def q_provider_next_steps(spark, sf_dir):
    return R.provider_next_steps(R.provider_report(_signals(spark, sf_dir, materialize=True), evidence=False))


def q_report_ranked(spark, sf_dir):
    """The whole nested report, ranked; a digest of it is returned."""
    rep = R.provider_report(_signals(spark, sf_dir, materialize=True))
    return R.report_ranked(rep).select("rank", "npi", "top_severity", "estimated_overpayment_usd")


def q_flagged_claims(spark, sf_dir):
    """Claims of providers with an escalation flag, by month and code."""
    ss = _signals(spark, sf_dir)
    claims = materialize_clustered(ss.tables.spending)
    return drilldown.by_month_and_code(drilldown.flagged_claims(claims, ss.escalation_records()))


def q_signal_counts(spark, sf_dir):
    return R.signal_counts(_signals(spark, sf_dir, materialize=True).flag_records())


def q_report_summary(spark, sf_dir):
    ss = _signals(spark, sf_dir, materialize=True)
    return R.report_summary(ss.pm, ss.flags_by_npi())


QUERIES: dict[str, Query] = {
    "scan_claims": q_scan_claims,
    "normalize_exclusions": q_normalize_exclusions,
    "registry_view": q_registry_view,
    "table_counts": q_table_counts,
    "excluded_provider_npi": q_excluded_provider_npi,
    "excluded_provider_name": q_excluded_provider_name,
    "excluded_provider": q_excluded_provider,
    "excluded_provider_clustered": q_excluded_provider_clustered,
    "excluded_provider_once": q_excluded_provider_once,
    "peer_group_stats": q_peer_group_stats,
    "peer_group_sketches": q_peer_group_sketches,
    "billing_outlier": q_billing_outlier,
    "rapid_escalation": q_rapid_escalation,
    "escalation_months": q_escalation_months,
    "workforce_impossibility": q_workforce_impossibility,
    "official_groups": q_official_groups,
    "shared_official": q_shared_official,
    "official_npi_totals": q_official_npi_totals,
    "geographic_implausibility": q_geographic_implausibility,
    "home_health_codes": q_home_health_codes,
    "home_health_months": q_home_health_months,
    "all_flags": q_all_flags,
    "flag_severity": q_flag_severity,
    "flag_overpayment": q_flag_overpayment,
    "flags_by_npi": q_flags_by_npi,
    "provider_enrichment": q_provider_enrichment,
    "provider_lifetime_stats": q_provider_lifetime_stats,
    "providers_scanned": q_providers_scanned,
    "provider_report": q_provider_report,
    "provider_next_steps": q_provider_next_steps,
    "report_ranked": q_report_ranked,
    "flagged_claims": q_flagged_claims,
    "signal_counts": q_signal_counts,
    "report_summary": q_report_summary,
}
