"""The provider-level report.

flags (long) -> group by NPI -> enrich from the registry and lifetime
rollup -> rank. Every step is keyed by NPI; lists inside a provider record
are bounded by the number of flags one provider can carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import SIGNAL_ORDER, TOOL_VERSION
from claimlens.functions.columns import dollars, entity_label, mdy_to_iso, provider_name
from claimlens.functions.lineage import materialize
from claimlens.functions.ranking import global_rank
from claimlens.operators.rollups import provider_totals
from claimlens.plans.flags import SignalSet
from claimlens.plans.report_text import NEXT_STEPS, signal_dimension


def money(c):
    """Round a double to cents, half-even on its decimal value (the same in
    every engine, unlike binary rounding of the double)."""
    return F.bround(c.cast("decimal(38,6)"), 2).cast("double")


def severity_label(rank):
    """3/2/1/0 -> critical/high/medium/low."""
    return (F.when(rank == 3, "critical").when(rank == 2, "high")
             .when(rank == 1, "medium").otherwise("low"))


def flagged_npis(flags: DataFrame) -> DataFrame:
    return flags.select("npi").where(F.col("npi").isNotNull()).distinct()


def provider_enrichment(registry: DataFrame, npis: DataFrame) -> DataFrame:
    """One registry row per flagged NPI (deterministic pick among
    duplicates), NPIs missing from the registry kept with NULLs."""
    fields = ["entity_type", "org_name", "last_name", "first_name", "state", "postal_code",
              "taxonomy", "enumeration_date"]
    hits = (registry.join(npis, "npi", "left_semi")
            .groupBy("npi").agg(F.min(F.struct(*fields)).alias("r"))
            .select("npi", *[F.col(f"r.{f}").alias(f) for f in fields]))
    return npis.join(hits, "npi", "left")


def provider_lifetime_stats(totals: DataFrame, npis: DataFrame) -> DataFrame:
    """Lifetime totals (``provider_totals``) of flagged NPIs, zero-filled for
    non-billers."""
    return npis.join(totals, "npi", "left").select(
        "npi",
        F.coalesce(dollars("paid"), F.lit(0.0)).alias("total_paid_all_time"),
        F.coalesce(F.col("claims"), F.lit(0)).cast("bigint").alias("total_claims_all_time"),
        F.coalesce(F.col("benes"), F.lit(0)).cast("bigint").alias("total_unique_beneficiaries_all_time"),
        F.col("first_month").alias("first_claim"),
        F.col("last_month").alias("last_claim"))


def providers_scanned(billers: DataFrame) -> DataFrame:
    """Distinct billing NPIs (exact, NULL is none), one row."""
    return (billers.select("npi").where(F.col("npi").isNotNull()).distinct()
            .agg(F.count(F.lit(1)).alias("total_providers_scanned")))


def _steps_of(signal_types):
    """The next steps of an array of signal types, first mention first: a lookup in a
    constant map of six entries, so that no text travels with the flags."""
    steps = F.create_map(*[x for k, v in NEXT_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(signal_types, lambda s: F.element_at(steps, s))))


def provider_records(flags: DataFrame, spark_dim: DataFrame) -> DataFrame:
    """R10-R12 core: one row per NPI with the ordered signal list, total
    overpayment, most severe signal (first of equals) and next steps. ``flags``
    may lack the evidence column; then the signal list does too."""
    shown = [c for c in ("signal_type", "severity", "evidence") if c in flags.columns]
    order = F.struct("signal_index", "order_value", "order_key")
    per_npi = flags.where(F.col("npi").isNotNull()).groupBy("npi").agg(
        F.sum("overpayment").alias("overpayment_sum"),
        F.max("severity_rank").alias("top_rank"),
        F.min(F.struct((-F.col("severity_rank")).alias("neg_rank"), "signal_index", "order_value",
                       "order_key", "signal_type")).alias("top"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), *shown))).alias("sigs"),
        F.count(F.lit(1)).alias("n_signals"))
    per_npi = per_npi.join(F.broadcast(spark_dim).withColumnRenamed("signal_type", "most_severe_signal"),
                           F.col("top.signal_type") == F.col("most_severe_signal"), "left")
    return per_npi.select(
        "npi", "n_signals",
        severity_label(F.col("top_rank")).alias("top_severity"),
        F.col("top_rank").alias("severity_rank"),
        "most_severe_signal", "claim_type", "statute_reference",
        money(F.col("overpayment_sum")).alias("estimated_overpayment_usd"),
        F.transform("sigs", lambda s: F.struct(*[s[c].alias(c) for c in shown])).alias("signals"),
        _steps_of(F.transform("sigs", lambda s: s["signal_type"])).alias("next_steps"))


def build_report(flags: DataFrame, registry: DataFrame, totals: DataFrame) -> DataFrame:
    """R4-R12 from stored flags, the registry and the lifetime totals per provider."""
    core = provider_records(flags, signal_dimension(flags.sparkSession))
    npis = core.select("npi")
    enr = provider_enrichment(registry, npis)
    stats = provider_lifetime_stats(totals, npis)
    rec = core.join(enr, "npi", "left").join(stats, "npi", "left")
    return rec.select(
        "npi",
        provider_name("org_name", "first_name", "last_name").alias("provider_name"),
        entity_label("entity_type").alias("entity_type"),
        F.coalesce(F.col("taxonomy"), F.lit("")).alias("taxonomy_code"),
        F.coalesce(F.col("state"), F.lit("")).alias("state"),
        mdy_to_iso(F.col("enumeration_date")).alias("enumeration_date"),
        "total_paid_all_time", "total_claims_all_time", "total_unique_beneficiaries_all_time",
        "n_signals", "top_severity", "severity_rank", "most_severe_signal",
        "estimated_overpayment_usd", "claim_type", "statute_reference",
        "signals", "next_steps")


def provider_report(signals: SignalSet, evidence: bool = True) -> DataFrame:
    """Flat provider report (R4-R12): identity, lifetime totals, severity,
    overpayment, legal reference; nested signal list and next steps. The flag
    table is the hand-off between the signal and report stages: written once,
    bucketed like the rollup, read by the grouping, enrichment and lifetime joins."""
    flags = signals.flags_with_evidence() if evidence else signals.flags_by_npi()
    flags = materialize(flags, "flags", bucket_by="npi", buckets=signals.buckets or None, sort_by=("npi",))
    return build_report(flags, signals.tables.registry, provider_totals(signals.pm) if signals.totals is None else signals.totals)


def report_ranked(report: DataFrame) -> DataFrame:
    """Global order - most severe first, then overpayment descending,
    NPI as the final tie-break; ``rank`` is the 1-based position. The report is stored
    first: the sort samples its keys before it moves the rows, and would build it twice."""
    return global_rank(materialize(report, "report"), [F.desc("severity_rank"), F.desc("estimated_overpayment_usd"),
                                F.asc("npi")], "rank")


def nested_report(report: DataFrame) -> DataFrame:
    """Provider records in the published nested shape (fca_relevance struct), with
    ``rank`` if the report is ranked."""
    return report.select(
        *[c for c in ("rank",) if c in report.columns], "npi", "provider_name", "entity_type", "taxonomy_code", "state", "enumeration_date",
        "total_paid_all_time", "total_claims_all_time", "total_unique_beneficiaries_all_time",
        "signals", "estimated_overpayment_usd",
        F.struct("claim_type", "statute_reference",
                 F.col("next_steps").alias("suggested_next_steps")).alias("fca_relevance"))


def provider_next_steps(report: DataFrame) -> DataFrame:
    """R11 long form: (npi, step_no, step)."""
    return report.select("npi", F.posexplode("next_steps").alias("pos", "step")).select(
        "npi", (F.col("pos") + 1).cast("bigint").alias("step_no"), "step")


def signal_counts(flags: DataFrame) -> DataFrame:
    """Flag records per signal, zeros included, from records or from the
    per-provider flag table (a shared official's flag counts once)."""
    spark = flags.sparkSession
    names = spark.createDataFrame([(n,) for n in SIGNAL_ORDER], "signal_type string")
    counts = flags.groupBy("signal_type").agg(F.count_distinct("flag_id").alias("n"))
    return (names.join(counts, "signal_type", "left")
            .select("signal_type", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("flag_count")))


def report_summary(billers: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: providers scanned, providers flagged, tool version.
    The two single-value aggregates are stacked and folded into one row."""
    scanned = providers_scanned(billers).select(F.lit("scanned").alias("k"),
                                                F.col("total_providers_scanned").alias("v"))
    flagged = flagged_npis(flags).agg(F.count(F.lit(1)).alias("v")).select(F.lit("flagged").alias("k"), "v")
    return (scanned.unionByName(flagged)
            .agg(F.max(F.when(F.col("k") == "scanned", F.col("v"))).cast("bigint").alias("total_providers_scanned"),
                 F.max(F.when(F.col("k") == "flagged", F.col("v"))).cast("bigint").alias("total_providers_flagged"))
            .select("total_providers_scanned", "total_providers_flagged",
                    F.lit(TOOL_VERSION).alias("tool_version")))


def report_header(billers: DataFrame, flags: DataFrame) -> DataFrame:
    """Summary plus generation time (UTC) and per-signal counts (a 6-entry map)."""
    counts = signal_counts(flags).agg(F.map_from_entries(F.collect_list(
        F.struct("signal_type", "flag_count"))).alias("signal_counts")).withColumn("_k", F.lit(1))
    summary = report_summary(billers, flags).withColumn("_k", F.lit(1))
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return (summary.join(counts, "_k").drop("_k")   # one row on each side
            .withColumn("generated_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
