"""Every signal's records as one long flag table.

``flag_records``: one row per signal record, with severity and overpayment,
without evidence (what the signal counts report).
``flags_by_npi``: the records fanned out to NPIs; a shared-official record
goes to every member NPI through the long-form membership table. A record
without an NPI belongs to no provider and stops here.
``flags_with_evidence``: the same rows with each flag's evidence as JSON, for
the report.

Severity and overpayment are decided on unrounded values; evidence shows the
rounded ones.

Ordering inside the report ("first of equals") follows the run order of the
signals and each signal's own result order; both are carried as sortable
columns (signal_index, order_value, order_key) instead of a global row
number, so no step needs a single-partition window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG, SEVERITY_RANK, SIGNAL_ORDER, SignalConfig
from claimlens.functions.lineage import buckets_for, keep, materialize
from claimlens.operators import escalation, excluded, home_health, official, outlier, workforce
from claimlens.operators.rollups import (home_health_month, home_health_month_from_monthly, monthly_rollup,
                                        provider_month, provider_month_from_monthly, provider_totals)
from claimlens.sources.tables import ClaimsTables

FLAG_COLUMNS = ["signal_type", "signal_index", "order_value", "order_key", "flag_id", "npi",
                "severity", "severity_rank", "overpayment", "evidence"]


#: bytes of claims read per bucket of a run's stored tables: a bucket is one task of every later step
BUCKET_BYTES = 32 * 1024 * 1024


class SignalSet:
    """All signal results of one run, built on shared rollups."""

    def __init__(self, tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                 materialize_rollups: bool = False, signals: Sequence[str] = SIGNAL_ORDER, clustered: bool = False):
        """``materialize_rollups`` is for runs that evaluate several signals
        (the flag table, the report): the fact is rolled up once to a row per provider
        and month, written bucketed and sorted on NPI next to the lifetime totals and the
        registry, so joins, per-provider aggregates and NPI windows need no exchange and
        joins no sort. Both monthly rollups are columns of that table. Small signal results that several branches
        read are persisted (a lost block is rebuilt from the bucket files, not from
        the fact). ``signals``: the ones
        whose flags are wanted; plans of the others are not built. ``clustered``: the
        claims are laid out by provider, so S1 without a rollup reads its keys' claims alone."""
        unknown = set(signals) - set(SIGNAL_ORDER)
        if unknown:
            raise ValueError(f"no signal {', '.join(sorted(unknown))}")
        self.signals = tuple(s for s in SIGNAL_ORDER if s in signals)
        self.narrow = clustered and not materialize_rollups
        self.cfg = cfg
        buckets = buckets_for(tables.spending, BUCKET_BYTES) if materialize_rollups else 0
        self.buckets = buckets
        self._memo: dict[str, DataFrame] = {}
        self._keep = materialize_rollups
        if materialize_rollups:
            tables = ClaimsTables(
                spending=tables.spending,
                registry=materialize(tables.registry, "registry", bucket_by="npi", buckets=buckets, sort_by=("npi",)),
                exclusions=tables.exclusions)
            monthly = materialize(monthly_rollup(tables.spending, cfg), "monthly_rollup", bucket_by="npi", buckets=buckets,
                                  sort_by=("npi", "month"))
            self.pm = provider_month_from_monthly(monthly)
            self.hm = home_health_month_from_monthly(monthly)
            self.totals = materialize(provider_totals(self.pm), "provider_totals", bucket_by="npi", buckets=buckets,
                                      sort_by=("npi",))
        else:
            self._pm = self._hm = self.totals = None
        self.tables = tables

    # rollups of a non-materialised run are built on first use only
    @property
    def pm(self) -> DataFrame:
        if self._pm is None:
            self._pm = provider_month(self.tables.spending)
        return self._pm

    @pm.setter
    def pm(self, value: DataFrame) -> None:
        self._pm = value

    @property
    def hm(self) -> DataFrame:
        if self._hm is None:
            self._hm = home_health_month(self.tables.spending, self.cfg)
        return self._hm

    @hm.setter
    def hm(self, value: DataFrame) -> None:
        self._hm = value

    def _persist(self, df: DataFrame) -> DataFrame:
        return keep(df) if self._keep else df

    def _once(self, name: str, build, shared: bool = False) -> DataFrame:
        """Built on first use; persisted if ``shared``, i.e. read by several branches of a plan."""
        if name not in self._memo:
            self._memo[name] = self._persist(build()) if shared else build()
        return self._memo[name]

    # --- signal results, one per signal (flag records), unrounded ---
    def excluded_provider(self) -> DataFrame:
        if self.narrow:
            return self._once("s1", lambda: excluded.excluded_provider(self.tables, self.cfg, narrow=True))
        return self._once("s1", lambda: excluded.excluded_provider(self.tables, self.cfg, pm=self.pm))

    def outlier_records(self) -> DataFrame:
        return self._once("s2", lambda: outlier.outlier_records(self.tables, self.cfg, self.pm, self.totals))

    def escalation_records(self) -> DataFrame:
        return self._once("s3", lambda: escalation.escalation_records(self.tables, self.cfg, self.pm, self.totals))

    def workforce_records(self) -> DataFrame:
        return self._once("s4", lambda: workforce.workforce_records(self.tables, self.cfg, self.pm))

    def shared_official(self) -> DataFrame:
        return self._once("s5", lambda: official.shared_official(self.tables, self.cfg, self.pm, self.totals), shared=True)

    def home_health_records(self) -> DataFrame:
        return self._once("s6", lambda: home_health.home_health_records(self.tables, self.cfg, self.hm))

    # --- the same with ratios and sums rounded for display ---
    def billing_outlier(self) -> DataFrame:
        return outlier.rounded(self.outlier_records())

    def rapid_escalation(self) -> DataFrame:
        return escalation.rounded(self.escalation_records())

    def workforce_impossibility(self) -> DataFrame:
        return workforce.rounded(self.workforce_records())

    def geographic_implausibility(self) -> DataFrame:
        return home_health.rounded(self.home_health_records())

    # --- flag records -> long flags ---
    def official_npi_totals(self) -> DataFrame:
        """S5d, the members of every flagged official, keyed by the official's flag."""
        totals = official.official_npi_totals(self.tables, self.cfg, self.pm, self.shared_official(), self.totals)
        return totals.withColumn("flag_id", F.concat_ws("|", F.lit("shared_official"), "off_last", "off_first"))

    def flag_records(self) -> DataFrame:
        """(signal_type, signal_index, order_value, order_key, flag_id, npi, severity,
        severity_rank, overpayment): one row per signal record. ``npi`` is NULL for a
        shared official, whose members are in ``official_npi_totals``."""
        return self._once("records", self._build_records)

    def _build_records(self) -> DataFrame:
        cfg = self.cfg
        zero, none = F.lit(0.0), F.lit(None).cast("string")
        npi, official_key = F.col("npi"), F.concat_ws("|", "off_last", "off_first")

        def part(name, df, order, key, flag_key, who, severity, overpayment):
            return df.select(
                F.lit(name).alias("signal_type"), F.lit(SIGNAL_ORDER.index(name) + 1).alias("signal_index"),
                order.cast("double").alias("order_value"), key.alias("order_key"),
                F.concat_ws("|", F.lit(name), flag_key).alias("flag_id"), who.alias("npi"),
                severity.alias("severity"), overpayment.cast("double").alias("overpayment"))

        def high_if(condition):
            return F.when(condition, F.lit("high")).otherwise(F.lit("medium"))

        makers = {
            "excluded_provider": lambda name: part(
                name, self.excluded_provider(), F.col("tier"), npi, F.concat_ws("|", F.col("tier").cast("string"), npi), npi,
                F.lit("critical"), F.col("total_paid_after_exclusion")),
            "billing_outlier": lambda name: part(
                name, self.outlier_records(), -F.col("ratio_to_median"), npi, F.concat_ws("|", npi, "taxonomy", "state"), npi,
                high_if(F.col("ratio_to_median") > cfg.outlier_high_ratio), F.greatest(zero, F.col("total_paid") - F.col("p99_paid"))),
            "rapid_escalation": lambda name: part(
                name, self.escalation_records(), -F.col("max_growth_pct"), npi, npi, npi,
                high_if(F.col("max_growth_pct") > cfg.escalation_high_pct),
                F.coalesce("total_paid_excess_growth_months", F.col("total_paid_12mo") * 0.5)),
            "workforce_impossibility": lambda name: part(
                name, self.workforce_records(), -F.col("implied_claims_per_hour"), npi, npi, npi,
                F.lit("high"), F.greatest(zero, F.col("estimated_overpayment"))),
            "shared_official": lambda name: part(
                name, self.shared_official(), -F.col("combined_total_paid"), official_key, official_key,
                none, high_if(F.col("combined_total_paid") > cfg.official_high_paid), zero),
            "geographic_implausibility": lambda name: part(
                name, self.home_health_records(), F.col("bene_to_claims_ratio"), npi, npi, npi,
                high_if(F.col("bene_to_claims_ratio") < cfg.home_health_high_ratio), zero)}
        parts = [makers[name](name) for name in self.signals]
        records = reduce(DataFrame.unionByName, parts)
        rank = F.lit(SEVERITY_RANK["low"])
        for name, value in SEVERITY_RANK.items():
            rank = F.when(F.col("severity") == name, value).otherwise(rank)
        return records.withColumn("severity_rank", rank)

    def flags_by_npi(self) -> DataFrame:
        """``flag_records`` per provider, without evidence."""
        records = self.flag_records()
        columns = [c for c in FLAG_COLUMNS if c != "evidence"]
        if "shared_official" not in self.signals:
            return records.where(F.col("npi").isNotNull()).select(*columns)
        shared = F.col("signal_type") == "shared_official"
        members = self.official_npi_totals().select("flag_id", "npi")
        fanned = records.where(shared).drop("npi").join(members, "flag_id")
        return (records.where(~shared).unionByName(fanned).where(F.col("npi").isNotNull())
                .select(*columns))

    def evidence(self) -> DataFrame:
        """(flag_id, npi, evidence): JSON with the rounded values of each flag and its
        detail lists, folded per NPI; all are bounded by what one provider can carry
        (12 months, the code list, its home-health months)."""
        makers = {"excluded_provider": self._excluded_evidence, "billing_outlier": self._outlier_evidence,
                  "rapid_escalation": self._escalation_evidence, "workforce_impossibility": self._workforce_evidence,
                  "shared_official": self._official_evidence, "geographic_implausibility": self._home_health_evidence}
        return reduce(DataFrame.unionByName, [makers[name](lambda *key, n=name: F.concat_ws("|", F.lit(n), *key)) for name in self.signals])

    @staticmethod
    def _json(df: DataFrame, flag_id, *columns) -> DataFrame:
        return df.select(flag_id.alias("flag_id"), "npi", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("evidence"))

    def _excluded_evidence(self, flag) -> DataFrame:
        self._persist(self.excluded_provider())         # this and the next: read by the flags and by their evidence
        return self._json(self.excluded_provider(), flag(F.col("tier").cast("string"), F.col("npi")), *excluded.RESULT_COLUMNS)

    def _outlier_evidence(self, flag) -> DataFrame:
        self._persist(self.outlier_records())
        s2 = self.billing_outlier()
        return self._json(s2, flag("npi", "taxonomy", "state"), *s2.columns)

    def _escalation_evidence(self, flag) -> DataFrame:
        self._persist(self.escalation_records())        # read by the flags and by their months
        s3 = self.rapid_escalation()
        months = (escalation.escalation_months(self.tables, self.cfg, self.pm, s3).groupBy("npi")
                  .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "monthly_paid"))))
                       .alias("monthly_paid_amounts")))
        return self._json(s3.join(months, "npi", "left"), flag("npi"), *s3.columns, "monthly_paid_amounts")

    def _workforce_evidence(self, flag) -> DataFrame:
        self._persist(self.workforce_records())
        s4 = self.workforce_impossibility()
        return self._json(s4, flag("npi"), *s4.columns)

    def _official_evidence(self, flag) -> DataFrame:
        members = self.official_npi_totals().select("flag_id", "npi", F.col("total_paid").alias("npi_total_paid"))
        s5 = self.shared_official().withColumn("flag_id", flag("off_last", "off_first")).join(members, "flag_id")
        return self._json(s5, F.col("flag_id"), "off_last", "off_first", "npi_count", "states", "combined_total_paid",
                          "combined_total_claims", "npi_total_paid")

    def _home_health_evidence(self, flag) -> DataFrame:
        self._persist(self.home_health_records())       # read by the flags and by their details
        s6 = self.geographic_implausibility()
        codes = (home_health.home_health_codes(self.tables, self.cfg, s6).groupBy("npi")
                 .agg(F.array_sort(F.collect_set("hcpcs_code")).alias("hcpcs_codes")))
        detail = (home_health.home_health_months(self.tables, self.cfg, self.hm, s6).groupBy("npi")
                  .agg(F.array_sort(F.collect_list(F.struct(
                      "month", "claims_count", "unique_beneficiaries", "monthly_paid", "ratio"))).alias("month_detail")))
        return self._json(s6.join(codes, "npi", "left").join(detail, "npi", "left"), flag("npi"),
                          *s6.columns, "hcpcs_codes", "month_detail")

    def flags_with_evidence(self) -> DataFrame:
        """``flags_by_npi`` with the evidence; registry duplicates give a provider equal
        flags, and each keeps one piece of evidence."""
        evidence = self.evidence().groupBy("flag_id", "npi").agg(F.min("evidence").alias("evidence"))
        return self.flags_by_npi().join(evidence, ["flag_id", "npi"], "left").select(*FLAG_COLUMNS)
