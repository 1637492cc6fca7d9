"""Provider report on the planted fixture (FIXTURES.md)."""

import json
from datetime import datetime, timezone

import pytest

from claimlens.operators.rollups import provider_totals
from claimlens.plans import report as R
from claimlens.plans.flags import SignalSet
from tests import fixtures as X


@pytest.fixture(scope="module")
def signals(spark):
    return SignalSet(X.make_tables(spark), materialize_rollups=True)


@pytest.fixture(scope="module")
def report(signals):
    return R.provider_report(signals)


def test_summary_and_counts(signals):
    s = R.report_summary(signals.pm, signals.flags_by_npi()).first()
    assert (s["total_providers_scanned"], s["total_providers_flagged"]) == (42, 12)
    expected = {"excluded_provider": 2, "billing_outlier": 1, "rapid_escalation": 1, "workforce_impossibility": 1,
                "shared_official": 1, "geographic_implausibility": 2}
    for flags in (signals.flag_records(), signals.flags_by_npi()):
        assert {r["signal_type"]: r["flag_count"] for r in R.signal_counts(flags).collect()} == expected


def test_header_time_is_utc(spark, signals):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        text = R.report_header(signals.pm, signals.flags_by_npi()).first()["generated_at"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    made = datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    assert abs((datetime.now(timezone.utc) - made).total_seconds()) < 300


def test_ranking(report):
    got = [(r["rank"], r["npi"], r["top_severity"], r["estimated_overpayment_usd"])
           for r in R.report_ranked(report).orderBy("rank").collect()]
    order = [(X.NAMESAKE, "critical", 2000.0), (X.BARRED, "critical", 1200.0), (X.OUTLIER, "high", 26379.0),
             (X.CLINIC, "high", 14080.0), (X.RISER, "high", 2400.0), (X.HOME_BAD, "high", 0.0),
             (X.HOME_MILD, "medium", 0.0)] + [(npi, "medium", 0.0) for npi in X.CHAIN]
    assert got == [(k, *row) for k, row in enumerate(order, 1)]


def test_record_fields(report):
    rec = {r["npi"]: r for r in report.collect()}
    riser = rec[X.RISER]
    assert (riser["provider_name"], riser["entity_type"], riser["enumeration_date"]) == ("Noel Brandt", "individual", "2022-03-10")
    assert (riser["total_paid_all_time"], riser["total_claims_all_time"], riser["n_signals"]) == (2640.0, 36, 1)
    evidence = json.loads(riser["signals"][0]["evidence"])
    assert evidence["max_growth_pct"] == 1900.0 and evidence["monthly_paid_amounts"]["2022-11"] == 1600.0
    clinic = rec[X.CLINIC]
    assert (clinic["provider_name"], clinic["entity_type"], clinic["taxonomy_code"]) == ("Harbor Day Clinic", "organization", "261Q00000X")
    unit = json.loads(rec[X.CHAIN[2]]["signals"][0]["evidence"])
    assert (unit["off_last"], unit["npi_count"], unit["combined_total_paid"], unit["npi_total_paid"]) == ("VANCE", 5, 1250000.0, 250000.0)
    home = json.loads(rec[X.HOME_MILD]["signals"][0]["evidence"])
    assert home["hcpcs_codes"] == ["G0299", "T1020"] and [m["ratio"] for m in home["month_detail"]] == [0.0667, 0.05]
    assert json.loads(rec[X.HOME_BAD]["signals"][0]["evidence"])["state"] is None


def test_nested_and_next_steps(report):
    nested = R.nested_report(R.report_ranked(report)).where(f"npi = '{X.BARRED}'").first()
    assert nested["rank"] == 2
    assert nested["fca_relevance"]["statute_reference"] == "31 U.S.C. § 3729(a)(1)(A)"
    assert nested["fca_relevance"]["suggested_next_steps"][0].startswith("Verify exclusion status")
    steps = R.provider_next_steps(report).where(f"npi = '{X.BARRED}'").orderBy("step_no").collect()
    assert [s["step_no"] for s in steps] == [1, 2, 3, 4]


def test_lifetime_and_enrichment(signals):
    npis = R.flagged_npis(signals.flags_by_npi())
    stats = {r["npi"]: r for r in R.provider_lifetime_stats(provider_totals(signals.pm), npis).collect()}
    assert (stats[X.HOME_MILD]["total_claims_all_time"], stats[X.HOME_MILD]["total_unique_beneficiaries_all_time"]) == (800, 45)
    enr = {r["npi"]: r for r in R.provider_enrichment(signals.tables.registry, npis).collect()}
    assert enr[X.NAMESAKE]["last_name"] == " Okafor"


def test_slim_flags_carry_no_evidence(signals):
    for df in (signals.flag_records(), signals.flags_by_npi()):
        assert "evidence" not in df.columns
        assert "to_json" not in df._jdf.queryExecution().optimizedPlan().toString()
