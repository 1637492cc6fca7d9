"""Six signals on the planted fixture, with values worked out in FIXTURES.md."""

import dataclasses
from decimal import Decimal

import pytest

from claimlens import schemas as S
from claimlens.config import DEFAULT_CONFIG
from claimlens.operators import escalation, excluded, home_health, official, outlier, workforce
from tests import fixtures as X


@pytest.fixture(scope="module")
def tables(spark):
    return X.make_tables(spark)


def by_npi(df):
    return {r["npi"]: r.asDict() for r in df.collect()}


def test_fixture_shape(tables):
    assert (tables.spending.count(), tables.registry.count(), tables.exclusions.count()) == (118, 43, 3)


def test_exclusion_by_npi_sums_both_roles(tables):
    rows = by_npi(excluded.excluded_provider(tables, tiers=(excluded.TIER_NPI,)))
    assert rows == {X.BARRED: {
        "tier": 1, "npi": X.BARRED, "excl_date": "20210401", "excl_type": "1128b7", "match_role": "billing+servicing",
        "total_paid_after_exclusion": 1200.0, "total_claims_after_exclusion": 40,
        "first_claim_month": "2021-04", "last_claim_month": "2021-05"}}


def test_exclusion_can_count_rows_once(tables):
    cfg = dataclasses.replace(DEFAULT_CONFIG, count_rows_once=True)
    r = by_npi(excluded.excluded_provider(tables, cfg))[X.BARRED]
    assert (r["total_paid_after_exclusion"], r["total_claims_after_exclusion"], r["match_role"]) == (600.0, 20, "billing")


MONTHS = ["2020-01", "2020-06", "2020-12", "2021-06", "2022-06"]


@pytest.mark.parametrize(("periods", "months", "first"), [
    ([("20200101", None), ("20200301", None)], 5, "20200101"),                          # both open
    ([("20200101", "20200701"), ("20200601", "20210101")], 3, "20200101"),              # overlap
    ([("20200101", "20200701"), ("20200701", "20210101")], 3, "20200101"),              # touch
    ([("20200501", "20201101"), ("20200601", "20200801"), ("20210501", None)], 3, "20200501"),   # one within, one apart
    ([("20200101", "20200101"), ("20200601", "20200701")], 1, "20200601"),              # the first excludes nobody
    ([("20200601", "20190101"), ("20200701", "20200601")], 0, None)])
def test_a_row_under_several_exclusions_counts_once(spark, tables, periods, months, first):
    npi = "7000000001"
    claims = spark.createDataFrame([(npi, npi, m, "99213", 1, Decimal("100.00"), 1) for m in MONTHS], S.SPENDING_SCHEMA)
    records = [("A", "B", "", npi, "1128a1", begin, end, "CA", "") for begin, end in periods]
    t = dataclasses.replace(tables, spending=claims, exclusions=spark.createDataFrame(records, S.EXCLUSION_SCHEMA))
    cfg = dataclasses.replace(DEFAULT_CONFIG, count_rows_once=True)
    rows = excluded.excluded_provider(t, cfg).collect()
    assert [(r["total_paid_after_exclusion"], r["total_claims_after_exclusion"], r["excl_date"]) for r in rows] == (
        [(100.0 * months, months, first)] if months else [])


def test_exclusion_by_name_ends_with_reinstatement(tables):
    rows = by_npi(excluded.excluded_provider(tables, tiers=(excluded.TIER_NAME,)))
    assert set(rows) == {X.NAMESAKE}
    r = rows[X.NAMESAKE]
    assert (r["match_role"], r["total_paid_after_exclusion"], r["total_claims_after_exclusion"]) == ("name_match", 2000.0, 20)
    assert (r["first_claim_month"], r["last_claim_month"]) == ("2022-01", "2022-02")


def test_exclusions_touch_nobody_else(tables):
    assert set(by_npi(excluded.excluded_provider(tables))) == {X.BARRED, X.NAMESAKE}


@pytest.mark.parametrize("method", ["exact", "builtin"])
def test_peer_group(tables, method):
    cfg = dataclasses.replace(DEFAULT_CONFIG, quantile_method=method)
    (r,) = outlier.peer_group_stats(tables, cfg).collect()
    assert (r["taxonomy"], r["state"], r["peer_count"], r["median_paid"]) == ("363L00000X", "OR", 31, 1650.0)
    assert r["p99_paid"] == pytest.approx(63621.0)


def test_outlier(tables):
    rows = by_npi(outlier.billing_outlier(tables))
    assert set(rows) == {X.OUTLIER}
    r = rows[X.OUTLIER]
    assert (r["total_paid"], r["total_claims"], r["p99_paid"], r["ratio_to_median"]) == (90000.0, 2100, 63621.0, 54.5455)
    raw = by_npi(outlier.outlier_records(tables))[X.OUTLIER]
    assert raw["ratio_to_median"] == pytest.approx(90000 / 1650, rel=1e-12)


def test_outlier_by_sketch(tables):
    cfg = dataclasses.replace(DEFAULT_CONFIG, quantile_method="approx")
    (r,) = outlier.peer_group_stats(tables, cfg).collect()
    assert r["p99_paid"] == 90000.0     # the sketch takes a value, it does not interpolate
    assert outlier.billing_outlier(tables, cfg).count() == 0


def test_escalation(tables):
    rows = by_npi(escalation.rapid_escalation(tables))
    assert rows == {X.RISER: {
        "npi": X.RISER, "max_growth_pct": 1900.0, "peak_monthly_paid": 1600.0, "first_month": "2022-04",
        "last_month": "2022-12", "enum_date": "03/10/2022", "total_paid_12mo": 2640.0,
        "total_paid_excess_growth_months": 2400.0, "first_billing_month": "2022-04"}}


def test_escalation_growth_by_month(tables):
    g = escalation.escalation_growth(tables).where(f"npi = '{X.RISER}'").orderBy("month_rank").collect()
    assert [r["growth_pct"] for r in g] == pytest.approx([0, 0, 0, 0, 0, 0, 300, 1600, 1900])


def test_escalation_months(tables):
    rows = escalation.escalation_months(tables).orderBy("month").collect()
    assert [r["monthly_paid"] for r in rows] == [float(x) for x in X.RISER_MONTHLY]


def test_workforce(tables):
    rows = by_npi(workforce.workforce_impossibility(tables))
    assert rows == {X.CLINIC: {
        "npi": X.CLINIC, "max_monthly_claims": 1760, "peak_month": "2023-01", "implied_claims_per_hour": 10.0,
        "total_paid_peak_month": 35200.0, "impossible_months_count": 1, "total_claims_impossible": 1760,
        "total_paid_impossible": 35200.0, "estimated_overpayment": 14080.0}}


def test_shared_official(tables):
    (r,) = official.shared_official(tables).collect()
    assert r.asDict() == {"off_last": "VANCE", "off_first": "RUTH", "npi_count": 5, "states": ["ID", "NV", "UT"],
                          "combined_total_paid": 1250000.0, "combined_total_claims": 4500}
    assert [g["off_last"] for g in official.official_groups(tables).collect()] == ["VANCE"]     # ABEL runs one company
    members = official.official_npi_totals(tables).collect()
    assert sorted((m["npi"], m["total_paid"]) for m in members) == [(npi, 250000.0) for npi in X.CHAIN]


def test_home_health(tables):
    rows = by_npi(home_health.geographic_implausibility(tables))
    assert {n: (r["total_claims"], r["total_beneficiaries"], r["bene_to_claims_ratio"], r["months_flagged"], r["state"])
            for n, r in rows.items()} == {X.HOME_MILD: (800, 45, 0.0563, 2, "VT"), X.HOME_BAD: (250, 10, 0.04, 1, None)}
    codes = home_health.home_health_codes(tables).collect()
    assert sorted((c["npi"], c["hcpcs_code"]) for c in codes) == [
        (X.HOME_MILD, "G0299"), (X.HOME_MILD, "T1020"), (X.HOME_BAD, "S9123")]
    months = home_health.home_health_months(tables).collect()
    assert sorted((m["npi"], m["month"], m["ratio"]) for m in months) == [
        (X.HOME_MILD, "2023-08", 0.0667), (X.HOME_MILD, "2023-09", 0.05), (X.HOME_BAD, "2023-08", 0.04)]
