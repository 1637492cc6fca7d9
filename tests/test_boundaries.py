"""Boundary cases and genuine negatives for every signal ."""

from decimal import Decimal

import pytest

from claimlens.operators import escalation, excluded, home_health, official, outlier, workforce
from claimlens.plans import report as R
from claimlens.plans.flags import SignalSet
from claimlens.sources.tables import ClaimsTables
from tests.fixtures import make_tables


def reg(npi, entity="1", org=None, last="L", first="F", state="CA", tax="207Q00000X",
        enum="01/15/2019", off_last=None, off_first=None):
    return (npi, entity, org, last, first, state, "00000", tax, enum, off_last, off_first)


def claim(npi, month, claims=10, paid=100, benes=5, code="99213", serv=None):
    return (npi, serv or npi, month, code, claims, Decimal(paid).quantize(Decimal("0.01")), benes)


def npis(df):
    return sorted(r["npi"] for r in df.collect())


def test_exclusion_window_edges(spark):
    # excluded 2020-03 (month included), reinstated 2020-06 (month excluded)
    spending = [claim("1000000001", m, paid=10, serv="1000000005") for m in
                ["2020-02", "2020-03", "2020-04", "2020-05", "2020-06", "2020-07"]]
    # servicing-only role match
    spending.append(claim("1000000002", "2021-01", paid=7, serv="1000000003"))
    excl = [("A", "B", None, "1000000001", "t", "20200315", "20200601", "CA", "x"),
            ("C", "D", None, "1000000003", "t", "20200101", None, "CA", "x")]
    t = make_tables(spark, spending=spending, registry=[reg("1000000001")], exclusions=excl)
    rows = {r["npi"]: r for r in excluded.excluded_provider(t).collect()}
    r = rows["1000000001"]
    assert (r["first_claim_month"], r["last_claim_month"]) == ("2020-03", "2020-05")
    assert r["total_paid_after_exclusion"] == 30.0 and r["match_role"] == "billing"
    assert rows["1000000003"]["match_role"] == "servicing"
    assert rows["1000000003"]["total_paid_after_exclusion"] == 7.0


def test_name_match_normalisation_and_blank_npi(spark):
    excl = [("  smith ", "john", None, "", "t", "20200101", None, " ny", "x")]
    registry = [reg("1000000001", last="SMITH", first=" John ", state="NY"),
                reg("1000000002", last="SMITH", first="JOHN", state=None)]   # NULL state never matches
    spending = [claim("1000000001", "2021-01"), claim("1000000002", "2021-01")]
    t = make_tables(spark, spending=spending, registry=registry, exclusions=excl)
    assert npis(excluded.excluded_provider(t)) == ["1000000001"]


def _peers(n, extra):
    registry = [reg(f"20000000{i:02d}") for i in range(n)] + [reg("1000000001")]
    spending = [claim(f"20000000{i:02d}", "2024-01", paid=100) for i in range(n)]
    spending.append(claim("1000000001", "2024-01", paid=extra))
    return registry, spending


def test_peer_group_needs_ten(spark):
    registry, spending = _peers(8, 10_000)        # 9 providers: no group
    t = make_tables(spark, spending=spending, registry=registry)
    assert outlier.peer_group_stats(t).count() == 0
    registry, spending = _peers(9, 10_000)        # exactly 10
    t = make_tables(spark, spending=spending, registry=registry)
    assert outlier.peer_group_stats(t).collect()[0]["peer_count"] == 10
    assert npis(outlier.billing_outlier(t)) == ["1000000001"]


def test_zero_median_gives_ratio_zero(spark):
    registry, spending = _peers(10, 50)
    spending = [claim(s[0], s[2], paid=0) if s[0] != "1000000001" else s for s in spending]
    t = make_tables(spark, spending=spending, registry=registry)
    rows = outlier.billing_outlier(t).collect()
    assert [r["npi"] for r in rows] == ["1000000001"] and rows[0]["ratio_to_median"] == 0.0


def test_workforce_threshold(spark):
    registry = [reg("1000000001", entity="2", org="A"), reg("1000000002", entity="2", org="B"),
                reg("1000000003", entity="1")]
    spending = [claim("1000000001", "2024-01", claims=1056, paid=1056),   # 6.0/h: not > 6
                claim("1000000002", "2024-01", claims=1057, paid=1057),   # just above
                claim("1000000003", "2024-01", claims=5000, paid=5000)]   # individual: ignored
    t = make_tables(spark, spending=spending, registry=registry)
    rows = workforce.workforce_impossibility(t).collect()
    assert [r["npi"] for r in rows] == ["1000000002"]
    assert rows[0]["estimated_overpayment"] == pytest.approx(1.0)


def test_workforce_duplicate_registry_rows_fan_out(spark):
    # the join-then-aggregate semantics double the sums of a duplicated org
    registry = [reg("1000000001", entity="2", org="A"), reg("1000000001", entity="2", org="A")]
    t = make_tables(spark, spending=[claim("1000000001", "2024-01", claims=600, paid=600)],
                    registry=registry)
    r = workforce.workforce_impossibility(t).collect()[0]
    assert (r["max_monthly_claims"], r["impossible_months_count"]) == (1200, 1)


def test_official_thresholds(spark):
    def group(off, n, paid_each):
        rows = [reg(f"1{off}{i:08d}", entity="2", org=f"O{i}", off_last=off, off_first="X")
                for i in range(n)]
        return rows, [claim(r[0], "2024-01", paid=paid_each) for r in rows]
    r4, s4 = group("1", 4, 1_000_000)          # 4 NPIs: too few
    r5, s5 = group("2", 5, 200_000)            # exactly $1,000,000: not above
    r6, s6 = group("3", 5, 200_001)            # above
    t = make_tables(spark, spending=s4 + s5 + s6, registry=r4 + r5 + r6)
    assert sorted(g["off_last"] for g in official.official_groups(t).collect()) == ["2", "3"]
    assert [r["off_last"] for r in official.shared_official(t).collect()] == ["3"]


def test_home_health_edges(spark):
    spending = [claim("1000000001", "2024-01", claims=100, benes=1, code="T1019"),   # 100: not > 100
                claim("1000000002", "2024-01", claims=200, benes=20, code="G0151"),  # ratio 0.1: not < 0.1
                claim("1000000003", "2024-01", claims=200, benes=19, code="S9124"),  # flagged
                claim("1000000004", "2024-01", claims=500, benes=1, code="G0163")]   # outside ranges
    t = make_tables(spark, spending=spending, registry=[reg("1000000003", state="")])
    rows = home_health.geographic_implausibility(t).collect()
    assert [r["npi"] for r in rows] == ["1000000003"] and rows[0]["state"] is None


def test_escalation_edges(spark):
    paid = [100, 100, 100, 100, 100, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 10**6]
    months = [f"2020-{m:02d}" for m in range(1, 13)] + ["2021-01"]
    spending = [claim("1000000001", m, paid=p) for m, p in zip(months, paid)]
    spending += [claim("1000000002", m, paid=p) for m, p in zip(months, paid)]
    spending += [claim("1000000003", m, paid=p) for m, p in zip(months, paid)]
    registry = [reg("1000000001", enum="1/5/2018"),      # unpadded; exactly 24 months before: eligible
                reg("1000000002", enum="12/31/2017"),    # 25 months before: not eligible
                reg("1000000003", enum="not a date")]    # unparsable
    t = make_tables(spark, spending=spending, registry=registry)
    rows = escalation.rapid_escalation(t).collect()
    assert [r["npi"] for r in rows] == ["1000000001"]
    # month 13 (1,000,000) is outside the first 12 billed months
    assert rows[0]["peak_monthly_paid"] == 1000.0


def test_no_flags_for_ordinary_providers(spark):
    t = make_tables(spark)
    flagged = {r["npi"] for r in R.flagged_npis(SignalSet(t).flags_by_npi()).collect()}
    assert flagged and not any(n.startswith("31") for n in flagged)


@pytest.mark.parametrize("benes, severity", [(49980, "high"), (49990, "high"), (49999, "high"), (50000, "medium")])
def test_severity_is_decided_before_rounding(spark, benes, severity):
    # 0.04998, 0.04999 and 0.049999 all round to 0.05
    spending = [claim("1000000001", "2024-01", claims=1_000_000, benes=benes, code="T1019")]
    t = make_tables(spark, spending=spending, registry=[reg("1000000001")])
    (r,) = SignalSet(t).flags_by_npi().collect()
    assert (r["signal_type"], r["severity"]) == ("geographic_implausibility", severity)


def test_ratio_and_growth_just_above_the_limits_are_high(spark):
    registry, spending = _peers(10, 0)
    spending[-1] = claim("1000000001", "2024-01", paid=Decimal("500.01"))    # 5.0001 times the median of 100
    t = make_tables(spark, spending=spending, registry=registry)
    (r,) = SignalSet(t).flags_by_npi().collect()
    assert (r["signal_type"], r["severity"]) == ("billing_outlier", "high")
    months = [f"2020-{m:02d}" for m in range(1, 8)]
    paid = [1000] * 6 + [Decimal("16000.01")]      # growth of 500.000033 %
    t = make_tables(spark, spending=[claim("1000000001", m, paid=p) for m, p in zip(months, paid)],
                    registry=[reg("1000000001", enum="12/01/2019")])
    (r,) = SignalSet(t).flags_by_npi().collect()
    assert (r["signal_type"], r["severity"]) == ("rapid_escalation", "high")


def null_claim(npi, month, claims=10, paid=None, benes=None, code="99213"):
    return (npi, npi, month, code, claims, None if paid is None else Decimal(paid), benes)


def test_null_npi_is_no_provider(spark):
    spending = [claim("1000000001", "2024-01"), null_claim(None, "2024-01", claims=500, benes=1, code="T1019")]
    t = make_tables(spark, spending=spending, registry=[reg("1000000001")])
    ss = SignalSet(t, materialize_rollups=True)
    assert R.providers_scanned(ss.pm).first()[0] == 1
    assert ss.flag_records().count() == 1 and ss.flags_by_npi().count() == 0
    assert R.provider_report(ss).count() == 0


def test_peers_are_counted_as_rows_not_as_amounts(spark):
    registry, spending = _peers(9, 10_000)
    spending[0] = null_claim(spending[0][0], "2024-01")
    t = make_tables(spark, spending=spending, registry=registry)
    (r,) = outlier.peer_group_stats(t).collect()
    assert r["peer_count"] == 10 and r["median_paid"] == 100.0
    assert npis(outlier.billing_outlier(t)) == ["1000000001"]


def test_null_amounts_show_as_zero(spark):
    spending = [null_claim("1000000001", "2024-01", claims=200, benes=1, code="T1019"),
                null_claim("1000000002", "2024-01", claims=2000), null_claim("1000000003", "2024-01", claims=None, paid=7)]
    excl = [("A", "B", None, "1000000003", "t", "20200101", None, "CA", "x")]
    t = make_tables(spark, spending=spending, registry=[reg("1000000001"), reg("1000000002", entity="2", org="X")], exclusions=excl)
    (h,) = home_health.geographic_implausibility(t).collect()
    assert (h["total_paid"], h["total_beneficiaries"]) == (0.0, 1)
    (m,) = home_health.home_health_months(t).collect()
    assert (m["monthly_paid"], m["unique_beneficiaries"]) == (0.0, 1)
    (w,) = workforce.workforce_impossibility(t).collect()
    assert (w["total_paid_peak_month"], w["total_paid_impossible"], w["estimated_overpayment"]) == (0.0, 0.0, 0.0)
    (e,) = excluded.excluded_provider(t).collect()
    assert (e["total_claims_after_exclusion"], e["total_paid_after_exclusion"]) == (0, 14.0)


def test_null_month_ranks_last(spark):
    months = [f"2020-{m:02d}" for m in range(1, 9)]
    paid = [10, 10, 10, 10, 10, 100, 100, 100]
    spending = [claim("1000000001", m, paid=p) for m, p in zip(months, paid)] + [claim("1000000001", None, paid=10 ** 6)]
    t = make_tables(spark, spending=spending, registry=[reg("1000000001", enum="12/01/2019")])
    g = escalation.escalation_growth(t).orderBy("month_rank").collect()
    assert [r["month"] for r in g] == months + [None]
    assert {r["first_billing_month"] for r in g} == {"2020-01"}
    assert [r["monthly_paid"] for r in escalation.escalation_months(t).orderBy("month").collect()][0] == 10.0 ** 6


def test_amounts_are_whole_cents_per_row(spark, tmp_path):
    """The recorded deviation: rows are money, so each is rounded to cents when read."""
    from claimlens.sources.tables import read_spending
    path = str(tmp_path / "s.parquet")
    rows = [("1", "1", "2024-01", "x", 1, 0.014, 1), ("1", "1", "2024-01", "x", 1, 0.016, 1)]
    spark.createDataFrame(rows, "BILLING_PROVIDER_NPI_NUM string, SERVICING_PROVIDER_NPI_NUM string, CLAIM_FROM_MONTH string, "
                          "HCPCS_CODE string, TOTAL_CLAIMS long, TOTAL_PAID double, TOTAL_UNIQUE_BENEFICIARIES long").write.parquet(path)
    assert float(read_spending(spark, path).agg({"TOTAL_PAID": "sum"}).first()[0]) == 0.03


def test_missing_registry_row_in_report(spark):
    excl = [("A", "B", None, "1000000001", "t", "20200101", None, "CA", "x")]
    t = make_tables(spark, spending=[claim("1000000001", "2021-01", paid=5, serv="1000000002")],
                    registry=[reg("1000000009")],
                    exclusions=excl)
    rep = R.provider_report(SignalSet(t, materialize_rollups=True)).collect()
    assert len(rep) == 1
    r = rep[0]
    assert (r["provider_name"], r["entity_type"], r["taxonomy_code"], r["state"]) == (
        "UNKNOWN", "unknown", "", "")
    assert r["enumeration_date"] is None and r["estimated_overpayment_usd"] == 5.0
