"""Steps that every flag and report query shares, at size: what they read, join and sort."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.config import DEFAULT_CONFIG
from claimlens.functions.columns import whole
from claimlens.operators import excluded, home_health
from claimlens.operators.rollups import home_health_month, provider_month, provider_totals
from claimlens.plans import report as R
from claimlens.plans.flags import SignalSet
from claimlens.sources.star import money_from_cents, npi_from_key, tables_from_star
from tests.fixtures import make_tables


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def signals(spark):
    return SignalSet(make_tables(spark), materialize_rollups=True)


def test_monthly_rollups_are_read_from_the_stored_table(spark, signals):
    for df in (signals.pm, signals.hm, signals.totals):
        plan = optimized(df)
        assert "Relation" in plan and "Aggregate" not in plan and "InMemory" not in plan
    t = make_tables(spark)
    assert rows(signals.pm) == rows(provider_month(t.spending))
    assert rows(signals.hm) == rows(home_health_month(t.spending, DEFAULT_CONFIG))
    assert rows(signals.totals) == rows(provider_totals(provider_month(t.spending)))


def test_joins_of_stored_tables_sort_nothing(spark, signals):
    joined = signals.pm.hint("merge").join(signals.tables.registry, "npi")
    tree = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in tree and "Exchange" not in tree and "Sort [" not in tree


def test_claims_of_exclusion_keys_alone_are_summed(spark, signals):
    t = make_tables(spark)
    found = excluded.excluded_provider(t)
    assert optimized(found).count("LeftSemi") == 2       # billing and servicing claims
    assert optimized(signals.excluded_provider()).count("LeftSemi") == 1
    want = rows(found)
    assert want and rows(signals.excluded_provider()) == want


def test_exclusion_keys_are_looked_up_before_claims_meet_orders(spark):
    """Of claims that are built by a join, those of excluded NPIs alone are shuffled; every task holds the keys."""
    t = tables_from_star(spark, "/root/testdata/sf0.001")
    npis = excluded.exclusion_keys(t).select("npi").distinct()
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in before:
            spark.conf.set(k, -1)       # the keys are sent because they are to be, not for their size
        found = excluded.role_months(t, pm=provider_month(t.spending), npis=npis).where("role = 'servicing'")
        lines = optimized(found).split("\n")
        at = {kind: next(line.index("Join") for line in lines if f"Join {kind}" in line) for kind in ("Inner", "LeftSemi")}
        assert at["LeftSemi"] > at["Inner"]
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        want = excluded.servicing_month(t.spending).join(npis, "npi", "left_semi").select(F.lit("servicing").alias("role"), "npi", "month", "paid", "claims")
        assert rows(found) == rows(want) != []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_exclusion_keys_are_not_sent(spark, monkeypatch):
    t = make_tables(spark)
    want = rows(excluded.excluded_provider(t))
    monkeypatch.setattr(excluded, "SENT_KEYS", 0)
    found = excluded.excluded_provider(t)
    assert "LeftSemi" not in optimized(found) and rows(found) == want


def test_escalation_sorts_months_of_eligible_providers_alone(spark, signals):
    t = make_tables(spark)
    plan = optimized(signals.escalation_records())
    below = plan[plan.rindex("Window"):]
    assert "first_month" in below       # a provider's first month is tested below the windows
    assert rows(signals.escalation_records()) == rows(SignalSet(t).escalation_records())


def test_codes_of_flagged_providers(spark, signals):
    t = make_tables(spark)
    s6 = signals.geographic_implausibility()
    assert rows(home_health.home_health_codes(signals.tables, DEFAULT_CONFIG, s6)) == rows(home_health.home_health_codes(t))


def test_report_is_stored_before_it_is_sorted(spark, signals, monkeypatch):
    seen = []
    rank = R.global_rank
    monkeypatch.setattr(R, "global_rank", lambda df, *a: seen.append(optimized(df)) or rank(df, *a))
    ranked = R.report_ranked(R.provider_report(signals))
    assert len(seen) == 1 and "Join" not in seen[0] and "Relation" in seen[0]
    places = [r["rank"] for r in ranked.select("rank").collect()]
    assert sorted(places) == list(range(1, len(places) + 1)) and places


def test_whole_rounds_as_round_does(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 2.0 ** 52 - 0.5, 1e15 + 0.5, -7.2, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~whole(F.col("v")).eqNullSafe(F.round("v").cast("bigint"))).count() == 0


def test_star_keys_and_amounts(spark):
    keys = [0, 7, 999_999_999, 1_000_000_000, 12_345_678_901, -5, None]
    old = F.concat(F.lit("1"), F.lpad(F.col("k").cast("string"), 9, "0"))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert df.where(~npi_from_key(F.col("k")).eqNullSafe(old)).count() == 0
    cents = spark.createDataFrame([(c,) for c in (0, 1, -1, 123_456_789, 10 ** 15 - 1, -10 ** 15, 10 ** 15, None)], "c bigint")
    found = cents.select("c", money_from_cents(F.col("c")).alias("m"))
    assert found.schema["m"].dataType == S.MONEY
    assert all(r["m"] == (None if r["c"] is None else Decimal(r["c"]) / 100) for r in found.collect())
