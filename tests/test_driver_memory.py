"""What is sent to all tasks is built in the driver's heap, so it must not grow with the providers."""

import re

import pytest
from pyspark.sql import functions as F

from claimlens.functions.lineage import materialize
from claimlens.operators import excluded, outlier
from claimlens.operators.rollups import provider_month
from claimlens.plans.session import apply_session_conf
from claimlens.sources.tables import ClaimsTables
from tests.fixtures import make_tables
from tests.test_scale_steps import rows

THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
N = 300_000


@pytest.fixture
def providers(spark):
    """(npi, state, first_month) of N providers, a few bytes each as stored."""
    apply_session_conf(spark)
    npi = (F.col("id") + 1_000_000_000).cast("string").alias("npi")
    return spark.range(N).select(npi, F.concat(F.lit("S"), F.col("id") % 5).alias("state"), F.lit("1998-01").alias("first_month"))


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_providers_are_not_sent_to_all_tasks(spark, providers):
    """A registry and its totals, small on disk, meet as the bucketed tables they are."""
    registry, totals = (materialize(providers, name, bucket_by="npi", buckets=8, sort_by=("npi",)) for name in ("registry", "totals"))
    met = registry.select("npi", "state").join(totals.select("npi", "first_month"), "npi")
    assert "Broadcast" not in planned(met) and "Exchange" not in planned(met)
    assert met.count() == N


def test_shuffled_providers_are_not_sent_either(spark, providers):
    sums = [providers.groupBy("npi").agg(F.max(c).alias(c)) for c in ("state", "first_month")]
    met = sums[0].join(sums[1], "npi").agg(F.count("state"), F.count("first_month"))
    assert met.collect() == [(N, N)]
    assert "isFinalPlan=true" in planned(met) and "BroadcastHashJoin" not in planned(met)


def test_peer_groups_are_sent_and_not_the_providers(spark, providers):
    registry = providers.where(F.col("npi") < "1000020000").withColumn("taxonomy", F.lit("T"))
    paid = (F.col("npi").cast("long") % 997 * 100).alias("paid")
    totals = registry.select("npi", paid, F.lit(1).cast("long").alias("claims"))
    found = outlier.outlier_records(ClaimsTables(None, registry, None), totals=totals)
    sides = re.findall(r"HashJoin \[taxonomy#\d+, state#\d+\].*?(Build\w+)", planned(found))
    assert sides == ["BuildRight"]
    assert 0 < found.count() < 20_000 * 0.011


def test_exclusion_keys_meet_monthly_sums_unshuffled(spark, monkeypatch):
    """Up to SENT_KEYS of them are sent to the monthly sums because they are to be, not for their
    size; more are not."""
    t = make_tables(spark)
    before = {k: spark.conf.get(k) for k in THRESHOLDS}

    def joins(plan: str) -> list[str]:
        return re.findall(r"(\w+Join) \[npi#\d+\], \[npi#\d+\], Inner", plan)

    try:
        for k in before:
            spark.conf.set(k, -1)
        pm = materialize(provider_month(t.spending), "provider_month", bucket_by="npi", buckets=8)
        tier = (excluded.TIER_NPI,)
        sent = excluded.excluded_provider(t, tiers=tier, pm=pm)
        assert joins(planned(sent)) == ["BroadcastHashJoin"]
        want = rows(sent)
        monkeypatch.setattr(excluded, "SENT_KEYS", 0)
        kept = excluded.excluded_provider(t, tiers=tier, pm=pm)
        assert joins(planned(kept)) == ["SortMergeJoin"]
        assert rows(kept) == want != []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
