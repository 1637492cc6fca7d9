"""Scale properties of the physical plans (checked on tiny inputs)."""

import io
import os
from contextlib import redirect_stdout

import pytest

from claimlens.config import DEFAULT_CONFIG
from claimlens.operators import excluded
from claimlens.operators.rollups import home_health_month
from claimlens.plans import report as R
from claimlens.plans.catalog import QUERIES
from claimlens.plans.flags import SignalSet
from claimlens.sources.tables import read_spending
from tests.fixtures import make_tables

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(df) -> str:
    return plan_text(df).split("\n\n")[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins(spark, name):
    t = tree(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in t and "CartesianProduct" not in t


def test_excluded_joins_monthly_sums_only(spark):
    t = tree(excluded.excluded_provider(make_tables(spark)))
    assert "Generate" not in t
    # below every join with the exclusion keys stands an aggregate of the claims
    text = excluded.excluded_provider(make_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in text and text.count("Aggregate") >= 3


def test_bucketed_report_shuffles_no_rollup(spark):
    ss = SignalSet(make_tables(spark), materialize_rollups=True)
    t = tree(R.provider_report(ss))
    assert t.count("Exchange (") - t.count("BroadcastExchange (") == 0, t


@pytest.mark.parametrize("name", ["billing_outlier", "home_health_codes", "home_health_months"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_claims_are_scanned_once(spark, name, monkeypatch):
    from claimlens.functions import lineage
    from claimlens.operators import home_health, outlier
    plans = []

    def seen(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return lineage.materialize(df, *args, **kwargs)

    for module in (home_health, outlier):
        monkeypatch.setattr(module, "materialize", seen)
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("l_extendedprice") > 0 for p in plans) == 1


def test_code_ranges_pushed_to_scan(spark, tmp_path):
    path = str(tmp_path / "spending.parquet")
    make_tables(spark).spending.write.parquet(path)
    text = plan_text(home_health_month(read_spending(spark, path), DEFAULT_CONFIG))
    pushed = [ln for ln in text.splitlines() if ln.startswith("PushedFilters")]
    assert pushed and "HCPCS_CODE,G0151" in pushed[0] and "HCPCS_CODE,T1022" in pushed[0]
    schema = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")][0]
    assert "SERVICING_PROVIDER_NPI_NUM" not in schema          # column pruning
    assert text.count("HashAggregate (") >= 2                  # partial + final around one exchange
