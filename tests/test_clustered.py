"""Claims laid out by provider: equal results, fewer rows read."""

import pytest
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.operators import excluded
from claimlens.plans.drilldown import flagged_claims
from claimlens.plans.flags import SignalSet
from claimlens.sources import clustered
from claimlens.sources.tables import ClaimsTables
from tests.fixtures import make_tables

PROVIDERS, HOT = 3000, "1000000077"
#: small row groups and pages, so that a small table has many
SMALL = {"parquet.block.size": str(64 << 10), "parquet.page.row.count.limit": "500", "parquet.enable.dictionary": "false"}


def npi(k):
    return F.concat(F.lit("1"), F.lpad(k.cast("string"), 9, "0"))


@pytest.fixture(scope="module")
def claims(spark, tmp_path_factory):
    """60,000 rows over every second of 6,000 NPIs, a third of them of one; servicing NPIs are spread."""
    k = F.col("id")
    plain = spark.range(60_000).select(
        F.when(k % 3 == 0, F.lit(HOT)).when(k % 101 == 1, F.lit(None)).otherwise(npi(F.pmod(F.hash(k), F.lit(PROVIDERS)) * 2)).alias(S.BILLING_NPI),
        F.when(k % 5 == 0, F.lit(None)).otherwise(npi(F.lit(500_000) + k % 30_000 * 2)).alias(S.SERVICING_NPI),
        F.concat(F.lit("2023-0"), (k % 9 + 1).cast("string")).alias(S.CLAIM_MONTH), F.lit("99213").alias(S.HCPCS),
        k.alias(S.TOTAL_CLAIMS), (k % 100).cast(S.MONEY).alias(S.TOTAL_PAID), F.lit(1).cast("bigint").alias(S.TOTAL_BENES))
    path = str(tmp_path_factory.mktemp("layout") / "claims")
    clustered.write_clustered(plain, path, files=6, options=SMALL)
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(clustered.KEYS))
    return plain, clustered.read_clustered(spark, path)


def rows_read(df):
    """Rows that the first scan of ``df`` handed on."""
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def ids(df):
    return sorted(r[0] for r in df.select(S.TOTAL_CLAIMS).collect())


def keys_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "npi string")


def semi(plain, keys, column):
    return plain.join(keys.select(F.col("npi").alias("_k")).where("_k IS NOT NULL").distinct(), F.col(column) == F.col("_k"), "left_semi")


@pytest.mark.parametrize("column", [S.BILLING_NPI, S.SERVICING_NPI])
@pytest.mark.parametrize("values", [
    [], [None], ["1000000006"], ["1000000006", "1000000006", None, "1000000004"], ["9999999999"],
    [HOT], [f"1{k:09d}" for k in range(0, 6000, 60)], [f"1{k:09d}" for k in range(500_000, 560_000, 50)]])
@pytest.mark.parametrize("most", [3, clustered.KEYS])
def test_same_rows_as_a_semi_join(spark, claims, column, values, most):
    plain, layout = claims
    keys = keys_of(spark, values)
    assert ids(clustered.rows_of(layout, keys, column, most=most, ranges=8)) == ids(semi(plain, keys, column))


def test_thousand_keys_pushed_one_by_one(spark, claims):
    plain, layout = claims
    keys = keys_of(spark, [f"1{k:09d}" for k in range(0, 2 * clustered.KEYS, 2)])
    got = clustered.rows_of(layout, keys)
    assert ids(got) == ids(semi(plain, keys, S.BILLING_NPI))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_few_rows(spark, claims):
    plain, layout = claims
    total = plain.count()
    few = keys_of(spark, ["1000000200", "1000004000"])
    assert rows_read(layout) == total
    # a semi-join reads all; pages of other NPIs are not read with the keys pushed down
    assert 0 < rows_read(clustered.rows_of(layout, few)) < total / 10
    # between the least and the greatest NPI of its row group, but not there
    assert rows_read(clustered.rows_of(layout, keys_of(spark, ["1000000201"]))) < total / 50
    # ranges of many keys that lie together
    many = keys_of(spark, [f"1{k:09d}" for k in range(2000, 2400)])
    ranged = clustered.rows_of(layout, many, most=3, ranges=8)
    assert "PushedFilters: [Or(" in ranged._jdf.queryExecution().executedPlan().toString()


def test_bloom_filter_serves_the_spread_role(spark, claims):
    """An absent servicing NPI lies inside every row group's range: only Bloom filters tell."""
    _, layout = claims
    absent = keys_of(spark, ["1000530001"])
    spark.conf.set("parquet.filter.bloom.enabled", "false")
    without = rows_read(clustered.rows_of(layout, absent, S.SERVICING_NPI))
    spark.conf.unset("parquet.filter.bloom.enabled")
    with_bloom = rows_read(clustered.rows_of(layout, absent, S.SERVICING_NPI))
    assert with_bloom < without / 4


def test_hot_provider_spans_files(claims):
    _, layout = claims
    files = layout.where(F.col(S.BILLING_NPI) == HOT).select(F.input_file_name()).distinct().count()
    assert files >= 2


def test_excluded_provider_from_the_layout(spark, tmp_path):
    t = make_tables(spark)
    clustered.write_clustered(t.spending, str(tmp_path / "c"), files=3)
    laid = ClaimsTables(clustered.read_clustered(spark, str(tmp_path / "c")), t.registry, t.exclusions)
    want = sorted(map(tuple, excluded.excluded_provider(t).collect()), key=str)
    assert want and sorted(map(tuple, excluded.excluded_provider(laid, narrow=True).collect()), key=str) == want
    assert sorted(map(tuple, SignalSet(laid, clustered=True, signals=["excluded_provider"]).excluded_provider().collect()), key=str) == want


def test_flagged_claims_of_some_signals(spark):
    t = make_tables(spark)
    flags = spark.createDataFrame([("excluded_provider", "4000000006"), ("billing_outlier", "4000000001"), ("shared_official", None)],
                                  "signal_type string, npi string")
    who = lambda df: {r[0] for r in df.select(S.BILLING_NPI).collect()}
    assert who(flagged_claims(t.spending, flags)) == {"4000000001", "4000000006"}
    assert who(flagged_claims(t.spending, flags, ["excluded_provider"])) == {"4000000006"}
    assert flagged_claims(t.spending, flags, []).count() == 0
