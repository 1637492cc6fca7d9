"""Stages: CSV ingest -> flags on disk -> JSON report, each from files alone."""

import csv
import dataclasses
import glob
import json
import os

import pytest

from claimlens import schemas as S
from claimlens.config import DEFAULT_CONFIG
from claimlens.functions import lineage
from claimlens.plans import pipeline
from claimlens.plans.session import ensure_checkpoint_dir
from tests import fixtures as X


def raw_inputs(spark, folder):
    spending = str(folder / "claims.parquet")
    X.make_tables(spark).spending.write.parquet(spending)
    raw = folder / "nppes_raw"
    raw.mkdir()
    for path, header, rows in ((raw / "npidata_pfile_1.csv", S.REGISTRY_LONG, X.registry_rows()),
                               (folder / "UPDATED.csv", S.EXCLUSION_COLUMNS, X.exclusion_rows())):
        with open(path, "w", newline="") as fh:
            csv.writer(fh).writerows([header, *[["" if v is None else v for v in r] for r in rows]])
    return spending, str(raw), str(folder / "UPDATED.csv"), str(folder / "out")


def read_report(out):
    parts = [[json.loads(x) for x in open(f) if x.strip()] for f in glob.glob(f"{out}/report/providers/part-*.json")]
    header = [json.loads(x) for f in glob.glob(f"{out}/report/header/part-*.json") for x in open(f) if x.strip()]
    return parts, header[0]


def check_report(out):
    parts, header = read_report(out)
    assert all([p["rank"] for p in part] == sorted(p["rank"] for p in part) for part in parts)
    lines = sorted((p for part in parts for p in part), key=lambda p: p["rank"])
    assert [p["rank"] for p in lines] == list(range(1, 13))
    assert lines[0]["npi"] == X.NAMESAKE and lines[0]["estimated_overpayment_usd"] == 2000.0
    assert (header["total_providers_scanned"], header["total_providers_flagged"]) == (42, 12)
    assert header["signal_counts"]["shared_official"] == 1 and header["signal_counts"]["geographic_implausibility"] == 2


def test_all_stages(spark, tmp_path):
    args = raw_inputs(spark, tmp_path)
    pipeline.run(spark, *args)
    check_report(args[-1])
    # the three tables are there for the user's own SQL
    assert spark.sql("SELECT count(*) FROM spending s JOIN nppes n ON s.BILLING_PROVIDER_NPI_NUM = n.npi "
                     "LEFT JOIN leie l ON l.NPI = n.npi").first()[0] == 118


def test_stages_run_in_sessions_of_their_own(spark, tmp_path):
    args = raw_inputs(spark, tmp_path)
    for stage in pipeline.STAGES:
        pipeline.run(spark.newSession(), *args, stages=(stage,))
    check_report(args[-1])
    members = spark.read.parquet(f"{args[-1]}/official_members").collect()
    assert sorted((m["flag_id"], m["npi"], m["total_paid"]) for m in members) == [
        ("shared_official|VANCE|RUTH", npi, 250000.0) for npi in X.CHAIN]


def flag_files(out):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/flags/signal_type=*/*.parquet")}


def whole_report(out):
    parts, header = read_report(out)
    return sorted(json.dumps(p, sort_keys=True) for part in parts for p in part), {k: v for k, v in header.items() if k != "generated_at"}


def test_one_signal_again(spark, tmp_path):
    args = raw_inputs(spark, tmp_path)
    out = args[-1]
    pipeline.run(spark, *args)
    files, report = flag_files(out), whole_report(out)
    pipeline.run(spark, *args, stages=("signals", "report"), only=["billing_outlier", "shared_official"])
    now = flag_files(out)
    again = ("signal_type=billing_outlier", "signal_type=shared_official")
    assert {f: t for f, t in files.items() if not any(s in f for s in again)} == {f: t for f, t in now.items() if not any(s in f for s in again)}
    assert not set(files) & {f for f in now if any(s in f for s in again)} and whole_report(out) == report


def test_one_signal_again_with_other_thresholds(spark, tmp_path):
    args = raw_inputs(spark, tmp_path)
    out = args[-1]
    pipeline.run(spark, *args)
    strict = dataclasses.replace(DEFAULT_CONFIG, min_peers=1000)
    pipeline.run(spark, *args, cfg=strict, stages=("signals", "report"), only=["billing_outlier"])
    assert not glob.glob(f"{out}/flags/signal_type=billing_outlier*")
    report, header = whole_report(out)
    assert header["signal_counts"]["billing_outlier"] == 0 and header["total_providers_flagged"] == 11
    assert header["signal_counts"]["rapid_escalation"] == 1 and len(report) == 11
    pipeline.run(spark, *args, stages=("signals", "report"), only=["billing_outlier"])
    check_report(out)
    with pytest.raises(ValueError, match="no signal x"):
        pipeline.run(spark, *args, stages=("signals",), only=["x"])


def test_intermediate_tables_are_dropped(spark, tmp_path):
    args = raw_inputs(spark, tmp_path)
    before = lineage.stored_count()
    root = ensure_checkpoint_dir(spark).removeprefix("file:") + "/claimlens"
    had = set(os.listdir(root)) if os.path.isdir(root) else set()
    tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("claimlens_")}
    pipeline.run(spark, *args)
    assert lineage.stored_count() == before
    assert (set(os.listdir(root)) if os.path.isdir(root) else set()) == had
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("claimlens_")} == tables


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_buckets_follow_the_bytes_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(200_000).selectExpr("id", "cast(rand() as string) AS s").write.parquet(path)
    one = spark.read.parquet(path)
    both = one.join(one.withColumnRenamed("s", "s2"), "id")
    assert lineage.buckets_for(both, 10_000) >= lineage.buckets_for(one, 10_000) > lineage.BUCKETS_RANGE[0]
    assert lineage.buckets_for(both, 10_000) < 3 * lineage.buckets_for(one, 10_000)
    assert lineage.buckets_for(one) == lineage.BUCKETS_RANGE[0]
    stored = lineage.materialize(one, "t", bucket_by="id", buckets=3)
    assert stored.count() == 200_000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver test data not present")
def test_report_of_the_larger_star_loses_no_provider(spark, tmp_path):
    from claimlens.sources.tables import load_star_tables
    tables, out = load_star_tables(spark, "/root/testdata/sf0.1"), str(tmp_path / "out")
    tables.registry.write.parquet(f"{out}/nppes_slim.parquet")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pipeline.signals_stage(tables, out)
        pipeline.report_stage(spark, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    flagged = spark.read.parquet(f"{out}/flags").select("npi").distinct().count()
    ranks = spark.read.json(f"{out}/report/providers")
    got = ranks.selectExpr("count(*)", "count(distinct rank)", "min(rank)", "max(rank)", "count(distinct npi)").first()
    assert flagged > 8000 and tuple(got) == (flagged, flagged, 1, flagged, flagged)
    assert spark.read.json(f"{out}/report/header").first()["total_providers_flagged"] == flagged


def test_claims_laid_out_by_provider(spark, tmp_path):
    args = raw_inputs(spark, tmp_path)
    out = args[-1]
    pipeline.run(spark, *args, cluster_claims=True)
    check_report(out)
    report, laid = whole_report(out), sorted(glob.glob(f"{out}/claims_clustered/*.parquet"))
    stamps = [os.stat(f).st_mtime_ns for f in laid]
    # S1 again from its keys' claims, then the rows behind its flags; the layout is kept
    pipeline.run(spark, *args, stages=("signals", "report"), only=["excluded_provider"], cluster_claims=True)
    pipeline.run(spark, *args, stages=("claims",), only=["excluded_provider"], cluster_claims=True)
    assert whole_report(out) == report
    assert stamps == [os.stat(f).st_mtime_ns for f in sorted(glob.glob(f"{out}/claims_clustered/*.parquet"))]
    spending = spark.read.parquet(args[0])
    npi = S.BILLING_NPI
    want = spending.where(spending[npi].isin(X.BARRED, X.NAMESAKE)).count()
    rows = spark.read.parquet(f"{out}/flagged_claims")
    assert want and rows.count() == want and {r[0] for r in rows.select(npi).distinct().collect()} == {X.BARRED, X.NAMESAKE}
