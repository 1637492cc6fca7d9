"""The batch job: ingest -> signals -> report.

    python -m claimlens.plans.pipeline --spending claims.parquet \\
        --registry-csv nppes_raw/ --exclusions-csv UPDATED.csv --out out/ [--stage signals [--signals billing_outlier]]

Each stage reads files and writes files, so it can run in a session of its own
and a failed one is run again from what the stage before it wrote:

    ingest   nppes_slim.parquet, leie.parquet (kept while they are whole and their CSV is the
             same); records left out in nppes_slim.parquet_rejected, leie.parquet_rejected
    signals  flags/ (by signal), official_members/ (members of each shared official,
             by flag_id), provider_totals/ (lifetime sums per provider)
    report   report/providers (JSON lines with rank), report/header
    claims   flagged_claims/ (claim rows of flagged providers; only if asked for)

With ``--cluster-claims`` the claims are laid out by provider first (claims_clustered/, kept like the
ingested tables); ``excluded_provider`` alone and the claims stage then read the claims of few providers.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from claimlens.config import DEFAULT_CONFIG, SIGNAL_ORDER, SignalConfig
from claimlens.functions.lineage import drop_stored, release, stored_count
from claimlens.operators.rollups import provider_totals
from claimlens.plans import drilldown
from claimlens.plans import report as R
from claimlens.plans.flags import SignalSet
from claimlens.sources import clustered, ingest, sinks
from claimlens.sources.tables import ClaimsTables, load_domain_tables, read_spending, register_views, registry_view

STAGES = ("ingest", "signals", "report")


def ingest_stage(spark: SparkSession, registry_csv: str, exclusions_csv: str, out: str) -> tuple[str, str]:
    registry_path = f"{out}/nppes_slim.parquet"
    exclusions_path = f"{out}/leie.parquet"
    src = registry_csv if registry_csv.endswith(".csv") else ingest.find_registry_csv(spark, registry_csv)
    ingest.build_registry_slim(spark, src, registry_path)
    ingest.build_exclusions_parquet(spark, exclusions_csv, exclusions_path)
    return registry_path, exclusions_path


def signals_stage(tables: ClaimsTables, out: str, cfg: SignalConfig = DEFAULT_CONFIG,
                  only: Sequence[str] | None = None, by_provider: bool = False) -> None:
    """Intermediate tables of the stage are dropped when its results are written. ``only``:
    signals to run again; the flags of the others, and what hangs on them, stay as they are.
    ``by_provider``: the claims are laid out by provider."""
    before = stored_count()
    register_views(tables)
    try:
        narrow = by_provider and only is not None and set(only) == {"excluded_provider"}
        ss = SignalSet(tables, cfg, materialize_rollups=not narrow, signals=only or SIGNAL_ORDER, clustered=by_provider)
        if only is None:
            sinks.write_table(provider_totals(ss.pm), f"{out}/provider_totals")
        if "shared_official" in ss.signals:
            sinks.write_table(ss.official_npi_totals(), f"{out}/official_members")
        if only is None:
            sinks.write_flags(ss.flags_with_evidence(), f"{out}/flags")
        else:
            sinks.replace_flags(ss.flags_with_evidence(), f"{out}/flags", ss.signals)
    finally:
        release()
        drop_stored(before)


def report_stage(spark: SparkSession, out: str) -> None:
    """Reads the files of the stages before it, and nothing else."""
    before = stored_count()
    flags = sinks.read_flags(spark, f"{out}/flags")
    totals = spark.read.parquet(f"{out}/provider_totals")
    registry = registry_view(spark.read.parquet(f"{out}/nppes_slim.parquet"))
    try:
        ranked = R.report_ranked(R.build_report(flags, registry, totals))
        sinks.write_report(R.nested_report(ranked), R.report_header(totals, flags), f"{out}/report")
        sinks.write_document(spark, f"{out}/report")
    finally:
        drop_stored(before)


def claims_stage(spark: SparkSession, spending: DataFrame, out: str, only: Sequence[str] | None = None) -> None:
    """The claim rows of every flagged provider, or of those that the signals ``only`` flag."""
    before = stored_count()
    try:
        sinks.write_table(drilldown.flagged_claims(spending, sinks.read_flags(spark, f"{out}/flags"), only), f"{out}/flagged_claims")
    finally:
        drop_stored(before)


def run(spark: SparkSession, spending: str, registry_csv: str, exclusions_csv: str, out: str,
        cfg: SignalConfig = DEFAULT_CONFIG, stages: tuple[str, ...] = STAGES, only: Sequence[str] | None = None,
        cluster_claims: bool = False) -> None:
    registry_path, exclusions_path = f"{out}/nppes_slim.parquet", f"{out}/leie.parquet"
    if "ingest" in stages:
        ingest_stage(spark, registry_csv, exclusions_csv, out)
    layout = f"{out}/claims_clustered"
    if cluster_claims and {"signals", "claims"} & set(stages):
        clustered.build_clustered(spark, spending, layout)
        claims = clustered.read_clustered(spark, layout)
    else:
        claims = read_spending(spark, spending)
    if "signals" in stages:
        tables = replace(load_domain_tables(spark, spending, registry_path, exclusions_path), spending=claims)
        signals_stage(tables, out, cfg, only, by_provider=cluster_claims)
    if "report" in stages:
        report_stage(spark, out)
    if "claims" in stages:
        claims_stage(spark, claims, out, only)


def main() -> None:
    from claimlens.plans.session import build_session, ensure_checkpoint_dir
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--spending", required=True)
    ap.add_argument("--registry-csv", required=True, help="registry CSV file or folder to search")
    ap.add_argument("--exclusions-csv", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--stage", choices=("all", *STAGES, "claims"), default="all")
    ap.add_argument("--cluster-claims", action="store_true", help="lay the claims out by provider, once")
    ap.add_argument("--signals", nargs="+", choices=SIGNAL_ORDER, help="run these again and leave the flags of the others")
    ap.add_argument("--master", default=None)
    args = ap.parse_args()
    spark = build_session(args.master)
    ensure_checkpoint_dir(spark)
    run(spark, args.spending, args.registry_csv, args.exclusions_csv, args.out,
        stages=STAGES if args.stage == "all" else (args.stage,), only=args.signals,
        cluster_claims=args.cluster_claims)


if __name__ == "__main__":
    main()
