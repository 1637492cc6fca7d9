"""Billing volume far above the provider's peer group.

Peer group = registry taxonomy x state, at least ``min_peers`` billing
providers. A provider is flagged when its lifetime paid exceeds the group's
p99; the ratio to the group median is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.config import DEFAULT_CONFIG, SignalConfig
from claimlens.functions.columns import dollars, nonblank, round4, safe_ratio
from claimlens.functions.lineage import materialize
from claimlens.functions.quantiles import group_quantiles
from claimlens.functions.sketches import RANK_ERROR, group_sketches, merged_sketches, sketch_quantiles
from claimlens.operators.rollups import provider_month, provider_totals
from claimlens.sources.tables import ClaimsTables


def provider_peers(tables: ClaimsTables, pm: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Provider totals with the registry's taxonomy and state."""
    if totals is None:
        totals = provider_totals(provider_month(tables.spending) if pm is None else pm)
    totals = totals.select("npi", "paid", "claims")
    reg = tables.registry.select("npi", "taxonomy", "state")
    return totals.join(reg, "npi")


def peer_group_stats(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                     peers: DataFrame | None = None) -> DataFrame:
    """(taxonomy, state, median_paid, p99_paid, peer_count), >= min peers."""
    peers = provider_peers(tables) if peers is None else peers
    groups = ["taxonomy", "state"]
    eligible = (peers.where(nonblank("taxonomy") & nonblank("state"))
                     .select(*groups, dollars("paid").alias("paid_d")))
    stats = group_quantiles(eligible, groups, "paid_d",
                            [cfg.median_quantile, cfg.outlier_quantile],
                            ["median_paid", "p99_paid"], count_name="peer_count",
                            method=cfg.quantile_method, accuracy=cfg.approx_accuracy)
    return (stats.where(F.col("peer_count") >= cfg.min_peers)
                 .select("taxonomy", "state", "median_paid", "p99_paid",
                         F.col("peer_count").cast("bigint").alias("peer_count")))


#: coarser and coarser peer groups
LEVELS = (("taxonomy", "state"), ("taxonomy",), ())


def peer_group_levels(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG, peers: DataFrame | None = None) -> DataFrame:
    """(level, taxonomy, state, peer_count, median_paid, p99_paid) of the peer groups, of all
    states of a taxonomy (state NULL), and of all providers: estimates from sketches. The
    finest are stored, and each level merges the one below; the providers are read once."""
    peers = provider_peers(tables) if peers is None else peers
    eligible = (peers.where(nonblank("taxonomy") & nonblank("state"))
                     .select("taxonomy", "state", dollars("paid").alias("paid_d")))
    sketches, levels = None, []
    for number, groups in enumerate(LEVELS, 1):
        sketches = (group_sketches(eligible, groups, "paid_d") if sketches is None
                    else merged_sketches(sketches, groups))
        sketches = materialize(sketches, f"sketches_{number}")
        found = sketch_quantiles(sketches, [cfg.median_quantile, cfg.outlier_quantile], ["median_paid", "p99_paid"])
        missing = [F.lit(None).cast("string").alias(c) for c in LEVELS[0] if c not in groups]
        levels.append(found.select(F.lit(number).alias("level"), *groups, *missing, F.col("members").cast("bigint").alias("peer_count"),
                                   "median_paid", "p99_paid"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where(F.col("peer_count") >= cfg.min_peers)


def peer_level_ranks(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG) -> DataFrame:
    """How good the estimates of ``peer_group_levels`` are: for each, whether the quantile asked for
    lies within RANK_ERROR of the share of the group's providers below and up to the estimate."""
    everyone = F.lit("all").alias("everyone")       # a key of its own for the level of all providers
    peers = materialize(provider_peers(tables).select("*", everyone), "peers")
    levels = materialize(peer_group_levels(tables, cfg, peers).select("*", everyone), "peer_levels")
    paid, out = dollars("paid"), None
    eligible = peers.where(nonblank("taxonomy") & nonblank("state")).select("taxonomy", "state", "everyone", paid.alias("paid_d"))
    for number, groups in enumerate(LEVELS, 1):
        of = levels.where(F.col("level") == number)
        held = eligible.join(of.select("everyone", *groups, "median_paid", "p99_paid"), ["everyone", *groups])
        share = {}
        for q, name in ((cfg.median_quantile, "median_paid"), (cfg.outlier_quantile, "p99_paid")):
            below = F.count_if(F.col("paid_d") < F.col(name)) / F.count("paid_d")
            upto = F.count_if(F.col("paid_d") <= F.col(name)) / F.count("paid_d")
            share[name.replace("_paid", "_within")] = (below - RANK_ERROR <= q) & (q <= upto + RANK_ERROR)
        ranks = held.groupBy(*groups).agg(F.count(F.lit(1)).alias("peer_count"), *[v.alias(k) for k, v in share.items()])
        missing = [F.lit(None).cast("string").alias(c) for c in LEVELS[0] if c not in groups]
        ranks = ranks.select(F.lit(number).alias("level"), *groups, *missing, F.col("peer_count").cast("bigint").alias("peer_count"), *share)
        out = ranks if out is None else out.unionByName(ranks)
    return out


def outlier_records(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                    pm: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """S2 with unrounded values. The providers with their peer group are stored
    once: the quantiles and the comparison with them read the same rows, so the
    claims are scanned once. The groups are stored as well: a join with them is planned by
    their own size, and not by the product of what they were joined from, which would have
    Spark send the providers instead."""
    peers = materialize(provider_peers(tables, pm, totals), "peers")
    stats = materialize(peer_group_stats(tables, cfg, peers), "peer_stats")
    return (peers.join(stats, ["taxonomy", "state"])
                 .where(dollars("paid") > F.col("p99_paid"))
                 .select("npi", dollars("paid").alias("total_paid"),
                         F.coalesce(F.col("claims"), F.lit(0)).cast("bigint").alias("total_claims"),
                         "taxonomy", "state", "median_paid", "p99_paid", "peer_count",
                         F.coalesce(safe_ratio(dollars("paid"), F.col("median_paid")), F.lit(0.0)).alias("ratio_to_median")))


def rounded(records: DataFrame) -> DataFrame:
    return records.withColumns({c: round4(c) for c in ("median_paid", "p99_paid", "ratio_to_median")})


def billing_outlier(tables: ClaimsTables, cfg: SignalConfig = DEFAULT_CONFIG,
                    pm: DataFrame | None = None) -> DataFrame:
    return rounded(outlier_records(tables, cfg, pm))
