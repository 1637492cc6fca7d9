"""SparkSession settings the plans are designed around."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Session-level settings. AQE is what makes joins against derived tables
# safe at scale: a shuffle join whose materialised side turns out small is
# re-planned as a broadcast join, oversized shuffle partitions of a hot NPI
# are split (skew join), and small post-shuffle partitions are coalesced.
SESSION_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A broadcast table is built in the driver's heap, several at once in a run of all signals.
    # Static ones are decided from bytes on disk, of which the hash table takes many times as
    # many (25 times were seen: sorted keys compress well); those of AQE from the rows that
    # were shuffled, of which it takes several times as many. Larger tables meet as bucketed
    # or shuffled joins, so what the driver holds does not grow with the providers.
    "spark.sql.autoBroadcastJoinThreshold": str(256 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(4 * 1024 * 1024),
    "spark.sql.parquet.compression.codec": "zstd",
    # a key list that is pushed to a scan is tested key by key against statistics and Bloom
    # filters up to this length (sources/clustered.py), by its least and greatest beyond it
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # stored tables have one sorted file a bucket; their order spares joins a sort
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.ui.enabled": "false",
    # plan text is built for every action; keep a runaway plan from costing heap
    "spark.sql.maxPlanStringLength": str(2 * 1024 * 1024),
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder. Where none is named, a local
    master gets one of its own; any other master raises."""
    try:
        sc = spark.sparkContext
    except Exception:   # sessions without a local SparkContext handle
        sc = None
    existing = sc.getCheckpointDir() if sc is not None else None
    if existing:
        return existing
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None:
            sc.setCheckpointDir(current)
        return current
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not re.match(r"local(\[[^\]]*\])?$", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables "
                           f"are written there, and {master!r} has executors on other machines")
    # one machine (tests, local runs): a folder of its own is shared by all
    path = tempfile.mkdtemp(prefix="claimlens-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:   # static in some deployments; the path is returned anyway
        pass
    sc.setCheckpointDir(path)
    return path


def build_session(master: str | None = None, app_name: str = "claimlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    if "spark.driver.memory" not in conf:
        builder = builder.config("spark.driver.memory", os.environ.get("CLAIMLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of SESSION_CONF to an existing session."""
    for key, value in SESSION_CONF.items():
        if key == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(key, value)
        except Exception:  # static conf of a session someone else built
            pass
