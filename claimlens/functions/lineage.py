"""Cutting lineage between stages.

A rollup or flag table read by many downstream plans is written once as
Parquet under the cluster's shared checkpoint folder (the session's
``spark.checkpoint.dir``) and read back. Downstream plans then start from
those files: plans stay small, the fact is not rescanned, a lost executor
costs a re-read of shared files rather than a recomputation from the fact,
and AQE/broadcast decisions see the real file size. (An eager
``Dataset.checkpoint`` would compute the plan twice - once to count, once
to write - so a plain Parquet write is used.)

With ``bucket_by`` the table is written hash-bucketed on the key (one file
per bucket: the data is repartitioned on the key first) and registered as a
bucketed table, so every later aggregate, window or join on that key reads
co-partitioned data and needs no exchange of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimlens.plans.session import ensure_checkpoint_dir


_TRACKED: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist (memory, spilling to disk) and remember it for ``release``."""
    from pyspark import StorageLevel
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _TRACKED.append(kept)
    return kept


def release() -> None:
    """Drop every cache taken with ``keep``. Only speed is affected: a plan that still references a released cache
    recomputes it from its inputs."""
    while _TRACKED:
        _TRACKED.pop().unpersist()


_STORED: list[tuple[object, str | None, str]] = []

# Bytes of input per bucket of a stored table, and the range of the resulting
# number of buckets.
BUCKET_BYTES = 128 * 1024 * 1024
BUCKETS_RANGE = (8, 20_000)


def buckets_for(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Number of buckets for tables derived from ``df``, from the bytes of the
    files it reads (the optimizer's estimate of a join is a product, and says
    nothing). Tables that are joined with each other take the same number."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2 ** 63 - 1)))
    if any(s >= unknown for s in sizes):    # not read from files
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(-(-sum(sizes) // bucket_bytes), BUCKETS_RANGE[0]), BUCKETS_RANGE[1])


def stored_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table that the caller writes; ``drop_stored`` drops it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/claimlens/{name}_{uuid.uuid4().hex[:12]}"
    _STORED.append((spark, None, path))
    return path


def materialize(df: DataFrame, name: str = "stage", bucket_by: str | None = None,
                buckets: int | None = None, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once and read back. ``buckets`` (with ``bucket_by``) defaults
    to ``buckets_for(df)``; ``sort_by`` is the order of the rows in a bucket's file, which
    spares merge joins and aggregates on it a sort of their own."""
    spark = df.sparkSession
    if bucket_by is None:
        path = stored_path(spark, name)
        df.write.mode("error").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = buckets or buckets_for(df)
    root = ensure_checkpoint_dir(spark).rstrip("/")
    tag = f"{name}_{uuid.uuid4().hex[:12]}"
    path, table = f"{root}/claimlens/{tag}", f"claimlens_{tag}"
    writer = df.repartition(n, bucket_by).write.mode("error").bucketBy(n, bucket_by)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    writer.option("path", path).saveAsTable(table)
    _STORED.append((spark, table, path))
    return spark.table(table)


def stored_count() -> int:
    return len(_STORED)


def drop_stored(keep_first: int = 0) -> None:
    """Drop the tables and files that ``materialize`` wrote, but for the first
    ``keep_first``: at the end of a run, when no plan needs them any more."""
    while len(_STORED) > keep_first:
        spark, table, path = _STORED.pop()
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
