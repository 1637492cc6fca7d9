"""Sinks: what the signal stage hands to the report stage (IO-10), and the
report (IO-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from claimlens.plans.flags import FLAG_COLUMNS

FLAG_SCHEMA = ("signal_type string, signal_index int, order_value double, order_key string, flag_id string, npi string, "
               "severity string, severity_rank int, overpayment double, evidence string")


def write_flags(flags: DataFrame, path: str, mode: str = "overwrite") -> str:
    """IO-10: the long flag table, partitioned by signal type."""
    flags.select(*FLAG_COLUMNS).write.mode(mode).partitionBy("signal_type").parquet(path)
    return path


def replace_flags(flags: DataFrame, path: str, signals: Sequence[str]) -> str:
    """The flags of some signals in place of the ones that ``path`` has of them; the files of
    the other signals are not touched. New files are written aside and
    moved in when the job commits. A signal that flags nobody any more has no rows to
    overwrite its partition with, so its old one is removed."""
    spark = flags.sparkSession
    seen = Observation()
    wanted = flags.select(*FLAG_COLUMNS).where(F.col("signal_type").isin(*signals))
    (wanted.observe(seen, *[F.count_if(F.col("signal_type") == name).alias(name) for name in signals])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signal_type").parquet(path))
    counts = seen.get
    for name in signals:
        if not counts[name]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/signal_type={name}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return path


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Whatever runs wrote the partitions. The schema is given, so that a table without any
    flags reads as an empty one."""
    return spark.read.schema(FLAG_SCHEMA).parquet(path).select(*FLAG_COLUMNS)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_report(providers: DataFrame, header: DataFrame, path: str, mode: str = "overwrite") -> str:
    """IO-11: provider records as JSON lines under ``path/providers`` (nulls
    written as null) and the one-row summary under ``path/header``. Every
    record carries its ``rank``; each file is in rank order."""
    (providers.sortWithinPartitions("rank").write.mode(mode).option("ignoreNullFields", "false")
     .json(f"{path}/providers"))
    header.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/header")
    return path


#: fixed value: the key of the provider list in the report document
PROVIDERS_KEY = "flagged_providers"


def write_document(spark: SparkSession, path: str, mode: str = "overwrite") -> str:
    """IO-11 as one JSON document: text files under ``path/document`` whose contents, joined in
    the order of their names, are an object with the header's fields and the list of providers
    by rank. Made of the records that ``write_report`` left in ``path``: a head, the records
    (all but the first behind a comma) and a tail are sorted by rank into ranges, so no
    task holds the document. No provider gives an empty list."""
    records = spark.read.text(f"{path}/providers").select(F.get_json_object("value", "$.rank").cast("long").alias("rank"), "value")
    records = records.select("rank", F.when(F.col("rank") > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    head = spark.read.text(f"{path}/header").select(
        F.lit(0).cast("long").alias("rank"),
        F.concat(F.expr("left(value, length(value) - 1)"), F.lit(f',"{PROVIDERS_KEY}":[')).alias("value"))
    tail = head.select(F.lit(2 ** 63 - 1).alias("rank"), F.lit("]}").alias("value"))
    whole = records.unionByName(head).unionByName(tail)
    whole.orderBy("rank").select("value").write.mode(mode).text(f"{path}/document")
    return path
