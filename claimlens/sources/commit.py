"""Outputs that are built once for their inputs.

Beside its data an output keeps a manifest of what it was built from: path, length and
modification time of every input file, and a note of how (columns, version). It is written
last, so its own success marker is the commit of the whole. An output is kept if that
marker is there and the manifest equals the inputs as they are now; half-written outputs,
and outputs of inputs that have changed, gone or come since, are built again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: hidden from readers of the output by its underscore
MANIFEST = "_inputs"


def inputs_manifest(spark: SparkSession, paths: list[str], note: str = "") -> DataFrame:
    """(path, length, modified, note) of every file below ``paths``; no content is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
             .select("path", "length", F.unix_micros("modificationTime").alias("modified")))
    return files.withColumn("note", F.lit(note))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_current(spark: SparkSession, out: str, now: DataFrame) -> bool:
    """Whether ``out`` was committed from just the inputs ``now``."""
    if not _exists(spark, f"{out}/{MANIFEST}/_SUCCESS"):
        return False
    was = spark.read.schema(now.schema).parquet(f"{out}/{MANIFEST}")
    changed = now.exceptAll(was).unionByName(was.exceptAll(now))
    return changed.isEmpty()


def build_once(spark: SparkSession, inputs: list[str], out: str, build: Callable[[str], None], note: str = "") -> bool:
    """Runs ``build(out)``, which overwrites ``out``, unless it is there and current. The
    inputs are listed before, so one that changes meanwhile has it built again next time.
    Returns whether it was built."""
    now = inputs_manifest(spark, inputs, note)
    if is_current(spark, out, now):
        return False
    listed = now.collect()      # file names and times only; fixed before the build begins
    build(out)
    spark.createDataFrame(listed, now.schema).coalesce(1).write.mode("overwrite").parquet(f"{out}/{MANIFEST}")
    return True
