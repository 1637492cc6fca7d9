"""Ingest: registry CSV -> slim Parquet, exclusion CSV -> normalised Parquet.

The CSV is split across executors by byte range, also where quoted fields hold
line ends (``csv_records``); only the needed columns reach the Parquet writer. Records
that are malformed are kept beside the output, with file and reason, and outputs
carry a manifest of their inputs (``commit``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimlens import schemas as S
from claimlens.config import MISSING_NPI_VALUES, MISSING_REINSTATEMENT_VALUES
from claimlens.functions.columns import norm_key
from claimlens.functions.lineage import drop_stored, materialize, stored_count
from claimlens.sources.commit import build_once
from claimlens.sources.csv_records import header, parse

REGISTRY_FILE_GLOB = "npidata_pfile_*.csv"


def find_registry_csv(spark: SparkSession, root: str) -> str:
    """IO-2a: pick the main registry CSV under ``root``: files matching
    ``npidata_pfile_*.csv`` (recursively), header-only files skipped, largest
    wins; if no name matches, the largest CSV of all. Uses the binaryFile source
    with only path/length selected, so no file content is read; one path string
    comes back to the driver."""
    for pattern in (REGISTRY_FILE_GLOB, "*.csv"):
        listing = (spark.read.format("binaryFile")
                   .option("pathGlobFilter", pattern)
                   .option("recursiveFileLookup", "true")
                   .load(root)
                   .select("path", "length")
                   .where(~F.col("path").contains("FileHeader"))
                   .orderBy(F.desc("length"), F.asc("path"))
                   .limit(1)   # the feature: pick one file
                   .collect())
        if listing:
            return listing[0]["path"]
    raise FileNotFoundError(f"no CSV file under {root}")


def read_csv_by_name(spark: SparkSession, csv_path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a CSV file with a header, as text, wherever they stand
    in it. Quotes are doubled inside quoted fields, which may hold line ends; a backslash is
    a character like any other, and malformed records (too few or too many
    fields) are dropped, whatever columns are read."""
    return parse(spark, csv_path, columns).where(F.col("_reason").isNull()).select(*[F.col(f"`{c}`") for c in columns])


def rejected_path(out_path: str) -> str:
    return f"{out_path.rstrip('/')}_rejected"


@dataclass(frozen=True)
class Ingested:
    """What an ingest did: good + bad are all records of the file; None if it was kept."""

    path: str
    built: bool
    good: int | None = None
    bad: int | None = None


def ingest_csv(spark: SparkSession, csv_path: str, columns: Sequence[str], out_path: str,
               shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Ingested:
    """IO-2, IO-3, IO-5, IO-6, IO-7: good records, shaped, to zstd Parquet in ``out_path``; the
    others with their text, file and reason beside it (``rejected_path``). Both come from
    one parse, which is stored and counted as it is written. An output that is whole and
    was built from the file as it is now is kept."""
    counts: dict[str, int] = {}

    def build(out: str) -> None:
        seen = Observation()
        good = F.col("_reason").isNull()
        parsed = materialize(parse(spark, csv_path, columns).observe(
            seen, F.count_if(good).alias("good"), F.count_if(~good).alias("bad")), "csv_parsed")
        counts.update(seen.get)
        (parsed.where(~good).select("_file", "_reason", "_corrupt_record")
         .write.mode("overwrite").option("compression", "zstd").parquet(rejected_path(out)))
        (shape(parsed.where(good).select(*[F.col(f"`{c}`") for c in columns]))
         .write.mode("overwrite").option("compression", "zstd").parquet(out))

    before = stored_count()
    try:
        built = build_once(spark, [csv_path], out_path, build, note=",".join(columns))
    finally:
        drop_stored(before)
    return Ingested(out_path, built, counts.get("good"), counts.get("bad"))


def read_registry_csv(spark: SparkSession, csv_path: str) -> DataFrame:
    """The registry's 11 used columns."""
    return read_csv_by_name(spark, csv_path, S.REGISTRY_LONG)


def build_registry_slim(spark: SparkSession, csv_path: str, out_path: str) -> Ingested:
    """IO-2: 11 of ~330 columns."""
    return ingest_csv(spark, csv_path, S.REGISTRY_LONG, out_path)


def read_exclusions_csv(spark: SparkSession, csv_path: str) -> DataFrame:
    """The exclusion list's 9 used columns, by header name, all text (no type
    sniffing, so zero-led NPIs and dates stay intact)."""
    return read_csv_by_name(spark, csv_path, S.EXCLUSION_COLUMNS)


def normalize_exclusions(raw: DataFrame) -> DataFrame:
    """IO-3: names and state upper-cased and trimmed, sentinel NPI and
    reinstatement values turned into NULL, dates kept as text."""
    npi = F.trim(F.col("NPI"))
    rein = F.col("REINDATE").cast("string")
    return raw.select(
        norm_key("LASTNAME").alias("LASTNAME"),
        norm_key("FIRSTNAME").alias("FIRSTNAME"),
        norm_key("MIDNAME").alias("MIDNAME"),
        F.when(npi.isin(*MISSING_NPI_VALUES), F.lit(None).cast("string")).otherwise(npi).alias("NPI"),
        F.trim(F.col("EXCLTYPE")).alias("EXCLTYPE"),
        F.trim(F.col("EXCLDATE").cast("string")).alias("EXCLDATE"),
        F.when(rein.isin(*MISSING_REINSTATEMENT_VALUES), F.lit(None).cast("string"))
         .otherwise(F.trim(rein)).alias("REINDATE"),
        norm_key("STATE").alias("STATE"),
        F.trim(F.col("SPECIALTY")).alias("SPECIALTY"),
    )


def build_exclusions_parquet(spark: SparkSession, csv_path: str, out_path: str) -> Ingested:
    """IO-3: the normalised exclusion list."""
    return ingest_csv(spark, csv_path, S.EXCLUSION_COLUMNS, out_path, normalize_exclusions)


def read_rejected(spark: SparkSession, out_path: str) -> DataFrame:
    """IO-7: (_file, _reason, _corrupt_record) of the records that an ingest left out."""
    return spark.read.schema("_file string, _reason string, _corrupt_record string").parquet(rejected_path(out_path))


def count_malformed(spark: SparkSession, csv_path: str) -> int:
    """IO-7 audit of a file, without an ingest."""
    names, _ = header(spark, csv_path)
    return parse(spark, csv_path, names[:1]).where(F.col("_reason").isNotNull()).count()
