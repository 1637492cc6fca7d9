"""The report as one JSON document in ordered text files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimlens.sources import sinks


def joined(path) -> dict:
    files = sorted(Path(path, "document").glob("part-*"))
    return json.loads("".join(f.read_text() for f in files))


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_joined_files_are_one_document_in_rank_order(spark, tmp_path, n):
    # ranks are scattered over the partitions; names hold quotes, line ends and nulls
    providers = spark.range(n).select(((F.col("id") * 7919) % max(n, 1) + 1).alias("rank"), F.when(F.col("id") % 3 > 0, F.lit('a "b"\n, c]}')).alias("name"))
    header = spark.sql(f"SELECT {n}L AS total_providers_flagged, map('a', 1L) AS signal_counts")
    path = sinks.write_report(providers.repartition(5), header, str(tmp_path / "report"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_document(spark, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = joined(path)
    assert got["total_providers_flagged"] == n and got["signal_counts"] == {"a": 1}
    assert [r["rank"] for r in got[sinks.PROVIDERS_KEY]] == list(range(1, n + 1))
    assert {r["rank"]: r["name"] for r in got[sinks.PROVIDERS_KEY]} == {r["rank"]: r["name"] for r in providers.collect()}
    if n > 1000:
        assert len(list(Path(path, "document").glob("part-*"))) > 1
