"""A small world with one planted case per signal (FIXTURES.md): a spread of ordinary
prescribers, and providers built so that every expected value can be worked out by hand."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import SparkSession

from claimlens import schemas as S
from claimlens.sources.tables import ClaimsTables

ORDINARY = 30
OUTLIER, RISER, CLINIC, HOME_MILD, HOME_BAD, BARRED, NAMESAKE = (f"400000000{i}" for i in range(1, 8))
CHAIN = [f"450000000{i}" for i in range(1, 6)]
SILENT = "4900000001"


def ordinary_npi(i: int) -> str:
    return f"31000000{i:02d}"


def registry_rows() -> list[tuple]:
    def person(npi, last, first, state, taxonomy, enumerated="05/20/2015"):
        return (npi, "1", None, last, first, state, "97000", taxonomy, enumerated, None, None)

    def company(npi, name, state, official_last, official_first):
        return (npi, "2", name, None, None, state, "89000", "261Q00000X", "11/02/2011", official_last, official_first)

    rows = [person(ordinary_npi(i), f"Nurse{i}", "Any", "OR", "363L00000X") for i in range(ORDINARY)]
    rows += [person(OUTLIER, "Sato", "Iris", "OR", "363L00000X"),
             person(RISER, "Brandt", "Noel", "WA", "208D00000X", "03/10/2022"),
             company(CLINIC, "Harbor Day Clinic", "ME", "Abel", "Tom"),
             person(HOME_MILD, "Quist", "Ada", "VT", "251J00000X"),
             person(HOME_BAD, "Prior", "Lou", "", "251J00000X"),
             person(BARRED, "Weld", "Hugo", "KS", "122300000X"),
             person(NAMESAKE, " Okafor", "lena ", "MN", "122300000X"),
             person(SILENT, "Quiet", "Max", "OR", "363L00000X")]
    rows += [company(npi, f"Sierra Unit {k}", state, " vance", "Ruth ")
             for k, (npi, state) in enumerate(zip(CHAIN, ["NV", "UT", "NV", "ID", "UT"]))]
    return rows


def exclusion_rows() -> list[tuple]:
    return [("WELD", "HUGO", None, BARRED, "1128b7", "20210401", None, "KS", "DENTAL"),
            ("OKAFOR", "LENA", "R", None, "1128a3", "20220115", "20220301", "MN", "DENTAL"),
            ("STRANGER", "AL", None, "4999999999", "1128a3", "20190101", None, "OR", "NURSING")]


RISER_MONTHLY = [40] * 6 + [400, 1600, 400]


def spending_rows() -> list[tuple]:
    rows = []

    def bill(npi, month, claims, paid, people, code="99214"):
        rows.append((npi, npi, month, code, claims, Decimal(paid).quantize(Decimal("0.01")), people))

    for i in range(ORDINARY):
        for month in ("2023-03", "2023-04", "2023-05"):
            bill(ordinary_npi(i), month, 12, 400 + 10 * i, 9)
    for month in ("2023-03", "2023-04", "2023-05"):
        bill(OUTLIER, month, 700, 30000, 300)
    for k, paid in enumerate(RISER_MONTHLY):
        bill(RISER, f"2022-{4 + k:02d}", 4, paid, 3)
    bill(CLINIC, "2023-01", 1760, 35200, 900)
    bill(CLINIC, "2023-02", 1056, 21120, 600)
    for npi in CHAIN:
        bill(npi, "2023-07", 900, 250000, 410)
    bill(HOME_MILD, "2023-08", 300, 6000, 20, "G0299")
    bill(HOME_MILD, "2023-09", 500, 9000, 25, "T1020")
    bill(HOME_BAD, "2023-08", 250, 5000, 10, "S9123")
    for month in ("2021-03", "2021-04", "2021-05"):
        bill(BARRED, month, 10, 300, 6)
    for month in ("2022-01", "2022-02", "2022-03"):
        bill(NAMESAKE, month, 5, 500, 4)
    return rows


def make_tables(spark: SparkSession, spending=None, registry=None, exclusions=None) -> ClaimsTables:
    return ClaimsTables(
        spending=spark.createDataFrame(spending if spending is not None else spending_rows(),
                                       S.SPENDING_SCHEMA),
        registry=spark.createDataFrame(registry if registry is not None else registry_rows(),
                                       S.REGISTRY_SCHEMA),
        exclusions=spark.createDataFrame(exclusions if exclusions is not None else exclusion_rows(),
                                         S.EXCLUSION_SCHEMA),
    )
