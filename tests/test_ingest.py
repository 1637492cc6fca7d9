"""CSV ingest: registry slim Parquet, exclusion normalisation, file pick."""

import csv
import os

import pytest

from claimlens import schemas as S
from claimlens.sources import ingest
from claimlens.sources.tables import load_domain_tables, registry_view


def write_csv(path, header, rows, raw_lines=()):
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for r in rows:
            w.writerow(r)
        for line in raw_lines:
            fh.write(line + "\n")


def registry_csv(path, extra_rows=()):
    header = ["Replacement NPI"] + list(S.REGISTRY_LONG) + ["Other Column"]
    rows = [["", "1000000001", "1", "", "DOE", "JANE", "CA", "90210", "207Q00000X", "01/02/2010", "", "", "z"],
            ["", "1000000002", "2", "ACME", "", "", "TX", "75001", "251E00000X", "3/4/2015", "BOSS", "BIG", "z"]]
    write_csv(path, header, rows + list(extra_rows),
              raw_lines=['"","1000000003","1","too","short"'])
    return path


def test_find_registry_csv(spark, tmp_path):
    d = tmp_path / "nppes_raw" / "sub"
    d.mkdir(parents=True)
    registry_csv(str(d / "npidata_pfile_20050523-20260208.csv"))
    (d / "npidata_pfile_20050523-20260208_FileHeader.csv").write_text("x" * 5000)
    (d / "npidata_pfile_small.csv").write_text("NPI\n1\n")
    (d / "othername_pfile.csv").write_text("y" * 9000)
    found = ingest.find_registry_csv(spark, str(tmp_path / "nppes_raw"))
    assert found.endswith("npidata_pfile_20050523-20260208.csv")


def test_registry_slim_drops_malformed_and_keeps_text(spark, tmp_path):
    src = registry_csv(str(tmp_path / "npidata_pfile_x.csv"))
    out = str(tmp_path / "nppes_slim.parquet")
    ingest.build_registry_slim(spark, src, out)
    df = spark.read.parquet(out)
    assert df.columns == list(S.REGISTRY_LONG)
    reg = registry_view(df)
    rows = {r["npi"]: r for r in reg.collect()}
    assert set(rows) == {"1000000001", "1000000002"}          # short row dropped
    assert rows["1000000002"]["enumeration_date"] == "3/4/2015"
    assert rows["1000000001"]["org_name"] is None
    # built once for its input; another input replaces it
    assert not ingest.build_registry_slim(spark, src, out).built
    other = registry_csv(str(tmp_path / "npidata_pfile_y.csv"),
                         extra_rows=[["", "1000000009", "1", "", "X", "Y", "NY", "1", "t", "01/01/2020",
                                      "", "", "z"]])
    assert ingest.build_registry_slim(spark, other, out).built
    assert spark.read.parquet(out).count() == 3


def test_exclusions_normalised(spark, tmp_path):
    header = list(S.EXCLUSION_COLUMNS)
    rows = [[" smith ", "john ", " q", "0000000000", "1128a1 ", "20190601", "00000000", " ny", " GP "],
            ["DOE", "JANE", "", "0123456789", "1128b4", "20200115", "20220301", "CA", "DENT"],
            ["ROE", "RICH", "", "", "1128a1", "20180101", "0", "tx", ""]]
    src = str(tmp_path / "UPDATED.csv")
    write_csv(src, header, rows, raw_lines=["BAD,ROW"])
    out = str(tmp_path / "leie.parquet")
    ingest.build_exclusions_parquet(spark, src, out)
    got = {r["LASTNAME"]: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {"SMITH", "DOE", "ROE"}
    s = got["SMITH"]
    assert (s["FIRSTNAME"], s["MIDNAME"], s["NPI"], s["REINDATE"], s["STATE"], s["EXCLTYPE"]) == (
        "JOHN", "Q", None, None, "NY", "1128a1")
    assert got["DOE"]["NPI"] == "0123456789"                   # leading zero kept
    assert got["DOE"]["REINDATE"] == "20220301"
    assert got["ROE"]["NPI"] is None and got["ROE"]["REINDATE"] is None
    assert ingest.count_malformed(spark, src) == 1


EXTRA = ["BUSNAME", "GENERAL", "UPIN", "DOB", "ADDRESS", "CITY", "ZIP", "WAIVERDATE", "WVRSTATE"]


@pytest.fixture
def plain(spark):
    """A session without this library's settings."""
    from claimlens.plans.session import SESSION_CONF
    other = spark.newSession()
    for key in SESSION_CONF:
        try:
            other.conf.unset(key)
        except Exception:   # static
            pass
    return other


def test_exclusions_are_picked_by_name(plain, tmp_path):
    wide = [*reversed(S.EXCLUSION_COLUMNS), *EXTRA]
    values = dict(zip(S.EXCLUSION_COLUMNS, ["DOE", "JANE", "Q", "0123456789", "1128b4", "20200115", "0", "CA", "DENT"]))
    rows = [[values.get(c, "other") for c in wide], [values.get(c, "") for c in wide]]
    src = str(tmp_path / "wide.csv")
    write_csv(src, wide, rows, raw_lines=["too,short", ",".join(["x"] * 25)])
    got = ingest.normalize_exclusions(ingest.read_exclusions_csv(plain, src)).collect()
    assert len(wide) == 18 and len(got) == 2
    for r in got:
        assert (r["NPI"], r["EXCLTYPE"], r["LASTNAME"], r["REINDATE"], r["SPECIALTY"]) == ("0123456789", "1128b4", "DOE", None, "DENT")
    write_csv(src, wide[1:], [r[1:] for r in rows])
    with pytest.raises(ValueError, match="SPECIALTY"):
        ingest.read_exclusions_csv(plain, src)


def test_quotes_backslashes_and_malformed_records_in_a_plain_session(plain, tmp_path):
    src = str(tmp_path / "npidata_pfile_q.csv")
    header = list(S.REGISTRY_LONG)
    names = ['ACME "X" LLC', "BAD SLASH\\", "A, B", 'say ""twice""', "plain"]
    rows = [[f"100000000{i}", "2", n, "", "", "CA", "9", "t", "01/01/2010", "B", "C"] for i, n in enumerate(names)]
    write_csv(src, header, rows, raw_lines=['"1000000007","2","too short"', ",".join(["1000000008"] * 14)])
    df = ingest.read_registry_csv(plain, src)
    assert [r[0] for r in df.select(header[2]).orderBy(header[0]).collect()] == names
    assert df.select(header[0]).count() == 5        # malformed records go whatever is selected
    assert ingest.count_malformed(plain, src) == 2


def test_largest_csv_if_no_name_matches(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.csv").write_text("x\n" + "1\n" * 50)
    (tmp_path / "c_FileHeader.csv").write_text("x\n" + "1\n" * 500)
    assert ingest.find_registry_csv(spark, str(tmp_path)).endswith("b.csv")
    with pytest.raises(Exception):
        ingest.find_registry_csv(spark, str(tmp_path / "none"))


def test_domain_layout_roundtrip(spark, tmp_path):
    from tests.fixtures import make_tables
    t = make_tables(spark)
    t.spending.write.parquet(str(tmp_path / "spending.parquet"))
    t.registry.write.parquet(str(tmp_path / "nppes.parquet"))
    t.exclusions.write.parquet(str(tmp_path / "leie.parquet"))
    d = load_domain_tables(spark, str(tmp_path / "spending.parquet"), str(tmp_path / "nppes.parquet"),
                           str(tmp_path / "leie.parquet"))
    assert d.spending.count() == 118 and d.registry.columns == list(S.REGISTRY_SHORT)
    assert os.path.exists(str(tmp_path / "leie.parquet"))
