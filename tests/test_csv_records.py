"""CSV records with line ends inside quotes, over many splits; kept rejects; outputs that are
built once for their inputs."""

import csv
import os
import random
from collections import Counter

import pytest

from claimlens import schemas as S
from claimlens.sources import commit, csv_records, ingest


@pytest.fixture
def splits(spark):
    """Splits of about 300 bytes, so that records lie across several."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


HEADER = ["id", "name", "note"]


def own_reader(spark, path):
    """Spark's reader of whole files."""
    return (spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
            .option("mode", "DROPMALFORMED").option("columnPruning", "false").csv(path))


def write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh, lineterminator=end, quoting=quoting)
        w.writerow(HEADER)
        w.writerows(rows)
    return str(path)


def some_rows(seed, n=300):
    rng = random.Random(seed)
    parts = ["one", "two\nlines", 'a "quoted" word', ",", "", "\n", "\n\n", "é", "x" * 40, 'tail"', '"', '","', "1\n2\n3\n4\n5 " * 30]
    return [[str(i), "".join(rng.choices(parts, k=rng.randint(0, 3))), rng.choice(parts)] for i in range(n)]


def found(spark, path):
    rows = csv_records.parse(spark, path, HEADER).collect()
    return Counter(tuple(r[c] for c in HEADER) for r in rows if r["_reason"] is None), [r for r in rows if r["_reason"] is not None]


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_whole_file_reader(splits, tmp_path, quoting, end):
    path = write(tmp_path / "a.csv", some_rows(quoting), end, quoting)
    assert csv_records.physical_lines(splits, path).select("block").distinct().count() > 30
    good, bad = found(splits, path)
    assert not bad and good == Counter(tuple(r) for r in own_reader(splits, path).collect()) and sum(good.values()) == 300


def test_a_record_over_several_blocks_and_two_files(splits, tmp_path):
    long = "\n".join(f"line {i}, of one" for i in range(120))
    os.makedirs(tmp_path / "d")
    for k in range(2):
        write(tmp_path / "d" / f"{k}.csv", [["1", "a", long], ["2", long, ""], ["3", "c", "plain"]])
    good, bad = found(splits, str(tmp_path / "d"))
    assert not bad and good == Counter({("1", "a", long): 2, ("2", long, None): 2, ("3", "c", "plain"): 2})


def test_stray_quotes_are_letters_outside_quoted_fields(splits, tmp_path):
    rows = [f'{i},5" pipe,{"six" * 20}' for i in range(40)] + ['50,7",8"', '51,"two\nlines",9"', '52,"say ""hi""\n",x']
    (tmp_path / "s.csv").write_text("\n".join([",".join(HEADER), *rows]) + "\n")
    good, bad = found(splits, str(tmp_path / "s.csv"))
    assert not bad and sum(good.values()) == 43
    assert good[("7", '5" pipe', "six" * 20)] and good[("50", '7"', '8"')] and good[("51", "two\nlines", '9"')] and good[("52", 'say "hi"\n', "x")]


def test_bad_records_are_kept_with_file_and_reason(splits, tmp_path):
    lines = [",".join(HEADER), "1,a,b", "2,short", '3,"x\ny",z', "4,a,b,c,too many", "", '5,"two\nlines, short"', "6,d,e"]
    path = tmp_path / "b.csv"
    path.write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    done = ingest.ingest_csv(splits, str(path), ["note", "id"], out)
    got = splits.read.parquet(out)
    assert (done.built, done.good, done.bad) == (True, 3, 3) and got.columns == ["note", "id"]
    assert {r["id"] for r in got.collect()} == {"1", "3", "6"}
    rejected = ingest.read_rejected(splits, out).collect()
    assert {r["_corrupt_record"] for r in rejected} == {"2,short", "4,a,b,c,too many", '5,"two\nlines, short"'}
    assert all(r["_file"].endswith("b.csv") and r["_reason"] == csv_records.FIELDS for r in rejected)
    with open(path, newline="") as fh:      # good + bad = records of the file
        assert done.good + done.bad == sum(1 for r in csv.reader(fh) if r) - 1


def test_an_open_quote_does_not_gather_the_rest_of_a_file(splits, tmp_path):
    lines = [",".join(HEADER), "1,a,b", '2,"open,c', *[f"{i},text {i},more" for i in range(3, 200)]]
    path = str(tmp_path / "o.csv")
    (tmp_path / "o.csv").write_text("\n".join(lines) + "\n")
    rows = csv_records.parse(splits, path, HEADER, max_bytes=1000).collect()
    bad = [r for r in rows if r["_reason"] is not None]
    assert [r["id"] for r in rows if r["_reason"] is None] == ["1"]
    assert {r["_reason"] for r in bad} == {csv_records.TOO_LONG} and sorted(r["_corrupt_record"] for r in bad) == sorted(lines[2:])


def test_awkward_files(splits, tmp_path):
    for name, text, want in (("only_header", "id,name,note\n", {}), ("no_end", 'id,name,note\n1,a,"b\nc"', {("1", "a", "b\nc"): 1}),
                             ("open_at_the_end", 'id,name,note\n1,a,"b\nc', None), ("blank", "id,name,note\n\n \n1,,\"\"\n", None)):
        (tmp_path / f"{name}.csv").write_text(text)
        good, bad = found(splits, str(tmp_path / f"{name}.csv"))
        if want is None:
            want = Counter(tuple(r) for r in own_reader(splits, str(tmp_path / f"{name}.csv")).collect())
            assert sum(good.values()) + len(bad) == 1
        assert not bad and good == Counter(want), name


def test_registry_with_line_ends_in_names(splits, tmp_path):
    src = tmp_path / "npidata_pfile_n.csv"
    names = ["ACME\nHOLDING", 'THE "BIG"\r\nONE', "plain"]
    with open(src, "w", newline="") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_ALL)
        w.writerow(S.REGISTRY_LONG)
        w.writerows([f"100000000{i}", "2", n, "", "", "CA", "9", "t", "01/01/2010", "B", "C"] for i, n in enumerate(names))
    got = ingest.read_registry_csv(splits, str(src))
    assert sorted(r[2] for r in got.collect()) == sorted(names)


# -- built once


def test_kept_while_the_inputs_are_the_same(spark, tmp_path):
    path, out = write(tmp_path / "a.csv", [["1", "a", "b"]]), str(tmp_path / "out")
    assert ingest.ingest_csv(spark, path, ["id"], out).built
    time = os.stat(next(tmp_path.glob("out/part*"))).st_mtime_ns
    again = ingest.ingest_csv(spark, path, ["id"], out)
    assert (again.built, again.good) == (False, None) and os.stat(next(tmp_path.glob("out/part*"))).st_mtime_ns == time
    assert spark.read.parquet(out).count() == 1         # the manifest is no data


def test_built_again_if_half_written_changed_or_read_otherwise(spark, tmp_path):
    path, out = write(tmp_path / "a.csv", [["1", "a", "b"]]), str(tmp_path / "out")
    os.makedirs(f"{out}/_temporary/0")                  # what a job that died leaves behind
    assert ingest.ingest_csv(spark, path, ["id"], out).built and spark.read.parquet(out).count() == 1
    write(path, [["1", "a", "b"], ["2", "c", "d"]])
    assert ingest.ingest_csv(spark, path, ["id"], out).built and spark.read.parquet(out).count() == 2
    assert ingest.ingest_csv(spark, path, ["id", "name"], out).built and spark.read.parquet(out).columns == ["id", "name"]
    assert not ingest.ingest_csv(spark, path, ["id", "name"], out).built
    other = write(tmp_path / "b.csv", [["9", "a", "b"]])
    assert ingest.ingest_csv(spark, other, ["id", "name"], out).built and spark.read.parquet(out).count() == 1


def test_a_build_that_fails_is_not_committed(spark, tmp_path):
    path, out = write(tmp_path / "a.csv", [["1", "a", "b"]]), str(tmp_path / "out")

    def dies(to):
        spark.range(3).write.mode("overwrite").parquet(to)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        commit.build_once(spark, [path], out, dies)
    assert not commit.is_current(spark, out, commit.inputs_manifest(spark, [path]))
    assert commit.build_once(spark, [path], out, lambda to: spark.range(5).write.mode("overwrite").parquet(to))
    assert commit.is_current(spark, out, commit.inputs_manifest(spark, [path])) and spark.read.parquet(out).count() == 5
    # an output of another kind replaces data and manifest alike
    spark.range(2).write.mode("overwrite").parquet(out)
    assert not commit.is_current(spark, out, commit.inputs_manifest(spark, [path]))
