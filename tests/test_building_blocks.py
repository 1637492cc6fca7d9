"""Quantiles, global ranking, column helpers."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from claimlens.functions.columns import entity_label, in_code_ranges, mdy_to_iso, provider_name
from claimlens.functions.quantiles import group_quantiles
from claimlens.functions.ranking import global_rank


def test_exact_distributed_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    rows = []
    sizes = {"hot": 5000, "a": 1, "b": 2, "c": 37, "d": 400}
    for g, n in sizes.items():
        for _ in range(n):
            # heavy ties in the hot group, continuous elsewhere
            v = float(rnd.randint(0, 50)) if g == "hot" else rnd.lognormvariate(8, 2)
            rows.append((g, v))
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.01, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(qs))]
    for method in ("builtin", "exact"):
        out = {r["g"]: r for r in group_quantiles(df, ["g"], "v", qs, names, method=method).collect()}
        for g, n in sizes.items():
            vals = np.array([v for gg, v in rows if gg == g])
            assert out[g]["n"] == n
            for q, name in zip(qs, names):
                assert out[g][name] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12), (method, g, q)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_quantiles_do_not_depend_on_partitions_or_hot_groups(spark, partitions):
    rnd = random.Random(1)
    rows = [("hot" if i % 10 else f"g{i % 7}", float(rnd.randint(0, 10_000))) for i in range(20_000)] + [("hot", None)] * 5 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    out = {r["g"]: r for r in group_quantiles(df, ["g"], "v", [0.5, 0.99], ["m", "p"]).collect()}
    hot = np.array([v for g, v in rows if g == "hot" and v is not None])
    assert (out["hot"]["n"], out["hot"]["m"], out["hot"]["p"]) == (
        len(hot) + 5, pytest.approx(np.quantile(hot, 0.5)), pytest.approx(np.quantile(hot, 0.99)))
    assert tuple(out["none"]) == ("none", 1, None, None)


def test_global_rank_loses_nothing_on_wide_rows(spark):
    n = 200_000
    df = (spark.range(n).repartition(50)
          .selectExpr("id", "cast(pmod(hash(id), 1000) as int) AS score", "repeat(sha2(cast(id as string), 256), 10) AS payload"))
    ranked = global_rank(df, [F.desc("score"), F.asc("id")], "rank")
    s = ranked.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_distinct("id")).first()
    assert tuple(s) == (n, n, 1, n, n)
    order = Window.orderBy("rank")
    wrong = (ranked.select("rank", "score", "id").withColumn("s0", F.lag("score").over(order)).withColumn("i0", F.lag("id").over(order))
             .where("s0 < score or (s0 = score and i0 > id)"))
    assert wrong.count() == 0


def test_global_rank_is_dense_and_ordered(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, score int").repartition(7)
    ranked = global_rank(df, [F.desc("score"), F.asc("id")], "rank").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = sorted(ranked, key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [(r["id"], r["score"]) for r in got] == expected


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [("1", None, "John", " DOE ", "1/5/2020", "T1020"),
         ("2", "ACME", None, None, "13/45/2020", "T1023"),
         ("9", "", None, None, "", "G0300"),
         (None, None, None, None, None, "S9122")],
        "e string, org string, first string, last string, d string, code string")
    out = df.select(provider_name("org", "first", "last").alias("name"),
                    entity_label("e").alias("et"), mdy_to_iso("d").alias("iso"),
                    in_code_ranges("code", [("G0151", "G0162"), ("G0299", "G0300"), ("S9122", "S9124"),
                                            ("T1019", "T1022")]).alias("hh")).collect()
    assert [r["name"] for r in out] == ["John  DOE", "ACME", "UNKNOWN", "UNKNOWN"]
    assert [r["et"] for r in out] == ["individual", "organization", "9", "unknown"]
    assert [r["iso"] for r in out] == ["2020-01-05", None, None, None]
    assert [r["hh"] for r in out] == [True, False, True, True]


# -- sketches of quantiles


def test_sketches_merge_upwards_within_their_bound(spark):
    from claimlens.functions import sketches
    rng = random.Random(11)
    values = [("big", rng.lognormvariate(5, 2)) for _ in range(60_000)] + [(f"g{i % 7}", float(i)) for i in range(7_000)]
    values += [("same", 3.0)] * 500 + [("none", None)] * 20
    df = spark.createDataFrame(values, "g string, v double").repartition(6)
    fine = sketches.group_sketches(df, ["g"], "v")
    quantiles, names = [0.01, 0.5, 0.99], ["q1", "q50", "q99"]
    got = {r["g"]: r for r in sketches.sketch_quantiles(fine, quantiles, names).collect()}
    everything = sketches.sketch_quantiles(sketches.merged_sketches(fine, []), quantiles, names).first()
    held = {g: sorted(v for x, v in values if x == g and v is not None) for g in got}
    held["all"] = sorted(v for _, v in values if v is not None)
    for g, row in [*got.items(), ("all", everything)]:
        assert row["members"] == (len(values) if g == "all" else sum(x == g for x, _ in values))
        assert len(row["sketch"]) < 30_000
        for q, name in zip(quantiles, names):
            if g == "none":
                assert row[name] is None
                continue
            below, upto = bisect.bisect_left(held[g], row[name]) / len(held[g]), bisect.bisect_right(held[g], row[name]) / len(held[g])
            assert below - sketches.RANK_ERROR <= q <= upto + sketches.RANK_ERROR, (g, q)
