"""Exact dedup, Merkle manifest and phrase mining against plain Python on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import exact_dedup, language_id, merkle, phrases, simhash, substring_dedup
from claimlens.llm._spark import lower_ascii, numbered
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


# -- exact dedup


def exact_brute(rows, largest):
    held = defaultdict(list)
    for i, s in rows:
        held[low(s)].append(i)
    out = []
    for text, ids in held.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        left = 1
        for i in ids:
            out.append((i, best, len(ids), i == best and left > 0, cases.sha(text)))
            left -= i == best
    return Counter(out)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    hot = "The HOT text " * 40
    rows = [(i, hot if rng.random() < 0.5 else hot.lower()) for i in range(300)]
    rows += [(1000 + i, f"Own {i}") for i in range(200)] + [(2000 + i, f"own {i % 50}") for i in range(200)]
    rows += [(None, "lost"), (None, "lost"), (5000, "LOST"), (None, "alone"), (None, "alone")]
    rows += [(6000, None), (6001, ""), (6002, None), (7000, "twice"), (7000, "twice"), (7000, "Twice")]
    rows += [(8000, "É"), (8001, "é"), (8002, "x" * 200_000), (8003, "X" * 200_000), (2 ** 63 - 1, "own 3"), (-5, "own 3")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(spark, copies, largest):
    docs = cases.documents(spark, copies)
    got = exact_dedup.groups(docs, keep=["doc_id"], largest=largest)
    rows = [tuple(r) for r in got.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert Counter(rows) == exact_brute(copies, largest)


def test_a_hot_text_is_sorted_in_pieces(spark, copies):
    docs = cases.documents(spark, copies)
    runs = exact_dedup._runs(docs, ["doc_id"], True)
    hot = runs.where(F.col("piece") >= 0)
    assert hot.count() >= 300 and hot.select("piece").distinct().count() > 3
    assert runs.where("piece < 0 and norm is not null").count() == 0
    plan = docs.groupBy("text").count()._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_unique_keeps_whole_rows_and_names(spark, copies):
    docs = cases.documents(spark, copies).withColumn("piece", F.lit(1)).withColumn("norm", F.lit("n")).withColumn("row", F.lit(2.5))
    left = exact_dedup.unique(docs, largest=True)
    assert left.dtypes == docs.dtypes
    kept = Counter((i, t) for (i, _, _, k, t), n in exact_brute(copies, True).items() if k for _ in range(n))
    assert Counter((r["doc_id"], cases.sha(low(r["text"]))) for r in left.collect()) == kept
    assert exact_dedup.unique(docs.limit(0)).count() == 0


def test_lower_ascii(spark):
    texts = ["ABC xyz", "ÀB éC", "İK ẞ", "", None, "\x00A"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(lower_ascii(F.col("text"))).collect()
    assert [r[0] for r in rows] == [low(t) for t in texts]


# -- places in groups, Merkle manifest


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "zz"]), rng.randint(0, 50)) for _ in range(400)] + [("one", 1)]
    got, trees = numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", [F.col("v")], "test")
    by = defaultdict(list)
    for r in got.collect():
        by[r["g"]].append((r["pos"], r["v"], r["size"], r["tree"]))
    start = 0
    for g in sorted(by, key=lambda g: (g is not None, g or "")):
        mine = sorted(by[g])
        assert [p for p, *_ in mine] == list(range(len(mine))) and [v for _, v, *_ in mine] == sorted(v for x, v in rows if x == g)
        assert {(s, t) for *_, s, t in mine} == {(len(mine), start)}
        start += len(mine)
    assert trees.count() == len(by)


def h(*parts):
    return cases.sha("".join(parts))


def plain_leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way_of(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        out.append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        at //= 8
    return out


def manifest_brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top = tree_levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, x in enumerate(sorted(by[g], key=lambda x: x[:3])):
            way = way_of(trees[g], at) + way_of(top, k)
            row = x[3]
            tampered = row[0] is not None and row[4] is not None and cases.crc_fold(row[0], 3) == 0
            node = plain_leaf((*row[:4], low(row[4]))) if tampered else x[2]
            for left, right in way:
                node = h(left, node, right)
            out.append((row[0], x[2], trees[g][-1][0], top[-1][0], h(*[a + b for a, b in way]), node, node == top[-1][0]))
    return Counter(out)


def manifest_rows(spark, rows):
    """The registered query's columns for a table of rows."""
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    docs = docs.withColumn("pos", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("probe", F.lit(0))
    import claimlens.llm.queries as Q
    was, Q.table = Q.table, lambda *_: docs
    try:
        return Counter(tuple(r) for r in Q.op11_merkle_manifest(spark, "").collect())
    finally:
        Q.table = was


@pytest.mark.parametrize("langs", [["en"], ["en", "de", None, "fr"], [f"l{k}" for k in range(70)]])
def test_manifest(spark, langs):
    rng = random.Random(len(langs))
    rows = [(i, rng.choice(["s", None, "é"]), rng.choice(langs) if i % 3 else langs[0], i, rng.choice([None, "", "Text É " * (i % 5), "low"]))
            for i in rng.sample(range(10_000), 150)]
    rows += [(7, "a", langs[0], 1, "Tie"), (7, "b", langs[0], 1, "Tie"), (7, "b", langs[0], 1, "Tie"), (None, None, None, None, None),
             (None, "x", langs[0], None, "A null id"), (-3, "x", "alone", 2, "X")]
    assert manifest_rows(spark, rows) == manifest_brute(rows)


def test_manifest_of_few_rows(spark):
    for n in (0, 1, 8, 9):
        rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
        assert manifest_rows(spark, rows) == manifest_brute(rows)
    one = manifest_brute([(0, "s", "en", 1, "t")])
    assert next(iter(one))[4] == cases.sha("")      # no siblings


def test_manifest_proofs_verify_and_name_the_tampered(spark):
    rows = [(i, "s", "en" if i % 2 else "de", 3, f"Text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.proofs(docs, keep=["doc_id"]).withColumn("bad", F.concat(F.lit("0"), F.substring("leaf", 2, 63)))
    got = found.select(merkle.folded(F.col("leaf"), F.col("way")).alias("good"), merkle.folded(F.col("bad"), F.col("way")).alias("off"), "root", "leaf", "bad").collect()
    assert all(r["good"] == r["root"] and (r["off"] != r["root"] or r["leaf"] == r["bad"]) for r in got)


# -- phrases


def phrases_brute(rows, threshold=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, size int, phrase string").repartition(4)
    found = phrases.top(docs, **options).select("of", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(9)
    vocab = ["the", "of", "New", "york", "état", "ünï", "a", "kind", "日本", "x" * 70, "it's", "\x01"]
    rows = []
    for _ in range(120):
        words = [rng.choice(vocab) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randint(0, 120))]
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(words)))
    rows += [("en", "new york city"), ("en", None), ("fr", ""), ("de", "nine " * 9), ("de", "ten, ten"), ("en", "NEW YORK " * 3000), ("zz", ". , ;")]
    return rows


def test_phrases(spark, spoken):
    got = phrase_rows(spark, spoken)
    assert got == phrases_brute(spoken) and len(got) > 50
    assert phrase_rows(spark, spoken, most=5) == phrases_brute(spoken, most=5)
    assert phrase_rows(spark, spoken, threshold=25) == phrases_brute(spoken, threshold=25)
    assert phrase_rows(spark, []) == []


def test_phrases_when_counters_and_buffers_are_small(spark, spoken, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 200)
    assert phrase_rows(spark, spoken) == phrases_brute(spoken)


def test_products_beyond_64_bits(spark):
    rows = [("en", 2, "a b", 4_000_000_000, 5_000_000_001, 7_000_000_003)]
    wide = spark.createDataFrame(rows, "of string, size int, phrase string, a long, l long, r long")
    want = 1_000_000 * 4_000_000_000 ** 2 // (5_000_000_001 * 7_000_000_003)
    counts = wide.selectExpr("of", "size", "phrase", "a n").union(wide.selectExpr("of", "1", "'a'", "l")).union(
        wide.selectExpr("of", "1", "'b'", "r")).union(wide.selectExpr("of", "0", "''", "l + r"))
    was, phrases.frequent = phrases.frequent, lambda *_: counts
    try:
        got = phrases.collocations(wide).collect()
    finally:
        phrases.frequent = was
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in got] == [(4_000_000_000, 5_000_000_001, 7_000_000_003, want)]


def test_misra_gries_never_loses_a_frequent_key():
    rng = np.random.default_rng(5)
    for threshold in (5, 10, 40):
        keys = rng.zipf(1.3, 60_000).astype(np.uint64) % 9973
        summary = phrases.MisraGries(len(keys) // threshold + 1)
        for part in np.split(keys, 300):
            k, c = np.unique(part, return_counts=True)
            summary.merge(k.astype(np.uint32), c)
            summary.settle()
        assert summary.taken < threshold and len(summary.keys) <= summary.capacity
        k, c = np.unique(keys, return_counts=True)
        kept = set(summary.keys[summary.counts + summary.taken >= threshold].tolist())
        assert set(k[c >= threshold].tolist()) <= kept


def test_misra_gries_gives_counters_back():
    summary = phrases.MisraGries(3)
    for k in range(20):
        summary.merge(np.array([k, 99], np.uint32), np.array([1, 1]))
        summary.settle()
    assert 99 in summary.keys and summary.taken > 0 and len(summary.keys) <= 3


# -- faults of earlier rounds


def longest_brute(rows, width=50):
    held = [(i, cases.words(s)) for i, s in rows]
    out = {}
    for i, w in held:
        best, size = None, width
        while size <= len(w):
            seen = defaultdict(set)
            for j, x in held:
                for a in range(len(x) - size + 1):
                    seen[tuple(x[a:a + size])].add(j)
            if not any(len(seen[tuple(w[a:a + size])]) > 1 for a in range(len(w) - size + 1)):
                break
            best, size = size, 2 * size
        out[i] = best
    return out


def test_longest_repeat_of_every_length_and_context(spark):
    rng = random.Random(4)
    rows = []
    for length in (49, 50, 99, 100, 101, 200, 230, 400):
        shared = cases.prose(rng, length)
        for _ in range(3 if length == 200 else 2):
            own = cases.prose(rng, 160)
            cut = rng.randrange(160)
            rows.append((len(rows), " ".join(own[:cut] + shared + own[cut:])))
    base = cases.prose(rng, 260)        # different parts shared with different documents
    rows += [(100, " ".join(base)), (101, " ".join(cases.prose(rng, 30) + base[:130])), (102, " ".join(base[90:200] + cases.prose(rng, 30))),
             (103, " ".join(cases.prose(rng, 9) + base[100:260]))]
    got = {r["doc_id"]: r["longest"] for r in substring_dedup.dedup(cases.documents(spark, rows)).collect()}
    assert got == longest_brute(rows) and {50, 100, 200, 400, None} <= set(got.values())


def test_one_of_each_group_whatever_the_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(cases.prose(rng, 60)) for _ in range(4)]
    rows = [(None, texts[0])] * 50 + [(7, texts[1])] * 50 + [(None, texts[2]), (3, texts[2]), (2, texts[2])] + [(None, texts[3]), (None, texts[3] + " ")]
    left = simhash.keep_one(cases.documents(spark, rows))
    assert Counter((r["doc_id"], r["text"].strip()) for r in left.collect()) == Counter([(None, texts[0]), (7, texts[1]), (2, texts[2]), (None, texts[3])])
    assert left.columns == cases.documents(spark, rows).columns


def test_language_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    rows = [(None, " ".join(cases.prose(rng, 20))) for _ in range(1500)]
    docs = cases.documents(spark, rows, clash=False)
    for seed in range(4):
        assert language_id.learn(docs, F.lit(True), seed=seed) is not None
    assert language_id.learn(docs.where("text is null"), F.lit(True)) is None
