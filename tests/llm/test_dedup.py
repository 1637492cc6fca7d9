"""Substring, suffix and SimHash deduplication against plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from claimlens.llm import _text as t
from claimlens.llm import components, simhash, substring_dedup, suffix_dedup
from tests.llm import cases

import numpy as np


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_removal_is_exact(spark, parts):
    texts = cases.awkward_texts()
    got = substring_dedup.dedup(cases.documents(spark, texts, parts=parts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == cases.substring_brute(texts)


def left_by(units, removed):
    """What stays of ``units`` without the runs ``removed``, which are maximal and ascend."""
    gone = [k for r in removed for k in range(r["start"], r["end"])]
    assert gone == sorted(set(gone)) and all(a["end"] < b["start"] for a, b in zip(removed, removed[1:]))
    return [u for k, u in enumerate(units) if k not in set(gone)]


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_texts_and_spans(spark, parts):
    texts = cases.awkward_texts()
    docs = cases.documents(spark, texts, parts=parts).withColumn("kept", F.lit(1)).withColumn("substring_key", F.lit(2))
    found = substring_dedup.deduplicated(docs)
    assert sorted(found.columns) == sorted([*docs.columns, "removed"])
    got, want, text = found.collect(), cases.substring_brute(texts), dict(texts)
    assert len(got) == len(texts) and any(r["removed"] for r in got)
    for r in got:
        n, gone, digest = want[r["doc_id"]]
        assert (sum(x["end"] - x["start"] for x in r["removed"]), cases.sha(r["kept"])) == (gone, digest)
        assert " ".join(left_by(cases.words(text[r["doc_id"]]), r["removed"])) == r["kept"]
        assert r["text"] == text[r["doc_id"]] and r["substring_key"] == 2
    assert substring_dedup.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_texts_and_spans(spark, parts):
    texts = cases.awkward_texts()
    docs = cases.documents(spark, texts, parts=parts).withColumn("removed", F.lit(1))
    got, want, text = suffix_dedup.deduplicated(docs).collect(), cases.suffix_brute(texts), dict(texts)
    assert len(got) == len(texts) and any(r["removed"] for r in got)
    for r in got:
        n, gone, spans, digest = want[r["doc_id"]]
        assert (sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), cases.sha(bytes(r["kept"]))) == (gone, spans, digest)
        assert bytes(left_by((text[r["doc_id"]] or "").encode(), r["removed"])) == bytes(r["kept"])
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_deduplicated_null_ids_and_repeated_rows(spark):
    rng = random.Random(2)
    a = " ".join(cases.prose(rng, 90))
    docs = cases.documents(spark, [(5, a), (5, a), (7, a), (None, a), (None, "")])
    rows = lambda df: sorted((r["doc_id"] or -1, r["text"] == "", len(r["kept"]) == 0) for r in df.collect())
    want = [(-1, False, True), (-1, True, True), (5, False, False), (5, False, False), (7, False, True)]
    assert rows(substring_dedup.deduplicated(docs)) == want == rows(suffix_dedup.deduplicated(docs))


def test_substring_levels_double_until_nothing_survives(spark):
    rng = random.Random(5)
    passage = cases.prose(rng, 1000)
    texts = [(i, " ".join(cases.prose(rng, 30) + passage[:n])) for i, n in enumerate([1000, 1000, 120, 49])]
    got = {r["doc_id"]: r["longest"] for r in substring_dedup.dedup(cases.documents(spark, texts)).collect()}
    assert got == {0: 800, 1: 800, 2: 100, 3: None}


def test_substring_tables_have_few_files_whatever_the_partitions(spark, tmp_path, monkeypatch):
    """As many files as the documents' bytes need: each one that is written starts a process, for
    an instant as large as the JVM beside it."""
    texts = cases.awkward_texts()
    cases.documents(spark, texts, parts=3).write.parquet(str(tmp_path / "documents"))
    made, held = [], substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df, name, *a, **b: made.append((name, held(df, name, *a, **b))) or made[-1][1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 48)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = substring_dedup.dedup(spark.read.parquet(str(tmp_path / "documents"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == cases.substring_brute(texts)
    names = {name for name, _ in made}
    assert {"substring_anchors", "substring_alive", "substring_windows", "substring_repeats", "substring_longer"} <= names
    assert max(len(df.inputFiles()) for _, df in made) <= 8


def test_substring_null_ids_repeated_rows_and_empty_table(spark):
    rng = random.Random(2)
    a, b = " ".join(cases.prose(rng, 90)), " ".join(cases.prose(rng, 90))
    texts = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.dedup(cases.documents(spark, texts)).collect())
    # equal rows do not remove each other; a null id is the largest; null ids do not remove each other's words
    assert got == [(-1, 0), (-1, 0), (-1, 90), (5, 0), (5, 0), (7, 90)]
    assert substring_dedup.dedup(cases.documents(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_removal_is_exact(spark, parts):
    texts = cases.awkward_texts(3)
    got = suffix_dedup.dedup(cases.documents(spark, texts, parts=parts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == cases.suffix_brute(texts)


def test_suffix_crowded_anchor_is_split_and_joined_again(spark, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(cases.prose(rng, 25))
    texts = [(i, " ".join(cases.prose(rng, 12)) + " " + passage + " " + " ".join(cases.prose(rng, 12))) for i in range(60)]
    texts += [(100 + i, s) for i, s in texts[:20]]
    monkeypatch.setattr(suffix_dedup, "CROWD", 8)
    monkeypatch.setattr(suffix_dedup, "BATCH", 16)
    got = suffix_dedup.dedup(cases.documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == cases.suffix_brute(texts)


def test_suffix_null_ids_repeated_rows_and_empty_table(spark):
    rng = random.Random(2)
    a = " ".join(cases.prose(rng, 60))
    n = len(a.encode())
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup.dedup(cases.documents(spark, [(5, a), (5, a), (7, a), (None, a)])).collect())
    assert got == [(-1, n), (5, 0), (5, 0), (7, n)]
    assert suffix_dedup.dedup(cases.documents(spark, [])).count() == 0


def test_suffix_different_texts_under_one_id(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(cases.prose(rng, k)) for k in (60, 90, 70, 40))
    twice = c + "|" + d + "|" + c
    texts = [(3, a), (5, a), (5, b), (6, twice), (6, d + "!" + c), (6, d + "!" + c)]
    want = sorted(v for k, s in set(texts) for v in [(k, *cases.suffix_brute([(0, a), (k, s)] if k == 5 else [(k, s)])[k])])
    want += [x for x in want if x[:2] == (6, len((d + "!" + c).encode()))]
    got = suffix_dedup.dedup(cases.documents(spark, texts)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["n_bytes"]: r["n_removed"] for r in got if r["doc_id"] == 5} == {len(a.encode()): len(a.encode()), len(b.encode()): 0}
    assert max(r["n_removed"] for r in got if r["doc_id"] == 6) == len(c.encode())


def test_classes_of_the_construction_match_brute_force():
    rng = np.random.default_rng(0)
    width, seed = 6, 3
    group = np.sort(rng.integers(0, 4, 60))
    back = rng.integers(0, width - seed + 1, 60)
    n = np.array([rng.integers(1, b + 2) for b in back])
    data = [bytes(rng.integers(97, 99, k + width - 1).astype(np.uint8)) for k in n]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    rank = rng.permutation(60)
    got = suffix_dedup.classes(group, back, n, np.frombuffer(b"".join(data), np.uint8), offsets, rank, width, seed)
    reach = width - seed
    for i in range(60):
        for c in range(-reach, 1):
            if -back[i] <= c < n[i] - back[i]:
                window = data[i][back[i] + c: back[i] + c + width]
                same = [rank[j] for j in range(60) if group[j] == group[i] and -back[j] <= c < n[j] - back[j]
                        and data[j][back[j] + c: back[j] + c + width] == window]
                assert got[i, c + reach] == min(same)
            else:
                assert got[i, c + reach] == -1


def plain_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = cases.words(w)
    if not w:
        return 0
    size = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + size]), 42) for i in range(len(w) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_plain_python(spark):
    texts = cases.awkward_texts()
    got = simhash.fingerprints(cases.documents(spark, texts), keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["fingerprint"] % 2 ** 64 for r in got} == {i: plain_fingerprint(s) for i, s in texts}


def test_spark_hashes_a_shingle_the_same(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(F.xxhash64(F.lit("a bé c"))).first()[0]
    assert got % 2 ** 64 == xxhash.xxh64_intdigest("a bé c", 42)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def _brute_components(prints):
    nodes, root = sorted(set(prints.values())), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(least.get(find(p), d), d)
    return {d: least[find(p)] for d, p in prints.items()}


@pytest.mark.parametrize("bucket", [64, 2])
def test_classes_match_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, bucket))
    rng = random.Random(9)
    prints, base = {}, [rng.getrandbits(64) for _ in range(30)]
    for d in range(400):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        base.append(x)
        prints[d] = x
    prints |= {1000: 0, 1001: 0, 1002: 3, 1003: 1 << 63}
    rows = [(d, p - 2 ** 64 if p >> 63 else p) for d, p in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df).collect()}
    assert got == _brute_components(prints)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["least"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{500 + i: 500 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_keeps_the_least_id_of_each_group(spark):
    texts = cases.awkward_texts() + [(None, "one"), (None, "alone among words here")]
    docs = cases.documents(spark, texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = {i: plain_fingerprint(s) for i, s in texts if i is not None}
    groups = _brute_components(prints)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in groups if groups[i] == i)
    assert ids.count(None) == 1
    assert simhash.keep_one(cases.documents(spark, [])).count() == 0


def test_windows_never_reach_into_the_next_document():
    data = np.frombuffer(b"aa bb" + b"" + b"cc" + b" dd ", np.uint8)
    offsets = np.array([0, 5, 5, 7, 11])
    starts, ends, first = t.words(data, offsets, t.NOT_SPACE)
    assert first.tolist() == [0, 2, 2, 3, 4] and starts.tolist() == [0, 3, 5, 8] and ends.tolist() == [2, 5, 7, 10]
    assert t.windows(first, 2)[0].tolist() == [0]
