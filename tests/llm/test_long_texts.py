"""Texts longer than a block of the array helpers, in every operator: whole texts count."""

import random

import pytest
from pyspark.sql import functions as F

from claimlens.llm import _text as t
from claimlens.llm import (decontaminate, language_id, mixing, pii, quality_rules, record_files, simhash, substring_dedup, suffix_dedup,
                           toxicity)
from claimlens.llm.queries import tokenizer_path
from tests.llm import cases


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = cases.prose(rng, 380_000) + ["mail", "last.one@example.org", "idiot", "end"]
    long = " ".join(words)
    assert len(long.encode()) > t.BLOCK_BYTES
    return [(1, long), (2, long), (3, " ".join(words[200_000:200_060] + ["tail"])), (4, "short text")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return cases.documents(spark, texts, parts=2).cache()


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_duplicates(docs, texts):
    n = len(texts[0][1].split())
    got = rows(substring_dedup.dedup(docs))
    assert {i: (r["n_words"], r["n_removed"]) for i, r in got.items()} == {1: (n, 0), 2: (n, n), 3: (61, 60), 4: (2, 0)}
    assert got[2]["longest"] == 50 * 2 ** 12 and got[2]["kept_sha256"] == cases.sha("")
    got = rows(suffix_dedup.dedup(docs))
    size = len(texts[0][1].encode())
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"]) == (0, size, 1)
    assert got[3]["n_removed"] >= len(texts[2][1].encode()) - 6 and got[4]["n_removed"] == 0
    prints = rows(simhash.classes(simhash.fingerprints(docs, keep=["doc_id"])))
    assert prints[1]["component_id"] == prints[2]["component_id"] == 1


def test_last_words_are_read(spark, docs, texts):
    n = len(texts[0][1].split())
    bench = spark.createDataFrame([(1, " ".join(texts[0][1].split()[-12:]))], "item_id long, text string")
    got = rows(decontaminate.matches(docs, bench, keep=["doc_id"]))
    assert got[1]["n_hit"] >= 12 and got[2]["n_hit"] >= 12 and got[4]["n_hit"] == 0
    base = rows(pii.spans(docs))
    a = texts[0][1].index("last.one")
    assert [(x["start"], x["end"]) for x in base[1]["base"]] == [(a, a + len("last.one@example.org"))]
    assert rows(quality_rules.statistics(docs.select("doc_id", "text"), ["doc_id"]))[1]["n_words"] == n
    assert rows(mixing.mixed_words(docs))[1]["size"] == n
    model = toxicity.Model(t.word_hashes(*_bytes("idiot")), toxicity.np.array([50.0]), -20.0)
    got = rows(toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"]))
    assert got[1]["score"] > 0.99 and got[4]["score"] < 0.01
    end = got[1]["worst_end"]
    assert texts[0][1].encode()[:end].endswith(b"idiot end")


def _bytes(word):
    data = t.np.frombuffer(word.encode(), t.np.uint8)
    return data, t.np.array([0]), t.np.array([len(data)])


def test_language_and_tokens(spark, docs, texts):
    model = language_id.learn(docs, F.lit(True))
    assert rows(language_id.predict(docs.select("doc_id", "text"), model, ["doc_id"]))[2]["lang_pred"] == "en"
    got = rows(record_files.read(record_files.write(docs, tokenizer_path())))
    assert got[1]["ids_crc32"] == got[2]["ids_crc32"] and got[2]["start"] == got[1]["n_tokens"]
