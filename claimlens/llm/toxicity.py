"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the
words in it; a document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights
are trained from document labels alone, by the gradient of the document likelihood, so
the sentences that carry a label are found in training; ``score`` then names all offending
sentences of each text, those of a probability of ``OFFENDING`` or more, and the worst of all.

Learning reads a seeded sample of each label, of at most ``PER_CLASS`` documents and
``TEXT_BYTES`` of text, weighted back to the share of each label among all labelled ids.
Their ids go to the tasks, and only their texts are shuffled. The words of the model are
those that toxic documents hold more often than chance allows (Fisher's exact test), at a
level at which one word is chosen wrongly on average, however large the sample is.

Defined results: an id that has several label rows is toxic if one of them says so; of several
rows of ``docs`` with that id one is learnt from (the least by the hash of its text).
An empty table gives an empty table. A column of ``docs`` that is kept and named as an added
one is replaced by it. a text without words (null, empty) has no sentence, score 0, span null, no
offending sentence; nor has a text whose sentences all stay below ``OFFENDING``.
Without labels of both values nothing is learned and every score is 0. Null labels are left
out. The score reads the text alone; repeated rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from claimlens.llm import _text as t
from claimlens.llm._spark import add_columns, hash_cut, ship, stored

#: the learner reads at most so many documents of each label
PER_CLASS = 4000
#: and at most so many bytes of their texts, of which no text may have more than a sixteenth
TEXT_BYTES = 8 << 20
#: words in the model at most, and how many of them may be chosen by chance, on average
WORDS, BY_CHANCE = 2048, 1.0
#: standard deviation of the weights before any document is seen
SPREAD = 6.0
#: the probability from which a sentence offends
OFFENDING = 0.5
_STOP = t.table_of(b".!?\n")


def sentences(block: t.Block):
    """Hash, document and sentence number (over the block) of each word; then of each
    sentence with a word its document, first byte and end byte in the block."""
    data = t.LOWER[block.data]
    starts, ends, first = t.words(data, block.offsets, t.ALNUM)
    doc = np.repeat(np.arange(len(block)), first[1:] - first[:-1])
    stops = np.cumsum(_STOP[data])
    new = np.ones(len(starts), bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    return t.word_hashes(data, starts, ends), doc, np.cumsum(new) - 1, doc[at], starts[at], ends[last] if len(at) else at


def _log_tail(k: np.ndarray, n: np.ndarray, toxic: int, docs: int) -> np.ndarray:
    """Log of the chance that ``k`` or more of ``n`` documents drawn from ``docs`` are among the
    ``toxic`` ones, for k above the mean, where the terms fall."""
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, docs + 1)))])
    ways = lambda m, j: fact[m] - fact[j] - fact[m - j]
    first = ways(n, k) + ways(docs - n, toxic - k) - ways(docs, toxic)
    term, total, at, live = np.ones(len(k)), np.ones(len(k)), k.copy(), np.arange(len(k))
    while len(live):
        j = at[live]
        term[live] *= (n[live] - j) * (toxic - j) / ((j + 1) * np.maximum(docs - n[live] - toxic + j + 1, 1))
        total[live] += term[live]
        at[live] += 1
        live = live[term[live] > 1e-12 * total[live]]
    return first + np.log(total)


def chosen_words(word: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The sorted hashes of the at most WORDS words that toxic documents hold most surely
    more often than others, from the (word, document) pairs that occur."""
    words, at = np.unique(word, return_inverse=True)
    pair = np.unique(at * len(label) + doc)
    at, doc = pair // len(label), pair % len(label)
    n, toxic = np.bincount(at, minlength=len(words)), np.bincount(at[label[doc]], minlength=len(words))
    more = np.flatnonzero((toxic > 1) & (toxic * len(label) > n * label.sum()))
    chance = _log_tail(toxic[more], n[more], int(label.sum()), len(label))
    # a word of one document alone cannot tell the labels apart, so it is no trial
    sure = chance <= np.log(BY_CHANCE / max((n > 1).sum(), 1))
    return np.sort(words[more[sure][np.argsort(chance[sure], kind="stable")[:WORDS]]])


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float


def _features(hashes: np.ndarray, sentence: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, feature) pairs of the words that the model knows."""
    if not len(words) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    known = words[at] == hashes
    pair = np.unique(sentence[known] * len(words) + at[known])
    return pair // len(words), pair % len(words)


def _noisy_or(z: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentence probabilities, and log(1 - p) of each document."""
    z = np.clip(z, -30, 30)
    p = 1 / (1 + np.exp(-z))
    return p, np.bincount(doc, -np.logaddexp(0, z), docs)


def fit(sentence: np.ndarray, feature: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray,
        n_words: int, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the weighted document likelihood, with a normal prior on the
    weights, which counts for less the more documents there are. ``sentence`` and ``feature``
    are the pairs that occur; ``doc`` is the document of each sentence."""
    decay = 1 / (SPREAD * SPREAD * max(len(label), 1))
    w, m, v = np.zeros(n_words + 1), np.zeros(n_words + 1), np.zeros(n_words + 1)
    w[-1] = -5.0
    share = weight / weight.sum()
    for k in range(1, rounds + 1):
        z = w[-1] + np.bincount(sentence, w[feature], len(doc))
        p, none = _noisy_or(z, doc, len(label))
        some = np.maximum(-np.expm1(none), 1e-9)
        # d(loss)/dz: p for a clean document, -p (1 - P) / P for a toxic one
        slope = p * share[doc] * np.where(label[doc], -np.exp(none[doc]) / some[doc], 1.0)
        grad = np.append(np.bincount(feature, slope[sentence], n_words) + decay * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w[:-1], float(w[-1])


def sampled(docs: DataFrame, labels: DataFrame, seed: int, per_class: int, text_bytes: int) -> tuple[DataFrame, dict]:
    """(toxic, text) of the documents that are learnt from, and the number of labelled ids
    by label. Within the cut by the hash of the id, texts are taken in the order of that hash
    until their bytes fill the budget."""
    known = stored(labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("label_id"))
                   .agg(F.max(F.col("toxic") != 0).alias("toxic")), "toxic_labels")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    cut = {k: hash_cut(0.9 * per_class, sizes.get(k, 0)) for k in (True, False)}
    drawn = F.xxhash64(F.lit(seed), "label_id")
    # at most about 2 * per_class ids, as each id is there once: small whatever the input
    chosen = known.where(drawn <= F.when(F.col("toxic"), cut[True]).otherwise(cut[False]))
    met = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
           .select("label_id", "toxic", F.coalesce("text", F.lit("")).alias("text")))
    held = met.groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    held = stored(held, "toxic_sample")
    upto = Window.partitionBy("toxic").orderBy("drawn", "id")       # a label's numbers alone, per_class of them
    fits = (held.select(F.col("label_id").alias("id"), "toxic", drawn.alias("drawn"), F.octet_length("text").cast("long").alias("bytes"))
            .where(F.col("bytes") <= text_bytes // 16)
            .withColumn("upto", F.sum("bytes").over(upto)).withColumn("place", F.row_number().over(upto))
            .where((F.col("upto") <= text_bytes) & (F.col("place") <= per_class)))
    return held.join(fits.select("id"), F.col("label_id") == F.col("id")).select("toxic", "text"), sizes


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, seed: int = 3, per_class: int = PER_CLASS,
          text_bytes: int = TEXT_BYTES) -> Model | None:
    """A model from the rows of ``docs`` and ``labels`` where ``learn_from`` (on doc_id) holds."""
    sample, sizes = sampled(docs, labels.where(learn_from), seed, per_class, text_bytes)
    if len(sizes) < 2:
        return None

    def run(batches):
        for block in t.blocks(batches):
            hashes, _, sentence, sentence_doc, *_ = sentences(block)
            order = np.lexsort((hashes, sentence))
            s, h = sentence[order], hashes[order]
            once = np.append(True, (s[1:] != s[:-1]) | (h[1:] != h[:-1]))[:len(s)]
            s, h = s[once], h[once]
            first = np.searchsorted(sentence_doc, np.arange(len(block) + 1))
            at = np.searchsorted(s, first)
            yield pa.RecordBatch.from_pydict({
                "toxic": block.column("toxic"), "n": (first[1:] - first[:-1]).astype(np.int64),
                "s": pa.array([(s[a:b] - c).astype("<i4").tobytes() for a, b, c in zip(at[:-1], at[1:], first[:-1])], pa.binary()),
                "h": pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    # sorted by content, so that reruns sum in the same order
    rows = ship(sample).mapInArrow(run, "toxic boolean, n long, s binary, h binary").collect()
    rows = sorted(rows, key=lambda r: (r["toxic"], r["n"], bytes(r["s"]), bytes(r["h"])))
    label = np.array([r["toxic"] for r in rows], bool)
    if not label.any() or label.all():
        return None
    n = np.array([r["n"] for r in rows], np.int64)
    base = np.cumsum(n) - n
    s = np.concatenate([np.frombuffer(r["s"], "<i4") + b for r, b in zip(rows, base)]).astype(np.int64)
    h = np.concatenate([np.frombuffer(r["h"], "<u8") for r in rows])
    owner = np.repeat(np.arange(len(n)), n)
    weight = np.where(label, sizes[True] / label.sum(), sizes[False] / (~label).sum())
    words = chosen_words(h, owner[s], label)
    s, f = _features(h, s, words)
    return Model(words, *fit(s, f, owner, label, weight, len(words)))


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score; of the worst sentence its probability
    (``worst``) and place in the text's UTF-8 bytes (``worst_start``, ``worst_end``); and
    ``offending``, an array of (start, end, p) of all sentences of OFFENDING or more, in order."""
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("p", DoubleType())])

    def listed(n: int, doc: np.ndarray, first: np.ndarray, last: np.ndarray, p: np.ndarray) -> pa.Array:
        spans = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(p, pa.float64())], span.names)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), spans)

    def fn(block: t.Block) -> list:
        hashes, _, sentence, doc, first, last = sentences(block)
        n = len(block)
        if model is None or not len(doc):
            none = pa.nulls(n, pa.int64())
            nothing = np.zeros(0, np.int64)
            return [np.zeros(n), pa.nulls(n, pa.float64()), none, none, listed(n, nothing, nothing, nothing, nothing.astype(float))]
        s, f = _features(hashes, sentence, model.words)
        p, none = _noisy_or(model.bias + np.bincount(s, model.weights[f], len(doc)), doc, n)
        order = np.lexsort((-np.arange(len(doc)), p, doc))       # the earliest of the worst comes last
        has = np.searchsorted(doc, np.arange(n + 1))
        empty = has[1:] == has[:-1]
        worst = order[np.maximum(has[1:] - 1, 0)]
        bad = np.flatnonzero(p >= OFFENDING)
        at = block.offsets[doc[bad]]
        mask = lambda x, kind: pa.array(x, kind, mask=empty)
        return [np.clip(-np.expm1(none), 0, 1), mask(p[worst], pa.float64()), mask(first[worst] - block.offsets[:-1], pa.int64()),
                mask(last[worst] - block.offsets[:-1], pa.int64()), listed(n, doc[bad], first[bad] - at, last[bad] - at, p[bad])]

    fields = [StructField("score", DoubleType()), StructField("worst", DoubleType()), StructField("worst_start", LongType()), StructField("worst_end", LongType()),
              StructField("offending", ArrayType(span))]
    return add_columns(docs, fn, fields, keep)
