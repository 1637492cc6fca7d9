"""Language identification by nearest centroids.

A text becomes a TF-IDF vector of its letter trigrams (bytes, lower-cased, hashed to
``FEATURES`` places), of length one. Document frequencies are counted by Spark over all
learning rows. Each language gets several centroids (spherical k-means) from a seeded
sample of at most ``PER_LANGUAGE`` of its texts; a text takes the language of the centroid
with the highest cosine. Each centroid also has a radius: a text farther away than nearly
all of the centroid's own members is marked ``rejected``.

Defined results: null text, or a text without a letter: ``und``, score 0, rejected. Nothing
to learn from: ``und`` for all. Ties go to the language first in code point order. The
prediction reads the text alone; repeated rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from claimlens.llm import _text as t
from claimlens.llm._spark import add_columns, hash_cut, ship, stored

FEATURES = 4096
#: the learner reads at most so many texts of a language
PER_LANGUAGE = 800
CENTROIDS = 3
#: rows of the dense matrix of counts
ROWS = 256
UNKNOWN = "und"

_LETTER = t.table_of(bytes(range(97, 123)) + bytes(range(128, 256)))
_FOLD = np.where(_LETTER[t.LOWER], t.LOWER, 32).astype(np.uint8)


def _folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and the Latin-1 letters after 0xC3), all else a space."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def trigram_counts(block: t.Block):
    """Yields (first row, dense counts) for at most ROWS documents at a time. A text is
    read with a space at both ends, and no trigram reaches into the next text."""
    for lo in range(0, len(block), ROWS):
        off = block.offsets[lo:lo + ROWS + 1]
        docs = len(off) - 1
        data = np.insert(_folded(block.data[off[0]:off[-1]]), off[:-1] - off[0], 32)
        data = np.append(data, np.uint8(32)).astype(np.uint32)
        size = off[1:] - off[:-1] + 1
        doc = np.repeat(np.arange(docs), size)[:max(len(data) - 2, 0)]
        gram = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        ok = np.ones(len(gram), bool)
        last = np.cumsum(size) - 1
        ok[last[last < len(gram)]] = False
        ok &= gram != 0x202020
        place = (gram * np.uint32(2654435761)) >> np.uint32(32 - 12)
        flat = doc[ok] * FEATURES + place[ok]
        yield lo, np.bincount(flat, minlength=docs * FEATURES).reshape(docs, FEATURES).astype(np.float32)


def has_letter(block: t.Block) -> np.ndarray:
    out = t.per_document(t.LETTER_ASCII[block.data], block.offsets) > 0
    for i in np.flatnonzero(~out):
        text = block.data[block.offsets[i]:block.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(c.isalpha() for c in text)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray       # one row each, of length one
    owner: np.ndarray           # the language of each centroid
    floor: np.ndarray           # the cosine below which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.maximum(norm, 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each feature occurs, and the number of texts: each
    task sends one row of sums per feature."""

    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for block in t.blocks(batches):
            for _, counts in trigram_counts(block):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_pydict({"feature": np.arange(FEATURES + 1), "n": np.append(total, n)})

    rows = ship(docs).select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for r in rows:      # FEATURES + 1 rows
        out[r["feature"]] = r["n"]
    return out[:-1], int(out[-1])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean, then the farthest rows."""
    pick = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(pick) < min(k, len(x)):
        pick.append(int(np.argmin((x @ x[pick].T).max(axis=1))))
    c = x[pick]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def learn(docs: DataFrame, learn_from: Column, seed: int = 5, per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model | None:
    """A model from the rows where ``learn_from`` holds and lang and text are not null."""
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    df, n = document_frequencies(known)
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")      # not of the id alone: rows may share one
    cuts = F.create_map(*[F.lit(x) for lang, m in sizes.items() for x in (lang, hash_cut(0.9 * per_language, m))])
    sample = known.where(hashed <= F.element_at(cuts, F.col("lang")))

    def run(batches):
        for block in t.blocks(batches):
            for lo, counts in trigram_counts(block):
                packed = [np.minimum(c, 65535).astype("<u2").tobytes() for c in counts]
                yield pa.RecordBatch.from_pydict({"lang": block.column("lang").slice(lo, len(packed)).cast(pa.string()),
                                                  "counts": pa.array(packed, pa.binary())})

    rows = stored(ship(sample).mapInArrow(run, "lang string, counts binary"), "language_sample").orderBy("lang", "counts").collect()
    model = Model(sorted(sizes, key=lambda s: s.encode()), (np.log((n + 1) / (df + 1)) + 1).astype(np.float32),
                  np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    centroids, owner, floor = [], [], []
    for i, lang in enumerate(model.languages):
        own = [np.frombuffer(r["counts"], "<u2") for r in rows if r["lang"] == lang]
        if not own:
            continue
        x = model.vectors(np.stack(own).astype(np.float32))
        c = _clusters(x, k)
        cos = x @ c.T
        near = cos.argmax(axis=1)
        for j in range(len(c)):
            mine = cos[near == j, j]
            floor.append(0.8 * float(np.quantile(mine, 0.01)) if len(mine) else 1.0)
        centroids.append(c)
        owner += [i] * len(c)
    if not centroids:
        return None
    model.centroids, model.owner, model.floor = np.concatenate(centroids), np.array(owner), np.array(floor)
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (the best cosine) and rejected."""

    def fn(block: t.Block) -> list:
        letters = has_letter(block)
        if model is None:
            letters[:] = False
        lang, score, far = [UNKNOWN] * len(block), np.zeros(len(block)), np.ones(len(block), bool)
        if letters.any():
            for lo, counts in trigram_counts(block):
                cos = model.vectors(counts) @ model.centroids.T
                best = cos.argmax(axis=1)
                value = cos[np.arange(len(best)), best].astype(float)
                for i in np.flatnonzero(letters[lo:lo + len(best)]):
                    lang[lo + i] = model.languages[model.owner[best[i]]]
                    score[lo + i] = min(max(value[i], 0.0), 1.0)
                    far[lo + i] = value[i] < model.floor[best[i]]
        return [pa.array(lang), score, far]

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return add_columns(docs, fn, fields, keep)
