"""Quality rules as a learned decision list.

``statistics`` measures every whole text. ``learn`` grows rules by sequential
covering on labelled rows: a rule is a conjunction of thresholds on the measures,
grown literal by literal by information gain on two thirds of the rows, pruned on
the last third (literals go from the end while that does not hurt its precision),
and kept if its precision there is high enough; the rows it covers leave, and the
next rule is grown from the rest. ``condition`` writes the ordered rules as one
Spark conditional expression, so scoring stays a projection.

Learning uses at most ``MAX_LABELLED`` labelled rows (a seeded sample by
hash); everything else covers all rows.

Defined results: a null or empty text has all measures 0; without labelled rows, or
with labels of one value alone, there are no rules and every row is accepted; null
labels are left out; a row is measured by itself, so repeated rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from claimlens.llm import _text as t
from claimlens.llm._spark import add_columns, bounded_sample, free_name, stored

#: at most so many labelled rows are read by the learner
MAX_LABELLED = 20_000
WINDOW = 8
SYMBOLS = t.table_of(b"#*$%&|<>")
UPPER = t.table_of(bytes(range(65, 91)))
DIGITS = t.table_of(b"0123456789")
LETTERS = t.table_of(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(192, 256)))
MARKS = t.table_of(b"!?;:,.\"'()[]{}-_=+/\\~^@`")
HEAD = ~t.table_of(bytes(range(128, 192)))      # the first byte of each code point
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_same_words"]


def _measure(block: t.Block) -> list[np.ndarray]:
    data, off = block.data, block.offsets
    starts, ends, first = t.words(data, off, t.NOT_SPACE)
    n_words = first[1:] - first[:-1]
    hashes = t.word_hashes(data, starts, ends)
    word_doc = np.repeat(np.arange(len(block)), n_words)
    # lines: a text's bytes cut at \n; only lines with a word count
    cut = np.flatnonzero(data == 10)
    line_start = np.union1d(off[:-1], cut + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    at_cut = (line_end > line_start) & (data[line_end - 1] == 10) if len(line_start) else np.zeros(0, bool)
    line_end = line_end - at_cut
    line_doc = np.searchsorted(off, line_start, "right") - 1
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[wordy], line_end[wordy], line_doc[wordy]
    _, dup_line = t.repeats(t.inside(t.range_hashes(t.byte_values(data), line_start, line_end), line_doc))
    line_first = np.searchsorted(line_doc, np.arange(len(block) + 1))
    # words in windows of 8 found twice or more in the same text
    at, doc = t.windows(first, WINDOW)
    many, _ = t.repeats(t.inside(t.range_hashes(hashes, at, at + WINDOW), doc))
    repeated = t.cover(at[many], WINDOW, len(starts))
    _, same = t.repeats(t.inside(hashes, word_doc))
    total = lambda table, where=None: t.per_document(table[data] if where is None else table[data] & where, off)
    return [n_words, total(HEAD, t.NOT_SPACE[data]), total(SYMBOLS), t.per_document(dup_line, line_first),
            t.per_document(repeated, first), line_first[1:] - line_first[:-1], total(UPPER), total(LETTERS),
            total(DIGITS), total(MARKS), t.per_document(same, first)]


def statistics(docs: DataFrame, keep: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the measures of its whole texts."""
    names = names or {m: m for m in MEASURES}
    return add_columns(docs, _measure, [StructField(names[m], LongType()) for m in MEASURES], keep)


def _per(a: str, b: str):
    return lambda c: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)


#: what rules may test, as expressions over the measures
FEATURES = {
    "words": lambda c: c["n_words"].cast("double"),
    "word_length": _per("word_chars", "n_words"),
    "symbols_per_word": _per("n_symbols", "n_words"),
    "dup_line_share": _per("n_dup_lines", "n_lines"),
    "repeat_share": _per("n_repeat_words", "n_words"),
    "upper_share": _per("n_upper", "n_letters"),
    "digit_share": _per("n_digits", "word_chars"),
    "marks_per_word": _per("n_marks", "n_words"),
    "same_word_share": _per("n_same_words", "n_words"),
}


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, is_at_least, threshold) holds."""

    literals: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int


def _holds(x: dict[str, np.ndarray], literals, rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    for name, at_least, cut in literals:
        out &= x[name] >= cut if at_least else x[name] < cut
    return out


def _gain(bad0: float, all0: float, bad: np.ndarray, all_: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = bad * (np.log2((bad + 1e-9) / all_) - np.log2((bad0 + 1e-9) / all0))
    return np.where((all_ > 0) & (bad > 0), gain, -np.inf)


def _grow(x, y, rows, cuts, max_literals: int):
    literals, inside = [], rows.copy()
    while len(literals) < max_literals and (~y[inside]).any():
        bad0, all0, best = float(y[inside].sum()), float(inside.sum()), (1e-9, None)
        for name, values in cuts.items():
            v, bad = x[name][inside], y[inside]
            slot = np.searchsorted(values, v, "right")      # v >= values[k] where k < slot
            n_all = np.bincount(slot, minlength=len(values) + 1)[::-1].cumsum()[::-1][1:]
            n_bad = np.bincount(slot, bad, minlength=len(values) + 1)[::-1].cumsum()[::-1][1:]
            for at_least, a, b in ((True, n_bad, n_all), (False, bad0 - n_bad, all0 - n_all)):
                gain = _gain(bad0, all0, a, b)
                k = int(np.argmax(gain)) if len(gain) else -1
                if k >= 0 and gain[k] > best[0]:
                    best = (gain[k], (name, at_least, float(values[k])))
        if best[1] is None:
            break
        literals.append(best[1])
        inside = _holds(x, [best[1]], inside)
    return literals


def learn(rows: list[tuple], names: list[str], min_precision: float = 0.9, min_covered: int = 5,
          max_rules: int = 12, max_literals: int = 4, n_cuts: int = 64) -> list[Rule]:
    """Ordered rules from labelled rows (features in the order of ``names``, then
    True where the row is bad). Rows take part in growing or pruning by their place,
    which is their hash order, so reruns agree."""
    if not rows:
        return []
    table = np.array(rows, float)
    x, y = {n: table[:, i] for i, n in enumerate(names)}, table[:, -1] > 0
    cuts = {}
    for n in names:
        q = np.unique(np.quantile(x[n], np.linspace(0, 1, n_cuts + 2)[1:-1]))
        cuts[n] = q
    prune_set = np.arange(len(y)) % 3 == 2
    left, rules = np.ones(len(y), bool), []

    def worth(literals, among):
        hit = _holds(x, literals, among)
        n, bad = hit.sum(), y[hit].sum()
        return (bad + 1) / (n + 2), int(n)

    while len(rules) < max_rules and y[left & ~prune_set].any():
        literals = _grow(x, y, left & ~prune_set, cuts, max_literals)
        if not literals:
            break
        while len(literals) > 1 and worth(literals[:-1], left & prune_set)[0] >= worth(literals, left & prune_set)[0]:
            literals = literals[:-1]
        hit = _holds(x, literals, left)
        covered, bad = int(hit.sum()), int(y[hit].sum())
        if covered < min_covered or (bad + 1) / (covered + 2) < min_precision or worth(literals, left & prune_set)[0] < min_precision - 0.2:
            break
        rules.append(Rule(tuple(literals), bad / covered, covered))
        left &= ~hit
    return rules


def condition(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The number (from 1) of the first rule that holds, else 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        tests = [FEATURES[n](columns) >= F.lit(c) if at_least else FEATURES[n](columns) < F.lit(c) for n, at_least, c in rule.literals]
        both = tests[0]
        for test in tests[1:]:
            both = both & test
        out = F.when(both, F.lit(k)).otherwise(out)
    return out


def base_failed(columns: dict[str, Column], min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (columns["n_words"] < min_words) | (100 * columns["n_repeat_words"] > repeat_percent * columns["n_words"])


def learn_from(measured: DataFrame, labels: DataFrame, seed: int = 11, limit: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the measured rows (doc_id and measures) that have a label. Rows that
    the base tests reject anyway are left out, so rules speak of the others."""
    columns = {m: F.col(m) for m in MEASURES}
    known = labels.where("quality is not null").select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("bad"))
    rows = (measured.join(known, F.col("doc_id") == F.col("label_id")).where(~base_failed(columns))
            .select(F.xxhash64(F.lit(seed), "doc_id").alias("h"), *[f(columns).alias(n) for n, f in FEATURES.items()],
                    F.col("bad").cast("double").alias("bad")))
    chosen = sorted(map(tuple, bounded_sample(stored(rows, "quality_labelled", labels.count()), "h", limit).collect()))
    return learn([r[1:] for r in chosen], list(FEATURES))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, the rule that rejects (0: none) and kept."""
    measured = stored(statistics(docs.select("doc_id", "text"), ["doc_id"]), "quality_measures")
    rules = learn_from(measured, labels)
    columns = {m: F.col(m) for m in MEASURES}
    return (measured.withColumn("base_failed", base_failed(columns)).withColumn("rule", condition(rules, columns))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that neither the base tests nor the rules reject."""
    rules = learn_from(stored(statistics(docs.select("doc_id", "text"), ["doc_id"]), "quality_measures"), labels)
    names = {m: free_name(docs, f"quality_{m}") for m in MEASURES}
    columns = {m: F.col(n) for m, n in names.items()}
    measured = statistics(docs, names=names)
    return measured.where(~base_failed(columns) & (condition(rules, columns) == 0)).select(*docs.columns)
