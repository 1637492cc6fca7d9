"""Language, personal data, quality rules, mixing, decontamination and toxicity."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, language_id, mixing, pii, quality_rules, toxicity
from tests.llm import cases

# ---------------------------------------------------------------- decontamination
DW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum(text):
    return DW.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination_brute(texts, items, width=10):
    grams = {}
    for i, s in items:
        w = alnum(s)
        size = min(width, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[a:a + size]), set()).add(str(i))
    sizes, out = {len(g) for g in grams}, {}
    for i, s in texts:
        w, hit, found = alnum(s), set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                g = tuple(w[a:a + size])
                if g in grams:
                    hit.update(range(a, a + size))
                    found |= grams[g]
        out[i] = (len(w), len(hit), len(found), cases.sha(",".join(sorted(found))))
    return out


def matches_brute(texts, items, width=10):
    """{doc_id: [(start, length)]} of the longest match from every word where a window stands, less
    the ones inside a match that began before."""
    stands, out = {}, {}
    for _, s in items:
        w = alnum(s)
        size = min(width, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            stands.setdefault(tuple(w[a:a + size]), []).append((w, a))
    for i, s in texts:
        w, listed, reach = alnum(s), [], 0
        for p in range(len(w)):
            longest = 0
            for size in range(1, width + 1):
                for v, a in stands.get(tuple(w[p:p + size]), []) if p + size <= len(w) else []:
                    n = size
                    while size == width and p + n < len(w) and a + n < len(v) and w[p + n] == v[a + n]:
                        n += 1
                    longest = max(longest, n)
            if p + longest > reach and longest:
                listed.append((p, longest))
                reach = p + longest
        out[i] = listed
    return out


def check_matches(got, texts, items, width=10):
    """Places and lengths by brute force; the named item has those words at the named place."""
    want, words = matches_brute(texts, items, width), {}
    for i, s in items:
        words.setdefault(str(i), []).append(alnum(s))
    text = dict(texts)
    for r in got:
        assert [(m["start"], m["length"]) for m in r["matches"]] == want[r["doc_id"]]
        w = alnum(text[r["doc_id"]])
        for m in r["matches"]:
            a, b, n = m["start"], m["item_start"], m["length"]
            assert any(v[b:b + n] == w[a:a + n] for v in words[m["item_id"]]) and m["item_id"] in r["item_ids"]
        assert r["longest_match"] == max([n for _, n in want[r["doc_id"]]], default=0)


def benchmark_items(texts):
    rng = random.Random(8)
    long = [s for _, s in texts if s and len(s.split()) > 60]
    pick = lambda n: (lambda w, a: " ".join(w[a:a + n]))((w := rng.choice(long).split()), rng.randrange(len(w) - n))
    return ([(k, pick(40)) for k in range(12)] + [(20, pick(10).upper()), (21, pick(3)), (22, "Eaea"), (23, None), (24, ""), (25, "!!"),
            (26, "first line here second"), (27, "nowhere to be found in any of the texts at all my friend"), (28, "Eaea " * 30), (1, pick(12))])


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_contamination_matches_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate.query_blocks, "__defaults__", (block_bytes,))
    texts = cases.awkward_texts()
    items = benchmark_items(texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(cases.documents(spark, texts), bench, keep=["doc_id"]).collect()
    want = contamination_brute(texts, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], cases.sha(",".join(r["item_ids"]))) for r in got} == want
    assert any(v[1] for v in want.values()) and not all(v[1] for v in want.values())
    check_matches(got, texts, items)
    docs = cases.documents(spark, texts)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in want.items() if not v[1])


def test_contamination_longest_match_and_empty_tables(spark):
    rng = random.Random(3)
    item = cases.prose(rng, 30)
    texts = [(1, " ".join(["x", *item[3:25], "y"])), (2, " ".join(item)), (3, "x y")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["longest_match"] for r in decontaminate.matches(cases.documents(spark, texts), bench, keep=["doc_id"]).collect()}
    assert got == {1: 22, 2: 30, 3: 0}
    assert decontaminate.matches(cases.documents(spark, texts), bench.limit(0), keep=["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.matches(cases.documents(spark, []), bench, keep=["doc_id"]).count() == 0


def test_matches_name_item_and_place(spark):
    rng = random.Random(12)
    one, two = cases.prose(rng, 40), cases.prose(rng, 40)
    texts = [(1, " ".join(["zz", *one[5:30], "zz", *two[:12], "zz", *one[20:40]])), (2, None), (3, "zz zz"), (4, " ".join(one + two))]
    items = [(7, " ".join(one)), (8, " ".join(one[5:20])), (9, " ".join(two)), (None, " ".join(two[1:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(cases.documents(spark, texts).withColumn("matches", F.lit(1)), bench).collect()
    check_matches(got, texts, [(k if k is not None else "null", s) for k, s in items])
    by = {r["doc_id"]: r for r in got}
    assert [tuple(m) for m in by[1]["matches"]] == [("7", 1, 25, 5), ("9", 27, 12, 0), ("7", 40, 20, 20)]
    assert by[1]["item_ids"] == ["7", "8", "9", "null"] and by[2]["matches"] == [] == by[3]["item_ids"]
    assert [tuple(m) for m in by[4]["matches"]] == [("7", 0, 40, 0), ("9", 40, 40, 0)]


def test_contamination_by_words_that_repeat_is_bounded(spark):
    rng = random.Random(6)
    tail = cases.prose(rng, 40)
    items = [(1, "0 " * 500), (2, "0 " * 500 + " ".join(tail)), (3, " ".join(["0"] * 4 + tail[:20])), (4, "0 0 0"), (5, "0 1 " * 40)]
    texts = [(1, "0 " * 300_000), (2, "0 " * 700 + " ".join(tail[:30])), (3, "0 0"), (4, " ".join(tail[5:30])), (5, "x " + "0 1 " * 30 + "0 0")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.matches(cases.documents(spark, texts), bench, keep=["doc_id"]).collect()}
    want = contamination_brute(texts, items)
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], cases.sha(",".join(r["item_ids"]))) for i, r in got.items()} == want
    assert {i: r["longest_match"] for i, r in got.items()} == {1: 500, 2: 530, 3: 0, 4: 25, 5: 61}
    assert len(got[1]["matches"]) == 299_501 and [tuple(m)[1:3] for m in got[5]["matches"]] == [(1, 61)]


def test_windows_are_found_once_per_place():
    q = decontaminate._query_block([(k, "0 " * 500) for k in range(20)], 10)
    hashes = np.full(5000, q.hashes[0])
    first = np.array([0, 5000])
    numbered = decontaminate._numbered(hashes)
    found = decontaminate.search(q, hashes, first, numbered, *decontaminate.suffix_array(hashes, first))
    assert len(q.size) == 1 and len(found[1]) == 4991 and found[2].max() == 500


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 3, 300).astype(np.uint64) << np.uint64(60)
    first = np.array([0, 40, 40, 190, 300])
    order, _ = decontaminate.suffix_array(hashes, first)
    stop = np.repeat(first[1:], first[1:] - first[:-1])
    # a hash of zero sorts like the end of a text within one key, so compare from words above zero
    suffix = lambda p: [int(x) + 1 for x in hashes[p:stop[p]]]
    low = [s for s in map(suffix, order)]
    pad = lambda s: s + [1] * (300 - len(s))
    assert sorted(order.tolist()) == list(range(300)) and all(pad(a)[:4] <= pad(b)[:4] for a, b in zip(low, low[1:]))


# ---------------------------------------------------------------- quality rules
def measures_brute(text):
    text = text or ""
    w = cases.words(text)
    lines = [x for x in text.split("\n") if cases.words(x)]
    grams = Counter(tuple(w[a:a + 8]) for a in range(len(w) - 7))
    covered = {a + k for a in range(len(w) - 7) if grams[tuple(w[a:a + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark):
    texts = cases.awkward_texts() + [(None, "a b")]
    docs = cases.documents(spark, texts)
    got = quality_rules.statistics(docs.select("doc_id", "text"), ["doc_id"]).collect()
    assert {r["doc_id"]: tuple(r[m] for m in quality_rules.MEASURES[:5]) for r in got} == {i: measures_brute(s) for i, s in texts}


def quality_tables(spark, n=400):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(n):
        w = cases.prose(rng, rng.randint(30, 120))
        bad = i % 4 == 0
        if bad and i % 8:
            w = [x + rng.choice(["***", "%%%", "&&&"]) for x in w]
        elif bad:
            w = [x.upper() + "!!" for x in w]
        texts.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return texts, spark.createDataFrame(labels + [(5, None, None)], "doc_id long, quality int, toxic int")


def test_rules_reject_the_bad_and_keep_the_good(spark):
    texts, labels = quality_tables(spark)
    docs = cases.documents(spark, texts + [(1000, None), (1001, "short text")])
    got = {r["doc_id"]: r for r in quality_rules.verdicts(docs, labels).collect()}
    assert sum(got[i]["kept"] == bool(i % 4) for i in range(400)) >= 396
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (1000, 1001))
    kept = quality_rules.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_rules_without_labels_accept_all(spark):
    texts, labels = quality_tables(spark, 20)
    docs = cases.documents(spark, texts)
    assert quality_rules.accepted(docs, labels.limit(0)).count() == 20
    assert quality_rules.accepted(docs.limit(0), labels).count() == 0


def test_learned_list_is_ordered_and_explains_planted_rules():
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((a, b, c, float(a > 0.8 or (b < 0.2 and c > 0.5))))
    rules = quality_rules.learn(rows, ["a", "b", "c"])
    table = np.array(rows)
    x = {n: table[:, i] for i, n in enumerate("abc")}
    got = np.zeros(3000, bool)
    for r in rules:
        got |= quality_rules._holds(x, r.literals, np.ones(3000, bool))
    assert (got == (table[:, 3] > 0)).mean() > 0.97
    assert quality_rules.learn([], ["a"]) == []


# ---------------------------------------------------------------- mixing
def fill_brute(sizes, weights, epochs=3):
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: float(epochs * sizes[s]) if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] >= epochs * sizes[s]}
        if not over:
            return target
        full |= over


def mix_tables(seed=2, n=1500):
    rng = random.Random(seed)
    texts = [(i, " ".join(cases.prose(rng, rng.randint(0, 60)))) for i in range(n)] + [(None, "no id here"), (None, None)]
    names = ["a", "B", "é", "z", "", "中", None, "a b"]
    sources = {i: rng.choices(names, [40, 1, 5, 20, 2, 9, 3, 30])[0] for i, _ in texts}
    return texts, sources


def test_mix_fills_to_the_targets(spark):
    texts, sources = mix_tables()
    got = mixing.mixed_words(cases.documents(spark, texts, sources=sources)).collect()
    size, taken, order = Counter(), Counter(), sorted({*sources.values()}, key=lambda s: (s is None, s or ""))
    by_id = {}
    for r in got:
        s = sources[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        by_id.setdefault(s, r["target"])
        assert r["taken"] <= 3 * r["size"]
    assert size == Counter({s: n for s in order if (n := sum(len(cases.words(t)) for i, t in texts if sources[i] == s))})
    target = fill_brute(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in size:
        assert by_id[s] == pytest.approx(target[s])
        assert abs(taken[s] - target[s]) <= max(30, 0.02 * target[s])
        assert sum(1 for r in got if sources[r["doc_id"]] == s and r["source_size"] != size[s]) == 0


def test_mix_leaves_gaps_below_the_smallest_document_left(spark):
    rng = random.Random(8)
    sizes = {i: rng.choice([1, 3, 7, 7, 7, 30, 200]) if rng.random() > 0.05 else rng.randint(500, 5000) for i in range(1, 1200)}
    sources = {i: rng.choices("abcd", [9, 3, 2, 1])[0] for i in sizes}
    got = mixing.mixed_words(cases.documents(spark, [(i, "w " * n) for i, n in sizes.items()], sources=sources)).collect()
    for s in "abcd":
        own = [r for r in got if sources[r["doc_id"]] == s]
        gap = own[0]["target"] - sum(r["taken"] for r in own)
        whole = min(r["taken"] // r["size"] for r in own)
        rest = [r["size"] for r in own if r["taken"] // r["size"] == whole]
        assert 0 <= gap < min(rest), s


def test_mix_keeps_to_gaps_where_ids_repeat(spark):
    """Rows without an id share a hash: a small one fills a gap without the large ones."""
    texts = [(None, "w " * 100)] * 20 + [(None, "w w w")] + [(i, "w " * 50) for i in range(40)]
    sources = {None: "a"} | {i: "ab"[i % 2] for i in range(40)}
    got = mixing.mixed_words(cases.documents(spark, texts, sources=sources)).collect()
    source = lambda r: sources[r["doc_id"]]
    for s in "ab":
        own = [r for r in got if source(r) == s]
        assert sum(r["taken"] for r in own) <= own[0]["target"] + 1e-6
    null = [r for r in got if r["doc_id"] is None]
    assert all(len({r["taken"] for r in null if r["size"] == n}) == 1 for n in (3, 100))


def test_mix_repeats_rows_as_counted_and_reruns_agree(spark):
    texts, sources = mix_tables(4, 300)
    docs = cases.documents(spark, texts, sources=sources)
    counts = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed_words(docs).collect() if r["doc_id"] is not None and r["size"]}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    rows = Counter(r["doc_id"] for r in mixed.collect())
    assert {i: rows[i] for i in counts} == counts
    again = Counter(r["doc_id"] for r in mixing.mix(docs.repartition(7)).collect())
    assert rows == again


def test_mix_of_empty_and_wordless_tables(spark):
    assert mixing.mix(cases.documents(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in mixing.mixed_words(cases.documents(spark, [(1, None), (2, " ")])).collect()] == [(0, 0, 0.0, 0)] * 2


def test_mix_plan_runs_no_python(spark):
    plan = mixing.mix(cases.documents(spark, [(1, "a b")]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


# ---------------------------------------------------------------- language
def language_tables():
    rng = random.Random(3)
    parts = {"en": ["th", "er", "ing", "on", "and"], "de": ["sch", "ein", "ung", "ä", "ver"], "fr": ["eau", "é", "tre", "oui", "ç"]}
    texts, langs = [], {}
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        texts.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 80)))))
        langs[i] = lang
    return texts, langs


def test_language_held_out_accuracy_and_rejection(spark):
    texts, langs = language_tables()
    odd = [(1000, None), (1001, ""), (1002, "123 !! \n"), (1003, "Ж"), (1004, "мир и дом " * 20), (1005, "AND THE " * 30)]
    docs = cases.documents(spark, texts + odd, langs | {i: None for i, _ in odd})
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language_id.learn(docs, fold != 1)
    got = {r["doc_id"]: r for r in language_id.predict(docs.select("doc_id", "text", "n_words"), model, ["doc_id"]).collect()}
    held = [i for i in langs if cases.crc_fold(i, 3) == 1]
    assert len(held) > 50 and sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] in {"en", "de", "fr"} and got[1004]["rejected"]
    assert got[1005]["lang_pred"] == "en"
    assert len(model.owner) == 9


def test_language_without_rows_to_learn(spark):
    docs = cases.documents(spark, [(1, "the and")])
    assert language_id.learn(docs, F.lit(False)) is None
    assert language_id.predict(docs.select("doc_id", "text"), None, ["doc_id"]).first()["lang_pred"] == "und"
    assert language_id.learn(docs.limit(0), F.lit(True)) is None


def test_trigrams_do_not_cross_texts():
    import pyarrow as pa
    from claimlens.llm import _text as t
    batch = lambda texts: pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    many = ["the cat", "", "É été", "x", "ab cd"]
    whole = np.concatenate([c for b in t.blocks(iter([batch(many)])) for _, c in language_id.trigram_counts(b)])
    single = np.concatenate([c for s in many for b in t.blocks(iter([batch([s])])) for _, c in language_id.trigram_counts(b)])
    assert (whole == single).all() and whole.sum(axis=1).tolist() == [7, 0, 8, 1, 5]


# ---------------------------------------------------------------- personal data
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PII_TEXTS = ["mail a.b+c@x-y.example.com, é@b.c d@e f@g.h.i@j.k", "@a.b x@@c.d %@d.e. -@f.g-h", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3",
             "card 4041894974608795 4041 8949 7460 8795 4041-8949-7460-8796 1234567890123456789012", "phone +1 (988) 555-2485 +12 345 +1234567890123456 ++1 234 567 89",
             "日本 +44 20 7946 0958 é ñ 10.0.0.1x y@z.com", "5" * 3000 + " " + "1." * 200, "+1" + " " * 500 + "2", "a" * 3000 + "@", None, ""]


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(7)
    texts = list(enumerate(PII_TEXTS)) + [(100 + k, "".join(rng.choices("ab1290.+- @()é", k=rng.randint(1, 200)))) for k in range(300)]
    got = pii.spans(cases.documents(spark, texts)).collect()
    assert {r["doc_id"]: [(x["start"], x["kind"], x["end"]) for x in r["base"]] for r in got} == {i: spans_brute(s) for i, s in texts}


def test_patterns_find_identifiers_and_leave_others(spark):
    rng = random.Random(5)
    texts = []
    for k in range(120):
        filler = lambda: " ".join(cases.prose(rng, 12))
        number = f"+1 (555) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        if k < 60:
            texts.append((k, f"{filler()} fernruf: {number} {filler()} of {rng.randint(10000, 99999)} {filler()}"))
        elif k < 80:
            texts.append((k, f"{filler()} fernruf: 555-{rng.randint(1000, 9999)} {filler()}"))
        else:
            texts.append((k, f"{filler()} of {rng.randint(10000, 99999)} {filler()} of {number} {filler()}"))
    rows = {r["doc_id"]: r for r in pii.spans(cases.documents(spark, texts)).collect()}
    for k, text in texts:
        found = [(text[x["start"]:x["end"]], x["kind"]) for x in rows[k]["found"]]
        assert found == ([(re.search(r"555-\d+", text)[0], 3)] if 60 <= k < 80 else [])


def test_spaced_numbers_and_bare_addresses_are_found(spark):
    rng = random.Random(9)
    filler = lambda: " ".join(cases.prose(rng, 12))
    digits = lambda n: str(rng.randint(10 ** (n - 1), 10 ** n - 1))
    name = lambda: "".join(rng.choices("abcdefgh", k=9))
    forms = [(lambda: f"{digits(3)} {digits(3)} {digits(3)}", "fernruf", 3), (lambda: f"({digits(3)}) {digits(4)} {digits(4)}", "fernruf", 3),
             (lambda: f"({digits(3)})-{digits(4)}", "fernruf", 3), (lambda: f"{name()}@localhost", "schreib", 0), (lambda: f"{name()}(at)host", "schreib", 0)]
    texts, want = [], {}
    for k in range(300):
        if k < 240:
            word, value = ("fernruf", f"+1 (555) {digits(3)}-{digits(4)}") if k % 2 else ("schreib", f"{name()}@example.org")
        else:
            form, word, kind = forms[k % 5]
            value = form()
            want[k] = [(value, kind)]
        texts.append((k, f"{filler()} {word}: {value} {filler()}"))
    rows = {r["doc_id"]: r for r in pii.spans(cases.documents(spark, texts)).collect()}
    got = {k: [(text[x["start"]:x["end"]], x["kind"]) for x in rows[k]["found"]] for k, text in texts}
    assert got == {k: want.get(k, []) for k, _ in texts}


def test_found_instances_make_patterns_of_their_own(spark):
    rng = random.Random(10)
    filler = lambda: " ".join(cases.prose(rng, 12))
    number = lambda: f"555-{rng.randint(1000, 9999)}"
    texts = [(k, f"{filler()} fernruf: +1 (555) 200-{1000 + k} {filler()}") for k in range(200)]
    texts += [(k, f"{filler()} fernruf: {number()} rueckruf {filler()}") for k in range(200, 220)]
    texts += [(k, f"{filler()} {number()} rueckruf {filler()}") for k in range(220, 224)]
    rows = {r["doc_id"]: r for r in pii.spans(cases.documents(spark, texts)).collect()}
    assert all([x["kind"] for x in rows[k]["found"]] == ([3] if k >= 200 else []) for k, _ in texts)


def test_personal_data_of_an_empty_table(spark):
    assert pii.spans(cases.documents(spark, [])).count() == 0


# ---------------------------------------------------------------- toxicity
def toxic_tables(spark, n=900):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(n):
        sentences = [" ".join(cases.prose(rng, rng.randint(4, 12))) for _ in range(rng.randint(1, 15))]
        toxic = i % 6 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["idiot", "Scum", "MORON"]) + " here"
        texts.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic)))
    return texts, spark.createDataFrame(labels + [(3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_located(spark):
    texts, labels = toxic_tables(spark)
    odd = [(5000, None), (5001, ""), (5002, "..."), (None, "you idiot")]
    docs = cases.documents(spark, texts + odd)
    model = toxicity.learn(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"]).collect()}
    held = [i for i, _ in texts if cases.crc_fold(i, 5) == 0]
    assert sum((got[i]["score"] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert all(got[i]["score"] == 0 and got[i]["worst"] is None for i in (5000, 5001, 5002))
    by_id = dict(texts)
    for i in range(0, 900, 6):
        where = by_id[i].encode()[got[i]["worst_start"]:got[i]["worst_end"]].decode()
        assert re.search("idiot|scum|moron", where, re.I) and "." not in where
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_all_offending_sentences_are_returned(spark):
    from claimlens.llm import _text as t
    hashes = [t.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in (b"idiot", b"scum")]
    model = toxicity.Model(np.sort(np.array(hashes)), np.array([12.0, 12.0]), -6.0)
    texts = [(1, "é you idiot. all is well. Scum you are! fine"), (2, "all is well. fine"), (3, ""), (4, None), (5, "idiot scum")]
    got = {r["doc_id"]: r for r in toxicity.score(cases.documents(spark, texts).select("doc_id", "text"), model, ["doc_id"]).collect()}
    found = {i: [(s or "").encode()[x["start"]:x["end"]].decode() for x in got[i]["offending"]] for i, s in texts}
    assert found == {1: ["é you idiot", "Scum you are"], 2: [], 3: [], 4: [], 5: ["idiot scum"]}
    assert all(x["p"] > 0.99 for r in got.values() for x in r["offending"])
    none = toxicity.score(cases.documents(spark, texts).select("doc_id", "text"), None, ["doc_id"]).collect()
    assert all(r["offending"] == [] for r in none)


def test_toxicity_without_both_labels(spark):
    texts, labels = toxic_tables(spark, 30)
    docs = cases.documents(spark, texts)
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        assert toxicity.learn(docs, some, F.lit(True)) is None
    assert toxicity.score(docs.select("doc_id", "text"), None, ["doc_id"]).agg(F.max("score")).first()[0] == 0


def test_toxicity_learner_is_bounded_in_rows_and_bytes(spark):
    docs = cases.documents(spark, [(1, f"row {k} of one id") for k in range(500)] + [(i, "word " * 100) for i in range(2, 60)] + [(99, "long " * 4000)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (None, 1)] + [(i, i % 2) for i in range(2, 60)] + [(99, 0)], "doc_id long, toxic int")
    rows, sizes = toxicity.sampled(docs, labels, 3, 1000, 16000)
    got = Counter(r["toxic"] for r in rows.collect())
    assert sizes == {True: 30, False: 30}       # an id is one document; one toxic row makes it toxic
    assert got == {True: 30, False: 29}         # all but the text above a sixteenth of the bytes
    few, _ = toxicity.sampled(docs, labels, 3, 1000, 9000)
    assert all(sum(len(r["text"]) for r in few.collect() if r["toxic"] == side) <= 9000 for side in (True, False))
    assert max(Counter(r["toxic"] for r in toxicity.sampled(docs, labels, 3, 8, 16000)[0].collect()).values()) <= 8


def test_toxicity_words_by_the_exact_test():
    from fractions import Fraction
    from math import comb, log
    for k, n, toxic, docs in ((2, 2, 10, 68), (4, 8, 10, 68), (30, 40, 45, 329), (45, 45, 45, 329), (3, 3, 3, 9), (40, 300, 45, 329)):
        want = Fraction(sum(comb(toxic, j) * comb(docs - toxic, n - j) for j in range(k, min(n, toxic) + 1)), comb(docs, n))
        assert toxicity._log_tail(np.array([k]), np.array([n]), toxic, docs)[0] == pytest.approx(log(want), abs=1e-8)


def test_toxicity_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    sentence, feature = np.repeat(np.arange(40), 2), rng.integers(0, 6, 80)
    doc = np.sort(np.arange(40) % 12)
    label = rng.random(12) < 0.4
    weight = np.where(label, 1.0, 3.0)
    w, bias = toxicity.fit(sentence, feature, doc, label, weight, 6, rounds=4000, rate=0.02)

    def loss(v):
        total = sum(v[:-1] ** 2) / (2 * toxicity.SPREAD ** 2 * len(label))
        for d in range(12):
            none = 1.0
            for s in np.flatnonzero(doc == d):
                none *= 1 - 1 / (1 + np.exp(-(v[-1] + v[feature[sentence == s]].sum())))
            total -= weight[d] / weight.sum() * np.log(1 - none if label[d] else none)
        return total

    at = np.append(w, bias)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 2e-3     # the brute-force likelihood is flat there


def test_kept_columns_named_as_added_ones_are_replaced(spark):
    docs = cases.documents(spark, [(1, "a b")]).withColumn("Score", F.lit("old")).withColumn("n_words", F.lit("old"))
    got = toxicity.score(docs, None)
    assert [c for c in got.columns if c.lower() == "score"] == ["score"] and got.first()["score"] == 0
