"""The registered queries of the training-data operators and their DuckDB SQL.

Each query applies one operator to its whole table with production parameters and
derives the digest columns from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlens.llm import decontaminate, exact_dedup, language_id, merkle, mixing, phrases, pii, quality_rules, record_files, simhash, substring_dedup, suffix_dedup, toxicity
from claimlens.llm._spark import free_name, lower_ascii


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _fold(parts: int):
    """crc32 of doc_id as text, modulo ``parts``. Null for a null doc_id, which is neither
    learnt from nor held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, _fold(3) != 1)
    found = language_id.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.read(record_files.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
                        F.sha2(pii.written("base").cast("binary"), 256).alias("base_sha256"),
                        pii.written(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return simhash.classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, (F.col("n_hit") > 0).alias("contaminated"), "longest_match",
                        F.size("matches").cast("long").alias("n_matches"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), _fold(5) != 0)
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        "worst", "worst_start", "worst_end", F.size("offending").cast("long").alias("n_offending"),
                        F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("offending"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by the crc32 of its id) is tampered with: its text's A-Z in
    lower case. A null doc_id is not tampered with."""
    docs = table(spark, sf_dir, "documents")
    probe = free_name(docs, "probe")
    tampered = F.coalesce(_fold(3) == 0, F.lit(False)) & F.col("text").isNotNull()
    values = {c: F.col(c) for c in merkle.COLUMNS}
    changed = merkle.leaf(list((values | {"text": F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))}).values()))
    found = merkle.proofs(docs.withColumn(probe, changed), keep=["doc_id", probe])
    root = merkle.folded(F.col(f"row.{probe}"), F.col("way"))
    return found.select("row.doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("way")).alias("proof_sha256"),
                        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"), keep=["doc_id"], largest=True)
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.top(table(spark, sf_dir, "documents"))
    return found.select(F.col("of").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

# Water-filling in rounds: each round clamps every source above its limit and shares
# what is left by weight among the others.
_OP7 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         capped OR 3 * source_size * w <= lft * weight
  FROM (SELECT *, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS w,
               sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS lft
        FROM rounds)
  WHERE round < (SELECT count(*) FROM sources)),
filled AS (SELECT * FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST((sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) * weight AS DOUBLE)
                   / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM filled),
runs AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
fits AS (SELECT *, upto <= target - whole * source_size AS fit, target - whole * source_size AS missing FROM runs),
gaps AS (SELECT *, CAST(floor(missing - coalesce(max(CASE WHEN fit THEN upto END) OVER (PARTITION BY source), 0)) AS BIGINT) AS gap FROM fits),
left_over AS (
  SELECT source AS s, size AS z, any_value(gap) AS gap, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS turn
  FROM gaps WHERE NOT fit AND size BETWEEN 1 AND gap GROUP BY source, size),
filled_so_far AS (
  SELECT s, z, turn, least(n, gap // z) AS k, gap - least(n, gap // z) * z AS rest FROM left_over WHERE turn = 1
  UNION ALL
  SELECT l.s, l.z, l.turn, least(l.n, f.rest // l.z), f.rest - least(l.n, f.rest // l.z) * l.z
  FROM filled_so_far f JOIN left_over l ON l.s IS NOT DISTINCT FROM f.s AND l.turn = f.turn + 1),
ranked AS (
  SELECT doc_id, source, size, source_size, target, whole, fit,
         sum(CASE WHEN fit THEN 0 ELSE 1 END) OVER (PARTITION BY source, size ORDER BY hash RANGE UNBOUNDED PRECEDING) AS place
  FROM gaps)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN fit OR place <= k THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked LEFT JOIN filled_so_far ON source IS NOT DISTINCT FROM s AND size = z
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

# crc32 bit by bit: 3988292384 is its polynomial, reversed
_CRC = """xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))))"""


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_OP11 = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN text IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf_sql(_LOWERED)} ELSE {_leaf_sql("text")} END AS probe
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS k, count(*) OVER (PARTITION BY lang) AS size,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed),
nodes AS (
  SELECT 0 AS level, lang, pos, leaf AS digest, size FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8
  FROM nodes WHERE size > 1 GROUP BY level, lang, pos // 8, size),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, pos, digest, size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8
  FROM tops WHERE size > 1 GROUP BY level, pos // 8, size),
runs AS (SELECT level, lang, pos // 8 AS up, list(digest ORDER BY pos) AS d FROM nodes WHERE size > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 8 AS up, list(digest ORDER BY pos) AS d FROM tops WHERE size > 1 GROUP BY ALL),
steps AS (
  SELECT k, level, d, (pos // CAST(8 ** level AS BIGINT)) % 8 AS slot
  FROM leaves l JOIN runs r ON l.lang IS NOT DISTINCT FROM r.lang AND l.pos // CAST(8 ** (level + 1) AS BIGINT) = r.up
  UNION ALL
  SELECT k, 100 + level, d, (s.pos // CAST(8 ** level AS BIGINT)) % 8
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top_runs r ON s.pos // CAST(8 ** (level + 1) AS BIGINT) = r.up),
ways AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY level) AS step,
         coalesce(array_to_string(d[1:slot], ''), '') AS lft, coalesce(array_to_string(d[slot + 2:], ''), '') AS rgt
  FROM steps),
folds AS (
  SELECT k, 0 AS step, probe AS node FROM leaves
  UNION ALL
  SELECT f.k, f.step + 1, sha256(lft || node || rgt) FROM folds f JOIN ways w ON w.k = f.k AND w.step = f.step + 1),
folded AS (SELECT k, arg_max(node, step) AS folded_root FROM folds GROUP BY k),
proofs AS (SELECT k, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof FROM ways GROUP BY k),
root AS (SELECT digest AS root FROM tops WHERE size = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN folded USING (k) LEFT JOIN proofs USING (k) CROSS JOIN root
"""

_OP12 = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWERED} AS norm FROM documents)
"""

_OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
holding AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3),
own AS (
  SELECT c.* FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM holding h WHERE h.lang = c.lang AND h.phrase = c.phrase AND 100 * h.a >= 50 * c.a)),
cuts AS (
  SELECT o.lang, o.phrase, a, cut, x.n AS l, y.n AS r,
         CAST((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM own) o
  JOIN f x ON x.lang = o.lang AND x.phrase = array_to_string(o.w[1:cut], ' ')
  JOIN f y ON y.lang = o.lang AND y.phrase = array_to_string(o.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op7_mixing": _OP7, "op11_merkle_manifest": _OP11, "op12_exact_dedup": _OP12, "op13_phrase_collocations": _OP13}
