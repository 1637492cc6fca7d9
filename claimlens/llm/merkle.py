"""A Merkle manifest of a table: a hash tree over its rows, with proofs.

Rows are the leaves of one tree per group, in the order of a key; the groups' roots are
the leaves of a tree of their own. Slot pivot: for each level, one grouping by parent spreads
its children into ``FANOUT`` columns by conditional aggregates; their concatenation,
hashed, is the parent, and leaving out one column gives the siblings of the child in it.

Going up, each level is an eighth of the one below and is stored. Going down, every parent
passes its own way to the root to its children: a child's way is its siblings left
and right, then its parent's. So all proofs together cost joins over an eighth of the rows,
a sixty-fourth, and so on, each on a unique key; no group is gathered, however large.

Digests are SHA-256 in lower-case hex; inputs are concatenated, digests as their hex text. A
leaf hashes its columns in the order given, each ``-`` if null, else its UTF-8 byte count, a
colon and the value (integers in decimal). Where several nodes are left, every 8 in a row
become their hash (the last run may be shorter, even one); a lone leaf is its group's root.

Defined results: null is a group of its own and the first; groups ascend by bytes, rows by
key, a null key first; rows with the same key ascend by leaf, and full repeats stand
next to each other, each with a proof; empty texts are ``0:``; an empty table gives an
empty table; other columns are not hashed, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimlens.llm._spark import numbered, stored

FANOUT = 8
SLOTS = [f"s{k}" for k in range(FANOUT)]
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """The digest of a row."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _joined(slots: list[str]) -> str:
    """SQL: the digests of the slots one after the other; an empty slot is nothing."""
    return "concat(''" + "".join(f", coalesce({s}.digest, '')" for s in slots) + ")"


#: SQL: one struct per slot, its child and what stands beside it
_CHILDREN = "explode(array(" + ", ".join(
    f"named_struct('slot', {k}L, 'child', {s}, 'beside', named_struct('left', {_joined(SLOTS[:k])}, 'right', {_joined(SLOTS[k + 1:])}))"
    for k, s in enumerate(SLOTS)) + ")) AS x"


def _parents(nodes: DataFrame) -> DataFrame:
    """From nodes (tree, pos, size, child), one row per parent: its children in slots, its
    digest, and how many parents its tree has. A tree of one node has no more parents."""
    spread = (nodes.where("size > 1").withColumn("up", F.expr(f"pos div {FANOUT}"))
              .groupBy("tree", "up", "size")
              .agg(*[F.expr(f"first(CASE WHEN pos % {FANOUT} = {k} THEN child END, true) AS {s}") for k, s in enumerate(SLOTS)]))
    return spread.selectExpr("tree", "up AS pos", f"(size + {FANOUT - 1}) div {FANOUT} AS size", f"sha2({_joined(SLOTS)}, 256) AS digest", *SLOTS)


def _grow(leaves: DataFrame, rows: int, trees: int, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of parents, lowest first, and (tree, digest) of the trees' tops."""
    levels, nodes = [], leaves
    tops = leaves.where("size = 1").select("tree", F.col("child.digest").alias("digest"))
    while largest > 1:
        rows, largest = rows // FANOUT + trees, -(-largest // FANOUT)
        level = stored(_parents(nodes), f"{name}_{len(levels)}", rows)
        tops = tops.unionByName(level.where("size = 1").select("tree", "digest"))
        levels.append(level)
        nodes = level.select("tree", "pos", "size", F.struct("digest").alias("child"))
    return levels, tops


def _ways(leaves: DataFrame, levels: list[DataFrame], crown: DataFrame) -> DataFrame:
    """(child, way, top) of every leaf. ``crown`` has for each tree the way from its top
    on, and a struct ``top`` that every leaf gets."""
    lone = leaves.where("size = 1").join(crown, "tree").select("child", "way", "top")
    known = None
    for level in reversed(levels):
        have = level.where("size = 1").join(crown, "tree")
        if known is not None:
            have = have.unionByName(level.where("size > 1").join(known, ["tree", "pos"]))
        spread = have.selectExpr("tree", "pos", "way", "top", _CHILDREN).where("x.child is not null")
        known = spread.selectExpr("tree", f"pos * {FANOUT} + x.slot AS pos", "x.child AS child", "concat(array(x.beside), way) AS way", "top")
        if level is not levels[0]:
            known = known.drop("child")
    return lone if known is None else known.select("child", "way", "top").unionByName(lone)


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id",
           keep: list[str] | None = None) -> DataFrame:
    """A row per row of ``docs``: ``row`` (a struct of its columns ``keep``, default: all but
    the text is best), ``leaf``, ``subroot``, ``root`` and ``way``: from the leaf up to the root, what stands
    left and right of the node in its run. ``folded`` and ``siblings`` read it."""
    keep = list(docs.columns) if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(group).alias("of"), F.col(key).alias("key"),
                       leaf([F.col(c) for c in columns]).alias("digest"))
    placed, trees = numbered(rows, "of", [F.col("key"), F.col("digest")], "merkle_rows")
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows"),
                     F.coalesce(F.max("size"), F.lit(0)).alias("largest")).first()
    leaves = placed.select("tree", "pos", "size", F.struct("digest", "row").alias("child"))
    levels, tops = _grow(leaves, size["rows"], size["trees"], size["largest"], "merkle")

    # the tree of the trees; its only group is 0
    tops = tops.select(F.lit(0).alias("of"), F.col("tree").alias("sub"), "digest")
    placed_tops, _ = numbered(tops, "of", [F.col("sub")], "merkle_tops")
    top_leaves = placed_tops.select("tree", "pos", "size", F.struct("digest", "sub").alias("child"))
    top_levels, root = _grow(top_leaves, size["trees"], 1, size["trees"], "merkle_top")
    way = F.array().cast("array<struct<left:string,right:string>>").alias("way")
    top_ways = _ways(top_leaves, top_levels, root.select("tree", way, F.struct(F.col("digest").alias("root")).alias("top")))
    crown = stored(top_ways.select(F.col("child.sub").alias("tree"), "way",
                                   F.struct(F.col("child.digest").alias("subroot"), F.col("top.root").alias("root")).alias("top")),
                   "merkle_crown", size["trees"])
    return (_ways(leaves, levels, crown)
            .select("child.row", F.col("child.digest").alias("leaf"), "top.subroot", "top.root", "way"))


def siblings(way: Column) -> Column:
    """The digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(digest: Column, way: Column) -> Column:
    """The root that a leaf's digest leads to."""
    return F.aggregate(way, digest, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
