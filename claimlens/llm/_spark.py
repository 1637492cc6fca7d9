"""How the operators of this subpackage meet Spark: per-row functions over
Arrow blocks, and tables written once to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from claimlens.functions.lineage import materialize
from claimlens.llm._text import Block, blocks

#: bits of the document sketch (2 MB): the only thing broadcast that describes
#: documents, and of this size whatever the input
SKETCH_BITS = 1 << 24


#: bytes of one batch sent to a Python worker, however long its rows
BATCH_BYTES = 8 << 20
_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """``df``, after its session has the source of this package to give to the Python
    workers, which need not have it installed. Spark serves the archive from the driver."""
    sc = df.sparkSession.sparkContext
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="claimlens-"), "claimlens_source.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, files in os.walk(os.path.join(top, "claimlens")):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, top))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return df


#: rows per file of a table whose size is known beforehand
FILE_ROWS = 50_000


def stored(df: DataFrame, name: str, at_most: int | None = None, files: int | None = None) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back: lineage
    ends there, so a lost executor costs a re-read. ``at_most``: a bound of its rows,
    if one is known; a small table then gets few files, whatever the number of shuffle
    partitions (a file costs more than its rows). ``files``: a bound of the files themselves."""
    if at_most is not None:
        by_rows = max(1, -(-at_most // FILE_ROWS))
        files = by_rows if files is None else min(files, by_rows)
    if files is not None:
        df = df.coalesce(files)
    return materialize(df, f"llm_{name}")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(docs: DataFrame, fn: Callable[[Block], list], fields: list[StructField],
                keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with the columns that ``fn``
    computes from each block of documents; one that is named as an added column is replaced
    by it. Row by row, so repeated rows, ties and null ids pass through; a null text is an
    empty one."""
    made_here = {f.name.lower() for f in fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made_here]
    schema = StructType([docs.schema[c] for c in keep] + fields)
    names = schema.names
    at = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in fn(block)]
            yield pa.RecordBatch.from_arrays([block.rows.column(i) for i in at] + made, names)

    return ship(docs).mapInArrow(run, schema)


#: maximal runs of removed units, end exclusive
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def add_with_hits(docs: DataFrame, hits: DataFrame, on: dict[str, str], sketch: bytes, slot: str, fn: Callable[[Block], list],
                  fields: list[StructField], keep: list[str]) -> DataFrame:
    """``add_columns`` where each row also has the columns of its row of ``hits`` (``on``: its
    columns by those of ``docs``; nulls where there is none). Rows whose ``slot`` is not in the
    sketch of the hits are judged where they are read; only the others are shuffled."""
    at = docs.columns.index(slot)

    def part(near: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_sketch(sketch, batch.column(at).to_numpy(zero_copy_only=False)) == near))

        return ship(docs).mapInArrow(run, docs.schema)

    met = part(True).join(hits, [F.col(a) == F.col(b) for a, b in on.items()], "left")
    far = part(False).withColumns({f.name: F.lit(None).cast(f.dataType) for f in hits.schema})
    return add_columns(far.unionByName(met), fn, fields, keep)


def emit_rows(docs: DataFrame, fn: Callable[[Block], dict | None], schema: str, text: str = "text") -> DataFrame:
    """Rows that ``fn`` makes of each block (a dict of columns), any number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            made = fn(block)
            if made is not None:
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()})

    return ship(docs).mapInArrow(run, schema)


def _slot(column) -> object:
    return F.pmod(F.xxhash64(column), F.lit(SKETCH_BITS))


def document_sketch(ids: DataFrame, column: str = "doc_id", slot=None) -> bytes:
    """A one-hash Bloom filter over ``ids``: SKETCH_BITS bits, whatever the input.
    It may say yes for an id that is not there, never no for one that is."""
    slot = (_slot(F.col(column)) if slot is None else slot) + 1     # the bitmap functions count from 1
    rows = (ids.groupBy(F.bitmap_bucket_number(slot).alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect())
    out = bytearray(SKETCH_BITS // 8)
    for r in rows:      # at most SKETCH_BITS / 32768 rows of 4 KiB
        bits, at = bytes(r["bits"]), (r["b"] - 1) * 4096
        out[at:at + len(bits)] = bits
    return bytes(out)


def sketch_slot(column) -> object:
    """The bit that ``column`` has in the sketch."""
    return _slot(column)


def hash_sketch(rows: DataFrame, column: str) -> bytes:
    """As ``document_sketch``, of a column that is a hash already: its low bits are its place."""
    return document_sketch(rows, column, F.col(column).bitwiseAND(F.lit(SKETCH_BITS - 1)))


def hash_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64)


def in_sketch(sketch: bytes, slots: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(sketch, np.uint8)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def bounded_sample(df: DataFrame, hashed: str, limit: int) -> DataFrame:
    """A seeded part of ``df`` of about nine tenths of ``limit`` rows, all of it if
    it is smaller: the rows whose 64-bit hash column is below a cut."""
    return df.where(F.col(hashed) <= F.lit(hash_cut(0.9 * limit, df.count())))


def hash_cut(wanted: float, of: int) -> int:
    """The 64-bit hash value up to which about ``wanted`` of ``of`` rows lie (at most all)."""
    return min(int(2 ** 64 * wanted / max(of, 1)), 2 ** 64 - 1) - 2 ** 63


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; a null is empty.
    ``lower`` does just that to plain ASCII, and is the faster way there."""
    text = F.coalesce(text, F.lit(""))
    letters = "".join(map(chr, range(65, 91)))
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, letters, letters.lower())))


#: low bits of monotonically_increasing_id: the place in a partition; above them its number
PLACE_BITS = 33


def numbered(rows: DataFrame, group: str, by: list[Column], name: str, down: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``tree``, ``pos`` and ``size``, a table of the groups): a row's place from
    0 in its group (by the columns ``by``, null first; those with a number in ``down``
    descend, null last), the group's number of rows, and as its name ``tree`` the
    place that its first row has among all rows (groups ascend, null first).

    One range-partitioned sort of all rows, stored; a group may span any number of its
    partitions, so none is ever gathered. Places come from counts per partition and
    group, of which there are at most as many as partitions and groups together. Rows
    that the order leaves tied stand in any order. Rows must not have columns of the added names."""
    held = (rows.select(F.struct("*").alias("row"), F.col(group).alias("g"), F.monotonically_increasing_id().alias("tie"), *[o.alias(f"o{k}") for k, o in enumerate(by)])
            .orderBy(F.col("g").asc_nulls_first(), *[F.desc(f"o{k}") if k in down else F.asc(f"o{k}") for k in range(len(by))], "tie")
            .select("row", "g", F.monotonically_increasing_id().alias("at")))
    held = stored(held.select("row", "g", F.shiftright("at", PLACE_BITS).alias("part"),
                              F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("at")), f"{name}_sorted")
    pieces = held.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    totals = pieces.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # a row per partition of the sort
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("g")
    pieces = (pieces.join(totals, "part").withColumn("begin", F.col("offset") + F.col("first"))
              .select(F.col("part").alias("p"), F.col("g").alias("of"), "first",
                      F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
                      F.sum("n").over(own).alias("size"), F.min("begin").over(own).alias("tree")))
    pieces = stored(pieces, f"{name}_pieces", 1)
    placed = (held.join(pieces, (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("of")))
              .select("row.*", "tree", "size", (F.col("at") - F.col("first") + F.col("earlier")).alias("pos")))
    return placed, pieces.groupBy("tree").agg(F.max("size").alias("size"))
