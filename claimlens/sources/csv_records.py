"""CSV records that may hold line ends inside quotes, from files that stay split.

Spark's own multi-line reader takes a whole file in one task. Here files are read as lines,
in blocks of any size, and only the lines around a quoted line end are put together:

1. Each line says what it does to the state "inside quotes": whether a record is open after it
   if it began outside (``open0``) and if it began inside (``open1``). Most lines leave the
   state alone; the others are events. A quote within an unquoted field is a letter.
2. The events of a block, one after the other, say the same of the block; a running
   composition over the blocks of a file (one row each) gives the state each begins in. Two
   states only, so it is a matter of the last block that sets the state and of how many
   have turned it since.
3. A block without events that begins outside has whole records. In the others, the same
   composition over lines finds where records begin, and the lines of one record are joined,
   also across blocks.

Records then go to ``from_csv``: a record with too few or too many fields is malformed, and
comes back with its text, its file and a reason instead of its values. So does every line of a
record that runs on for more than ``MAX_RECORD_BYTES``: a quote was left open there.

Defined results: blank lines and lines equal to the header are skipped, a carriage return
before a line end belongs to the line end (inside quotes it is kept), empty fields are as
in Spark's reader, and a quote still open at the end of a file closes there. Every other record is either good or bad.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimlens.functions.lineage import materialize

#: a longer record is taken for a quote that was never closed
MAX_RECORD_BYTES = 1 << 20

# what the parser is told, for the header and for the records
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}

# a whole quoted field, and the rest of one up to its closing quote
_FIELD = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|\r?\z)'
_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"(?=,|\r?\z)'

TOO_LONG = "quote not closed"
FIELDS = "wrong number of fields"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): ``at`` ascends within a block, a split of a file."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))


def _left_open(text: Column) -> Column:
    return F.regexp_replace(text, _FIELD, "$1").rlike('(^|,)"')


def with_effect(lines: DataFrame) -> DataFrame:
    """Adds ``open0`` and ``open1``."""
    line = F.col("line")
    quoted = F.instr(line, '"') > 0
    return lines.withColumns({
        "open0": F.when(quoted, _left_open(line)).otherwise(F.lit(False)),
        "open1": F.when(quoted & line.rlike(_CLOSING), _left_open(F.regexp_replace(line, _CLOSING, ""))).otherwise(F.lit(True))})


def _begins_open(effects: DataFrame, keys: list[str], order: str, start: Column, name: str) -> DataFrame:
    """Adds ``name``, the state before each row: ``start`` (of its keys), then what the rows
    before it do. A row sets the state (open0 = open1), turns it, or leaves it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)
    counted = effects.withColumns({"turns": F.sum(turn).over(upto), "earlier": F.coalesce(F.sum(turn).over(before), F.lit(0))})
    last = F.last(F.when(F.col("open0") == F.col("open1"), F.struct(F.col("open0").alias("value"), F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    counted = counted.withColumn("set", last)
    since = F.col("earlier") - F.coalesce(F.col("set.turns"), F.lit(0))
    value = F.coalesce(F.col("set.value"), start)
    return counted.withColumn(name, F.when(since % 2 == 1, ~value).otherwise(value)).drop("turns", "earlier", "set")


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, events, begins): each block's number of events and the state it begins in."""
    event = F.col("open0") | ~F.col("open1")
    found = F.array_sort(F.collect_list(F.when(event, F.struct("at", "open0", "open1"))))
    per_block = lines.groupBy("file", "block").agg(found.alias("found"))
    step = lambda was, x: F.when(was, x["open1"]).otherwise(x["open0"])
    effects = per_block.select("file", "block", F.size("found").alias("events"),
                               F.aggregate("found", F.lit(False), step).alias("open0"), F.aggregate("found", F.lit(True), step).alias("open1"))
    return _begins_open(effects, ["file"], "block", F.lit(False), "begins").select("file", "block", "events", "begins")


def records(spark: SparkSession, path: str, max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """(file, text, reason) of every record; ``reason`` is set where a line is no record."""
    lines = with_effect(physical_lines(spark, path))
    blocks = materialize(_blocks(lines), "csv_blocks")      # one row per split of a file
    whole = F.lit(None).cast("string").alias("reason")
    joined = lines.join(blocks, ["file", "block"])
    woven = F.col("begins") | (F.col("events") > 0)
    plain = joined.where(~woven).select("file", F.col("line").alias("text"), whole)
    if blocks.where(woven).isEmpty():
        return plain

    placed = _begins_open(joined.where(woven), ["file", "block"], "at", F.col("begins"), "inside")
    ends = F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0"))
    own = F.max(F.when(~F.col("inside"), F.col("at"))).over(
        Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = materialize(placed.select("file", "block", "at", "line", "inside", ends.alias("ends"), own.alias("record")), "csv_lines")
    # lines before a block's first record belong to the last record of the blocks before it
    tails = placed.groupBy("file", "block").agg(F.max("record").alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("file", "block", F.last("tail", ignorenulls=True).over(earlier).alias("open"))
    single = placed.where("not inside and not ends").select("file", F.col("line").alias("text"), whole)
    several = (placed.where("inside or ends").join(tails, ["file", "block"])
               .select("file", "block", "at", "line", F.coalesce("record", "open").alias("record")))
    size = F.sum(F.octet_length("line").cast("long") + 1)
    long = several.groupBy("file", "record").agg(size.alias("size")).where(F.col("size") > max_bytes).select("file", "record")
    long = materialize(long, "csv_long")                    # at most one per max_bytes of text
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    put = (several.join(long, ["file", "record"], "left_anti").groupBy("file", "record").agg(parts.alias("parts"))
           .select("file", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("text"), whole))
    lost = several.join(long, ["file", "record"], "left_semi").select("file", F.col("line").alias("text"), F.lit(TOO_LONG).alias("reason"))
    return plain.unionByName(single).unionByName(put).unionByName(lost)


def header(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """The column names of the first record, and its text."""
    columns = spark.read.options(**OPTIONS | {"multiLine": "false"}).option("header", "true").csv(path).columns
    return columns, spark.read.text(path).first()["value"]


def parse(spark: SparkSession, path: str, columns: Sequence[str], max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """One row per record: the named columns as text, wherever they stand in the file, and
    ``_corrupt_record`` (its text), ``_reason`` and ``_file``. A bad record has no values."""
    names, first = header(spark, path)
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    text = F.regexp_replace("text", r"\r\z", "")
    rows = (records(spark, path, max_bytes).withColumn("text", text)
            .where((F.trim("text") != "") & (F.col("text") != F.lit(first))))
    schema = ", ".join([*(f"c{k} STRING" for k in range(len(names))), "_corrupt_record STRING"])
    options = OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = rows.select("file", "text", "reason", F.from_csv("text", schema, options).alias("r"))
    bad = F.col("reason").isNotNull() | F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return read.select(
        *[F.when(~bad, F.col(f"r.c{names.index(c)}")).alias(c) for c in columns],
        F.when(bad, F.col("text")).alias("_corrupt_record"),
        F.when(bad, F.coalesce("reason", F.lit(FIELDS))).alias("_reason"), F.col("file").alias("_file"))
