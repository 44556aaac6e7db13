"""Delimited files with quoted line breaks, read in blocks: one large file keeps every task busy.

A block of lines cannot know whether it begins inside a quoted field. So the first pass finds, for either beginning, how each
block ends; the states at the beginnings follow from these few numbers by running functions over the blocks of a file. The
second pass cuts each block into records; a record that crosses blocks is put together from its pieces. Whether the bytes are
valid UTF-8 is found in the first pass too. Spark's own parser splits the records into fields.

Defined results: rows are those of a multi-line read of the whole file (a quote opens a field only at its beginning, is doubled
inside it, and what follows a closing quote up to the separator belongs to the field); lines end in ``\\n`` or ``\\r\\n``, and
line breaks inside a field stay as they are; empty lines are skipped; a quote that is never closed reaches to the end of its
file; records with too many fields are skipped, missing fields are null; the first record of every file is its header; a compressed file is one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import BROADCAST_ROW_LIMIT, materialise

FALLBACK_ENCODING = "ISO-8859-1"
SURPLUS = "_surplus"
#: The rest of a quoted field up to its closing quote; doubled quotes belong to the field.
_CLOSE = re.compile(rb'(?:[^"]++|"")*+"')


def ends_quoted(line: bytes, quoted: bool, sep: bytes) -> bool:
    """Whether a line that begins inside a quoted field (or not) ends inside one."""
    at, opening = 0, sep + b'"'
    if not quoted:
        if not line.startswith(b'"'):
            at = line.find(opening)
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        closed = _CLOSE.match(line, at)
        if closed is None:
            return True
        at = line.find(opening, closed.end())
        if at < 0:
            return False
        at += 2


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path start line valid`` in the order of the file inside each block."""
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("valid"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The stretches of a batch that belong to one block: path and start, first row, last row (exclusive)."""
    keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True))
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


def block_effects(lines: DataFrame, sep: str) -> DataFrame:
    """``path start plain inside ends valid`` of each block: its last state for either first state (true: quoted),
    whether a record ends in it if it begins quoted, and whether all its lines are valid UTF-8."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, (*block, *state), strict=True))], schema=kinds)

        for batch in batches:
            for key, low, high in _runs(batch):
                if key != block:
                    if block is not None:
                        yield row()
                    block, state = key, (False, True, False, True)
                plain, inside, ends, valid = state
                part = batch.slice(low, high - low)
                # a line without a quote changes no state, but ends a record where it is plain
                for line in part.column("line").filter(pc.match_substring(part.column("line"), '"')):
                    line = line.as_py()
                    plain, inside = ends_quoted(line, plain, mark), ends_quoted(line, inside, mark)
                    ends = ends or not inside
                state = (plain, inside, ends, valid and bool(pc.all(part.column("valid")).as_py()))
        if block is not None:
            yield row()

    names = ["path", "start", "plain", "inside", "ends", "valid"]
    kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), *[(n, pa.bool_()) for n in names[2:]]])
    return lines.mapInArrow(run, "path string, start long, plain boolean, inside boolean, ends boolean, valid boolean")


def block_states(effects: DataFrame) -> DataFrame:
    """``path start quoted chain valid``: the first state of each block, the block in which the record begins that a quoted
    block continues, and whether the file is UTF-8.

    A block either fixes the state (both ends equal), turns it round, or leaves it: the state is the last fixed one, turned
    as often as blocks turned it since. One row per block of a file meets in a window, never a line.
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixes = F.col("plain") == F.col("inside")
    turns = (F.col("plain") & ~F.col("inside")).cast("long")
    turned = effects.withColumn("upto", F.sum(turns).over(order))
    last = F.last(F.when(fixes, F.struct("plain", "upto")), ignorenulls=True).over(before)
    known = turned.withColumn("last", last).withColumn("upto", F.coalesce(F.lag("upto").over(order), F.lit(0)))
    since = F.col("upto") - F.coalesce(F.col("last.upto"), F.lit(0))
    quoted = F.coalesce(F.col("last.plain"), F.lit(False)) != (since % 2 == 1)
    known = known.withColumn("quoted", quoted)
    opens = F.when(F.col("quoted"), F.col("inside") & F.col("ends")).otherwise(F.col("plain"))
    return known.select("path", "start", "quoted", F.last(F.when(opens, F.col("start")), ignorenulls=True).over(before).alias("chain"),
                        F.min("valid").over(Window.partitionBy("path")).alias("utf8"))


def _pieces(lines: DataFrame, sep: str) -> DataFrame:
    """``path start chain head utf8 record``: whole records (``chain`` null) and pieces of records that cross blocks.

    ``head`` marks the record with which a file begins.
    """
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, quoted, chain, begun, head, utf8, held = None, False, None, True, False, True, []

        def row(owner: int | None) -> tuple:
            return (*block, owner, head, utf8, b"\n".join(held))

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

        for batch in batches:
            out = []
            for key, low, high in _runs(batch):
                if key != block:
                    if held:
                        out.append(row(block[1] if begun else chain))
                    block, held, head = key, [], key[1] == 0
                    quoted, chain, utf8 = (batch.column(c)[low].as_py() for c in ("quoted", "chain", "utf8"))
                    begun = not quoted
                for line in batch.column("line").slice(low, high - low).to_pylist():
                    if b'"' in line:
                        quoted = ends_quoted(line, quoted, mark)
                    elif not quoted and line in (b"", b"\r"):
                        continue
                    held.append(line)
                    if not quoted:
                        out.append(row(None if begun else chain))
                        held, begun, head = [], True, False
            if out:
                yield table(out)
        if held:
            yield table([row(block[1] if begun else chain)])

    kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("chain", pa.int64()), ("head", pa.bool_()), ("utf8", pa.bool_()),
                       ("record", pa.binary())])
    return lines.mapInArrow(run, "path string, start long, chain long, head boolean, utf8 boolean, record binary")


def _records(lines: DataFrame, states: DataFrame, sep: str) -> DataFrame:
    """``head utf8 record`` of every record, whatever blocks it crosses."""
    at = states.withColumnsRenamed({"path": "p", "start": "s"})
    here = (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))
    if states.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        placed = lines.join(F.broadcast(at), here)
    else:  # the shuffle loses the order of the lines, so they carry it
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(at.hint("merge"), here).sortWithinPartitions(
            "path", "start", "place")
    pieces = materialise(_pieces(placed.select("path", "start", "line", "quoted", "chain", "utf8"), sep), "csv-records")
    crossing = pieces.where("chain IS NOT NULL").groupBy("path", "chain").agg(
        F.max("head").alias("head"), F.min("utf8").alias("utf8"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("x"))
    # bytes are joined as they are: a character is never cut, since pieces end with lines
    joined = F.aggregate(F.slice("x", 2, F.size("x")), F.col("x")[0]["record"], lambda whole, y: F.concat(whole, F.lit(b"\n"), y["record"]))
    return pieces.where("chain IS NULL").select("head", "utf8", "record").unionByName(crossing.select("head", "utf8", joined.alias("record")))


def read_blocks(spark: SparkSession, path: str | Sequence[str], sep: str = ",", schema: StructType | None = None) -> DataFrame:
    """The rows of delimited files with a header; every file may be read by many tasks, quoted line breaks or not."""
    lines = _lines(spark, path)
    states = materialise(block_states(block_effects(lines, sep)), "csv-blocks")
    options = {"sep": sep, "escape": '"', "multiLine": True}
    if schema is None:
        utf8 = states.agg(F.min("utf8")).first()[0]
        files = path if isinstance(path, str) else list(path)
        names = spark.read.options(**options, header=True, encoding="UTF-8" if utf8 in (True, None) else FALLBACK_ENCODING).csv(files).columns
        # a byte order mark in either decoding
        schema = StructType([StructField(re.sub("^(\ufeff|\u00ef\u00bb\u00bf)", "", n), StringType()) for n in names])
    records = _records(lines.drop("valid"), states, sep).where("NOT head")
    text = F.when(F.col("utf8"), F.col("record").cast("string")).otherwise(F.decode("record", FALLBACK_ENCODING))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    # one column more than the header: it is filled only by a record with too many fields
    fields = records.select(F.from_csv(F.regexp_replace(text, "\r$", ""), f"{kinds}, {SURPLUS} string", options).alias("fields"))
    return fields.select("fields.*").where(F.col(SURPLUS).isNull()).drop(SURPLUS)
