"""Rows in shuffled orders: each row of a table beside the row that stands at its position in an order of MD5 keys.

Rows are packed once. Each order is dealt from the packed rows by the leading bits of its keys, so that neither a key nor a row
is a row of a shuffle, and a key is made once for an order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise

#: Rows packed together, and rows that a task deals out at once.
PACKED_ROWS, DEALT_ROWS = 1 << 18, 1 << 20
#: Messages that are hashed together, and bytes of a message that fit one block.
_TILE, _BLOCK = 8192, 55
_TURNS = [s for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turn * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_words(prefix: bytes, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of ``prefix`` followed by each text, as two numbers in the order of the digests."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out = np.empty((len(texts), 2), ">u8")
    sizes = np.diff(at)
    for row in np.flatnonzero(sizes + len(prefix) > _BLOCK).tolist():
        digest = hashlib.md5(prefix + data[at[row]: at[row + 1]].tobytes(), usedforsecurity=False).digest()
        out[row] = np.frombuffer(digest, ">u8")
    short = np.flatnonzero(sizes + len(prefix) <= _BLOCK)
    for i in range(0, len(short), _TILE):
        rows = short[i: i + _TILE]
        blocks = np.zeros((len(rows), 64), np.uint8)
        blocks[:, :len(prefix)] = np.frombuffer(prefix, np.uint8)
        for size in np.unique(sizes[rows]).tolist():
            same = np.flatnonzero(sizes[rows] == size)
            end = len(prefix) + size
            blocks[same, len(prefix): end] = data[at[rows[same], None] + np.arange(size)]
            blocks[same, end] = 0x80
            blocks[same, 56: 58] = np.frombuffer((8 * end).to_bytes(2, "little"), np.uint8)
        out[rows] = _digests(np.ascontiguousarray(blocks.view("<u4").T)).view(">u8")
    return out[:, 0].astype(np.uint64), out[:, 1].astype(np.uint64)


def _digests(words: np.ndarray) -> np.ndarray:
    """MD5 of messages of one padded block each; ``words`` has a row for each of the 16 words."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, rest = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            g = 7 * i % 16
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        np.add(f, _SINES[i], f)
        np.add(f, words[g], f)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), rest)
        np.left_shift(f, np.uint32(_TURNS[i]), f)
        np.bitwise_or(f, rest, f)
        np.add(f, b, f)
        # the buffer of the word that is used up holds the next sum
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + s for x, s in zip((a, b, c, d), _START, strict=True)], axis=1).astype("<u4")


def _closed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1), use_threads=False)
    with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(blobs) -> list[pa.Table]:
    return [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]


def _dealt(table: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``bucket n rows``: the rows of each bucket packed, in the order they have."""
    if not len(bucket):
        return
    # two bytes are sorted by counting
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, table = bucket[order], table.take(order).combine_chunks()
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    for start, end in zip(first, [*first[1:], len(bucket)], strict=True):
        cells = [[int(bucket[start])], [end - start], [_closed(table.slice(start, end - start))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                         names=["bucket", "n", "rows"])


def packed_table(rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``low high rows``: ``rows``, which have positions ``_pos``, packed with what an order's key is made of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            position = table.column("_pos").to_numpy()
            cells = [pa.array([int(position.min())]), pa.array([int(position.max())]), pa.array([_closed(table)], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["low", "high", "rows"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    # neighbours in different tasks: a part of an order reads rows that stand together
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    # a null id adds nothing to the key, not even a bar
    named = rows.select("_pos", F.concat_ws("|", F.lit(""), F.col(row_id)).alias("_id"), *columns)
    packed = named.mapInArrow(run, "low long, high long, rows binary")
    packed = packed.repartitionById(tasks, F.pmod(F.floor(F.col("low") / PACKED_ROWS), F.lit(tasks)).cast("int"))
    return materialise(packed, "packed-rows", "none")


def shuffled_pairs(packed: DataFrame, kinds: dict[str, str], own: Sequence[str], other: Sequence[str], rep: int, seed: int, n: int,
                   bucket_rows: int, parts: int) -> Iterator[DataFrame]:
    """``_own_...`` of the row at each position, and ``_other_...`` of the row there in the shuffled order, in ``parts`` frames.

    The order is that of the hexadecimal MD5 of seed, repeat and id, then of the position. The counts of the keys' leading bits
    tell which positions keys of these bits take: only rows that meet are shuffled, and only those of one part at a time.
    """
    buckets = 1 + n // bucket_rows
    prefix = f"{seed}|{rep}".encode()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            high = table.column("_high").to_numpy() >> np.uint64(32)
            return _dealt(table, (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int32))

        for batch in batches:
            for table in _opened(batch.column("rows")):
                keys = [md5_words(prefix, chunk) for chunk in table.column("_id").chunks]
                high, low = (np.concatenate(c) for c in zip(*keys, strict=True))
                held.append(table.select(["_pos", *other]).append_column("_high", pa.array(high)).append_column("_low", pa.array(low)))
                size += len(high)
                if size >= DEALT_ROWS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    parts = min(parts, buckets)
    part = F.floor(F.col("bucket").cast("long") * parts / buckets).cast("int")
    donors = packed.select("rows").mapInArrow(keyed, "bucket int, n long, rows binary").withColumn("part", part)
    donors = materialise(donors, "shuffled-rows", "none", "part")
    sizes = np.zeros(buckets, np.int64)
    for bucket, size in donors.groupBy("bucket").agg(F.sum("n")).collect():
        sizes[bucket] = size
    starts = np.cumsum(np.append(1, sizes))

    def placed(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for table in _opened(batch.column("rows")):
                    table = table.select(["_pos", *own])
                    bucket = np.searchsorted(starts, table.column("_pos").to_numpy(), "right") - 1
                    here = np.flatnonzero((bucket >= first) & (bucket <= last))
                    yield from _dealt(table.take(here), bucket[here].astype(np.int32))
        return run

    def paired(left: pa.Table, right: pa.Table) -> pa.Table:
        takers, donors = (pa.concat_tables(_opened(side.column("rows"))).combine_chunks() for side in (left, right))
        takers = takers.take(np.argsort(takers.column("_pos").to_numpy(), kind="stable"))
        high = donors.column("_high").to_numpy()
        order = np.argsort(high)
        if (high[order[1:]] == high[order[:-1]]).any():
            order = np.lexsort((donors.column("_pos").to_numpy(), donors.column("_low").to_numpy(), high))
        donors = donors.select(list(other)).take(order)
        columns = [*(takers.column(c) for c in own), *(donors.column(c) for c in other)]
        return pa.table(columns, [*(f"_own_{c}" for c in own), *(f"_other_{c}" for c in other)])

    made = ", ".join([*(f"`_own_{c}` {kinds[c]}" for c in own), *(f"`_other_{c}` {kinds[c]}" for c in other)])
    numbers = np.arange(buckets) * parts // buckets
    for p in range(parts):
        first, last = np.flatnonzero(numbers == p)[[0, -1]].tolist()
        inside = (F.col("high") >= int(starts[first])) & (F.col("low") < int(starts[last + 1]))
        takers = packed.where(inside).select("rows").mapInArrow(placed(first, last), "bucket int, n long, rows binary")
        here = donors.where(F.col("part") == p).drop("part")
        yield takers.groupBy("bucket").cogroup(here.groupBy("bucket")).applyInArrow(paired, made)
    discard(packed.sparkSession, donors)
