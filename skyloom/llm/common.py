"""What the corpus operators share: durable tables, byte-level words, hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  All of those are ASCII,
so splitting the UTF-8 bytes and splitting the characters give the same words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20
#: The contract's word, as a Java regular expression, and its complement.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_BYTES = np.arange(256, dtype=np.uint8)
_IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session may leave that
    unset, as in tests; a folder under /tmp is taken then.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("/tmp/skyloom-checkpoints")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


_written: list[str] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def durable(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut lineage that survives lost executors.

    The table stays until :func:`release`, as results that are not yet computed read it.
    With ``batch_rows``, rows pass between the JVM and Python so many at a time while it
    is written, which bounds the memory of both where a row holds whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of :func:`durable` before :func:`release` does, once all that reads it is written itself."""
    _delete(table.sparkSession, table.durable_path)
    _written.remove(table.durable_path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`durable` has written in this process; call it once results are stored.  Returns their number."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the long column ``name``: each row's place from 1 in the whole table's ``order``.

    Rows are range-partitioned, sorted and written; the partitions' counts, one row a
    partition, give the offsets.  Rows that tie in ``order`` are numbered in any order.
    """
    mark = [F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mark")]
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *mark), "numbered")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_mark").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    parts = parts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return placed.join(F.broadcast(parts), "_part").withColumn(name, F.col("_mark") + F.col("_shift")).drop("_part", "_mark", "_shift")


def word_count(text: Column) -> Column:
    """Number of words of a text column, in the JVM; null counts as no text."""
    body = F.coalesce(text, F.lit(""))
    gaps = F.size(F.split(body, SPACE))
    edge = F.when(body.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(body.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(body.rlike(r"[^\x20\x09-\x0D]"), gaps - edge).otherwise(0).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial hash's step, and of its inverse."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _STEP, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span of ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the spans [starts, ends)."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + mix((ends - starts).astype(np.uint64)))


def binary_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) over pieces of a text column of about ``most`` bytes.

    Rows are never cut; null rows count as empty.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word index at which each row begins (and the last ends)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _IS_SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, all other bytes as they are."""
    return _LOWER[data]
