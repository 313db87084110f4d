"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word contracts: space and U+0009 to U+000D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one window group may get: ranks and sums run within such groups and add up over them.
GROUP = 1 << 14

#: Where tables go when the session names no shared folder (single-machine tests).
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``; only a local session does without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or FALLBACK_DIR


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8MB") -> None:
    """Python workers get at most so many rows and bytes at once: their memory doesn't grow with texts' lengths.

    Session settings that are smaller already stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_kept: dict = {}


def worker_cache(name: tuple | None = None, make=None):
    """What a Python worker keeps from task to task: one thing at a time.

    Workers are reused by whatever runs next; the cache of another operator goes when one starts.
    """
    if name not in _kept:
        _kept.clear()
        if name is not None:
            _kept[name] = make()
    return _kept.get(name)


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: idle workers stay while other stages run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow whose worker gives memory back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns in their standard types, a missing one null; read in small batches by Python."""
    small_batches(docs.sparkSession)
    kinds = {"doc_id": "long", "page_id": "long", "n_chars": "long"}
    have = {c.lower(): c for c in docs.columns}
    picked = []
    for n in names:
        column = F.col(f"`{have[n]}`") if n in have else F.lit(None)
        picked.append(column.cast(kinds.get(n, "string")).alias(n))
    return docs.select(*picked)


def slices(lengths: np.ndarray, most: int, each: int = 2048) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row is a range of its own.

    A row counts as ``each`` bytes more than it has, which bounds what is kept for rows, however short.
    """
    start, total = 0, 0
    for i, n in enumerate((lengths + each).tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and each row's offsets in them. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    column = pa.concat_arrays([column])
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - (offsets[0] if len(column) else 0)


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column as ``(first, end, bytes, offsets)``, of about ``most`` bytes each.

    Bounds the memory of whole-array work: temporaries grow with a chunk, not with a batch.
    """
    data, offsets = utf8(column)
    for lo, hi in slices(np.diff(offsets), most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (shift, multiply, shift) for uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a chunk in order, and how many words each row has.

    A word is a run of bytes other than SPACES and never crosses rows.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    # A polynomial in each byte's distance from its word's start.
    word_of = np.cumsum(first) - 1
    at = np.arange(len(data)) - starts[np.maximum(word_of, 0)]
    longest = int(at[inside].max()) + 1
    powers = np.ones(longest, np.uint64)
    if longest > 1:
        powers[1:] = np.cumprod(np.full(longest - 1, 0x100000001B3, np.uint64))
    value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(29)
    value *= powers[np.where(inside, at, 0)]
    value[gap] = 0
    return mix64(np.add.reduceat(value, starts)), counts


def split_rows(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """list<int64> from arrays of 64-bit integers."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def hash_order(*columns) -> Column:
    """A pseudo-random order of rows: 62 bits."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def range_slot(order: str, slots: str) -> Column:
    """Which of ``slots`` equal ranges of hash_order() a row falls in."""
    return F.expr(f"{order} div (({1 << 62} div {slots}) + 1)")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before, in groups ``by`` in ``order``.

    ``order`` begins with a column ``slot`` that cuts each group into ordered ranges. Ranges are
    summed first, their sums run up, and rows run up within their range: a group of any size is
    spread over as many tasks as it has ranges.
    """
    ranges = df.groupBy(*by, "slot").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*by, "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(ranges, [*by, "slot"]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")
