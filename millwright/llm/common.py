"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.session import importable

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that one step in Python works on; bounds a worker's memory.
SLICE_BYTES = 12 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def id_remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def hashed_share(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About nine tenths of ``rows`` of the ``total`` rows, all if there are no more: those whose key hashes lowest.

    The bound holds but for a chance far below 1e-9 (from a few thousand rows
    on), and no task or driver sorts rows for it. Equal keys go together.
    """
    if total <= rows:
        return df
    return df.where(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * 0.9 * rows / total))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null.

    Squeezing each word to one letter first keeps the array of matches from
    ever being built.
    """
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w"), r"[\x20\x09-\x0D]++", "")), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where
    that is unset (tests, a laptop) a folder in the warehouse is used.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints/{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows that one task takes with ease.
ROWS_A_TASK = 1 << 18


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A written table of so many narrow rows, in as few partitions as hold ROWS_A_TASK each.

    What fits one task then needs no exchange for its joins and groups, and a
    large table keeps the partitions that it was written with.
    """
    return df.coalesce(max(1, rows // ROWS_A_TASK))


def counted(df: DataFrame) -> int:
    """The rows of a written table, counted task by task without an exchange."""
    return int(df._jdf.queryExecution().toRdd().count())


#: Settings for how much Python workers get at once: rows and bytes.
BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
#: Bytes that a worker gets at once where batches are small; a wider row comes alone.
BATCH_BYTES = 4 << 20


def _smaller(before: str, most: int) -> str:
    """The smaller of two bounds; 0 and less are none. A bound in bytes may have Spark's units."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", before.lower()).groups()
    now = int(number) << 10 * (" kmgtp".index(unit) if unit else 0)
    return str(min(most, now) if now > 0 else most)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get so many rows and BATCH_BYTES at once, for what runs inside; wide rows then take less memory on either side."""
    before = [spark.conf.get(key) for key in BATCH_SETTINGS]
    limit_batches(spark, rows)
    try:
        yield
    finally:
        for key, value in zip(BATCH_SETTINGS, before):
            spark.conf.set(key, value)


def limit_batches(spark: SparkSession, rows: int) -> None:
    """Python workers get so many rows and BATCH_BYTES at once from now on, for what is lazy: Spark reads the settings when a plan runs. Smaller ones stay."""
    for key, most in zip(BATCH_SETTINGS, (rows, BATCH_BYTES)):
        spark.conf.set(key, _smaller(spark.conf.get(key), most))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; when a task ends, its worker gives memory that it no longer uses back to the system.

    Spark keeps workers for later tasks, and beside a stage without Python they
    would hold what their largest task once took.
    """

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return leaving


def give_back() -> None:
    """Free memory of this process goes back to the system: Arrow's, and that of the C library where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """Executors collect their garbage and give free heap back to the system, before a stage that shares their memory with Python.

    A heap that grew in one stage is else kept through all later ones. Two tasks
    for each core reach every executor that is idle.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffles and checkpoints that nothing refers to any more.

    The cleaner acts when the driver collects its garbage, which a driver with
    few rows of its own seldom does; iterative algorithms would fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text if text is not None else batch.num_columns - 1)
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        parts = np.cumsum(size) // SLICE_BYTES
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets between them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: The ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a slice as bytes, the number of each word in order, and word offsets by text.

    A text is cut at ASCII white space only, by looking at its bytes.
    """
    n = len(data)
    is_word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:n]
    begins = np.flatnonzero(start)
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:] | edge[1:n]
    ends = np.flatnonzero(stop) + 1
    per_text = np.searchsorted(begins, offsets).astype(np.int64)
    # gather only the words' bytes, then hand Arrow one contiguous array
    length = ends - begins
    packed = data[is_word]
    where = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(length, out=where[1:])
    values = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(where), pa.py_buffer(packed)])
    coded = values.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), per_text


def sum_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets; 0 where there are none."""
    total = np.zeros((len(offsets) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        total[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=float)
    return total
