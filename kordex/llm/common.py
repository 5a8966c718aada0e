"""What the corpus operators share: reading tables, splits, sizes of batches, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

#: Text bytes that a Python worker holds in numpy form at once (a longer text is taken alone).
SLICE_BYTES = 1 << 20

#: Class of characters that end a word: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read, read.columns[0]) if name in ("documents", "pages") else read


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when they have ended (those of a checkpoint() do not), not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder of spark.checkpoint.dir.

    The folder is read from the session. Only where the session names none (tests, a laptop)
    a folder under the warehouse is set.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or shared_dir(spark))
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again (pruned by later readers)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by written(), once all that was read from it is written elsewhere."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A table of up to so many rows (one a source, one a language) is broadcast once its rows are counted.
SMALL_ROWS = 10_000


def small_or_not(df: DataFrame) -> DataFrame:
    """df cut from its lineage, with a broadcast hint if its counted rows are few; else joins shuffle and split skew."""
    cut = checkpointed(df)
    return F.broadcast(cut) if cut.count() <= SMALL_ROWS else cut


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """rows joined with a table of unique keys, some of which (hot) very many rows have.

    Hot keys are few for the rows they have: counted to be few, they are broadcast and their rows stay where they are; the
    others are joined as Spark sees fit. how: inner or left.
    """
    cut = checkpointed(table)
    some = cut.where(hot)
    large = F.broadcast(some) if some.count() <= SMALL_ROWS else some
    spread = rows.join(large, key)
    return spread.unionByName(rows.join(large.select(key), key, "left_anti").join(cut.where(~hot), key, how))


def free_name(df_columns: list[str], wanted: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df_columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


@functools.cache
def _c_library():
    """The C library, told once a process to map arrays of a megabyte or more on their own, so that freeing them gives the memory back."""
    try:
        found = ctypes.CDLL("libc.so.6")
        found.mallopt(-3, 1 << 20)  # the least size that is mapped; else it grows with the arrays that were freed
        found.mallopt(-1, 8 << 20)  # free memory at the top of the heap beyond which it shrinks
        return found
    except (OSError, AttributeError):  # another C library has no such calls
        return None


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when a task has seen them all, its worker, which Spark keeps for later tasks, gives freed memory back."""
    _c_library()
    try:
        yield from batches
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs whose texts (column number `text`) have about `limit` bytes."""
    for batch in trimmed(batches):
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        lo, total = 0, 0
        for i in range(n):
            if total and total + sizes[i] > limit:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += int(sizes[i])
        yield batch.slice(lo)
