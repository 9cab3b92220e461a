"""Shared helpers of the training-data operators: table reading, durable intermediates, word rules."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_own_roots: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="sievemark-")
        _own_roots.append(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage durably: a lost executor costs a task, never the rows. The files go when the
    interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the files behind a result of ``materialize`` that nothing will read again."""
    files = set(df.inputFiles())
    for spark, path in list(_written):
        key = path.split("://", 1)[-1].split(":", 1)[-1]
        if any(key in f for f in files):
            discard(spark, path)
            _written.remove((spark, path))


@lru_cache(maxsize=1)
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):  # another C library
        return None


def give_back() -> None:
    """Return to the system what the allocators of Arrow and C hold free."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which the worker gives its free memory back.

    Workers outlive their tasks, and else keep the memory of the largest one beside the JVM's.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


def lean_group(run: Callable) -> Callable:
    """The same for ``applyInArrow``."""

    def own(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return own


#: Rows of one bitmap of ``rows_kept``, as Spark's bitmap functions cut them.
_PER_BITMAP = 32768


def rows_kept(numbered: DataFrame, number: str, kept: DataFrame) -> DataFrame:
    """The rows of ``numbered`` whose ``number`` (from 0, dense within partitions) is in ``kept`` (one column).

    Numbers become bitmaps of 4 kB, a bit a row, so texts stay where they are as long as Spark finds
    the bitmaps' file small enough to broadcast (its own threshold); beyond that it joins by bitmap.
    DataFrame functions only.
    """
    low, bits = unused(numbered, "_map", "_bits")
    numbers = kept.select((F.col(kept.columns[0]) + 1).alias("n"))
    maps = numbers.groupBy(F.bitmap_bucket_number("n").alias(low)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias(bits))
    maps = materialize(maps, "bitmaps")
    at = F.pmod(F.col(number), F.lit(_PER_BITMAP))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = numbered.join(maps, (F.floor(F.col(number) / _PER_BITMAP) + 1) == F.col(low))
    return joined.where(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1).select(*numbered.columns)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the session may have ended first
            break
    for root in _own_roots:
        shutil.rmtree(root, ignore_errors=True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
