"""What the operators of this folder share: words, tables, row keys and global positions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surco.operators.ranks import row_ranks

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of one bucket that a position is counted in: the most that one sort has to hold.
BUCKET_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, for working columns beside the caller's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text, modulo 5, is 0 (null: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def give_back() -> None:
    """Return freed memory of this Python worker to the system: it outlives its task, and the next stage needs other memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the row's gapless place from 0 within its ``keys``, in an order fixed by the rows.

    A key's rows are dealt over buckets by a hash of ``order``; only bucket totals meet per key, so
    a key that holds a third of all rows is still sorted in pieces. ``keys`` must not be null, and
    ``df`` is read twice: pass a table that is written.
    """
    rows = df.count()
    buckets = max(1, rows // BUCKET_ROWS)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)))
    return row_ranks(dealt, keys, ["_bucket"], order, name).withColumn(name, F.col(name) - 1).drop("_bucket")
