"""Shared helpers of the training-data operators.

Scratch tables go to the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors).  They are plain Parquet, so a lost executor costs a
re-read, not a recomputation of the lineage.
"""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to a scratch table and return a read of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.option("compression", codec)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """Within it, Arrow batches sent to Python hold about ``most`` bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def give_back() -> None:
    """Returns memory that this Python worker has freed to the system.  Workers
    are used again, task by task: else each one stays as large as its largest task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(run):
    """A mapInArrow body like ``run`` whose worker is small again after a task."""

    def body(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return body


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Key of a row by content: equal only for rows with the same id (null
    included) and the same text (null included), whose results are equal too."""
    return F.md5(F.concat_ws(
        "\u0001",
        F.when(df[id_col].isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), df[id_col].cast("string"))),
        F.when(df[text_col].isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), df[text_col]))).cast("binary"))


HASH_RANGE = 1 << 31


def id_hash(col: str) -> Column:
    """Hash of an id in [0, HASH_RANGE)."""
    return F.pmod(F.xxhash64(col), F.lit(HASH_RANGE))


def hash_cut(wanted: int, rows: int) -> int:
    """A bound below which the ``wanted`` smallest of ``rows`` id hashes lie,
    with four times as many to spare."""
    return HASH_RANGE if rows <= 5 * wanted else HASH_RANGE * 5 * wanted // rows
