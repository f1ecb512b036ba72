"""S1/S2 and table loading.

Driver tables are Parquet; reads name their columns so Catalyst prunes the
scan (``ReadSchema``) and pushes filters (``PushedFilters``).  CSV reads take
an explicit schema (no inference pass over 100 TB) and handle quoted
multi-line review bodies.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("reviews", T.StringType()),
])


# text tables, and the key by which they are dealt out where the session asks for it
TEXT_TABLE_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in TEXT_TABLE_KEYS:
        from ..session import on_request
        df = on_request(df, TEXT_TABLE_KEYS[name])
    return df


def reviews(spark: SparkSession, sf_dir: str, title_chars: int | None = None) -> DataFrame:
    """Driver ``documents`` as a review table: review_id, title (first line), reviews, lang, source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"),
        tx.first_line("text", title_chars).alias("title"),
        F.col("text").alias("reviews"),
        "lang", "source",
    )


# S1 -------------------------------------------------------------------------
def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEW_SCHEMA) -> DataFrame:
    """Quoted multi-line bodies; files are split over tasks (see ``csvsplit``)."""
    from .csvsplit import read_csv_split
    return read_csv_split(spark, path, schema)


# S2 -------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True)
       .option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


# P3 -------------------------------------------------------------------------
def select_existing(df: DataFrame, cols: list[str], required: list[str] | None = None) -> DataFrame:
    """Keep the listed columns that exist; columns in ``required`` must exist."""
    missing = [c for c in (required or []) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select([c for c in cols if c in df.columns])


# P16 ------------------------------------------------------------------------
def head_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """First n rows in a stable order (TakeOrderedAndProject: n rows per partition, then merged)."""
    return df.orderBy(order_col).limit(n)


def rows_at(df: DataFrame, id_col: str, ids: list) -> DataFrame:
    """Rows picked by id (a before/after sample); the id list is pushed to the scan."""
    return df.where(F.col(id_col).isin(list(ids)))
