"""Numeric review features (01's definitions) and the relational TF-IDF /
bag-of-words forms (M2–M5), plus scaling and assembly helpers (M6, M7).

The relational forms keep ``(id, term, tf)`` rows so every number is a plain
aggregate Catalyst can plan (and an SQL oracle can check); the ML forms in
``train.py`` use ``CountVectorizer`` / ``IDF`` vectors.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from . import tokens as tk

NUMERIC_FEATURES = ["char_count", "word_count", "avg_word_length", "exclamation_count",
                    "question_count", "uppercase_ratio"]


def review_features(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """char/word counts on the letters-only text, punctuation counts and
    upper-case ratio on the raw text (T11, T1, T2, T17–T19)."""
    tp = tx.clean_letters(text_col)
    d = df.select(*keep, F.col(text_col).alias("__raw"), tp.alias("text_processed"))
    d = d.select(
        *keep, "text_processed",
        F.length("text_processed").cast("bigint").alias("char_count"),
        tx.word_count("text_processed").cast("bigint").alias("word_count"),
        tx.count_char("__raw", "!").cast("bigint").alias("exclamation_count"),
        tx.count_char("__raw", "?").cast("bigint").alias("question_count"),
        tx.uppercase_ratio("__raw").alias("uppercase_ratio"),
    )
    return d.withColumn("avg_word_length", tx.safe_ratio("char_count", "word_count"))


# M2 / M3 / M4 relational ------------------------------------------------------
def term_frequencies(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf) — partial aggregation on the map side (a document's
    terms stay in one partition after the explode)."""
    return tk.explode_terms(df, [id_col], terms).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def term_bags(df: DataFrame, id_col: str, terms: Column, words: list[str] | None = None) -> DataFrame:
    """(id, bag): a row's distinct terms and their counts, one row per row with
    terms, counted inside the task (no shuffle); with ``words`` those terms only."""
    shared = df.sparkSession.sparkContext.broadcast(None if words is None else frozenset(words))
    kind = df.schema[id_col].dataType.simpleString()
    most = 256                                    # rows of an output batch

    def run(batches):
        words = shared.value
        for batch in batches:
            lists = batch.column(1)
            for begin in range(0, batch.num_rows, most):
                keys, size, names, counts = [], [0], [], []
                for k in range(begin, min(begin + most, batch.num_rows)):
                    held = Counter(lists[k].as_py() or ())
                    held.pop(None, None)
                    kept = [t for t in held if words is None or t in words]
                    if kept:
                        keys.append(k)
                        names += kept
                        counts += [held[t] for t in kept]
                        size.append(len(names))
                cells = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["term", "tf"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())),
                                                  pa.ListArray.from_arrays(pa.array(size, pa.int32()), cells)], names=["id", "bag"])

    got = df.select(F.col(id_col).alias("id"), terms.alias("terms")).mapInArrow(run, f"id {kind}, bag array<struct<term string, tf bigint>>")
    return got.select(F.col("id").alias(id_col), "bag")


def _cells(bags: DataFrame, *keep: str) -> DataFrame:
    return bags.select(*keep, F.explode("bag").alias("c")).select(*keep, "c.term", "c.tf")


def counted_vocabulary(df: DataFrame, id_col: str, terms: Column, n_docs: Column, max_features: int,
                       min_df: float = 1, max_df: float = 1.0, unique: bool = False) -> DataFrame:
    """``vocabulary`` without the table of all (id, term) pairs: rows are
    counted where they are and only sums per term are shuffled.  Rows of one id
    are one document, so where ids repeat (``unique``: they do not) their
    common terms are taken off the document frequencies.  The result, of at
    most ``max_features`` rows, is a local table (term, df, total)."""
    bags = term_bags(df, id_col, terms)
    stats = _cells(bags).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if not unique:
        again = df.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(id_col).alias("__again"))
        if not again.isEmpty():
            rows = df.join(again, F.col(id_col).eqNullSafe(F.col("__again")), "left_semi")
            more = (_cells(term_bags(rows, id_col, terms), id_col).groupBy(id_col, "term").agg((F.count("*") - 1).alias("more"))
                    .groupBy("term").agg(F.sum("more").alias("more")))
            stats = (stats.join(more, "term", "left")
                     .select("term", (F.col("df") - F.coalesce("more", F.lit(0))).alias("df"), "total"))
    kept = _most_frequent(stats, n_docs, max_features, min_df, max_df).collect()     # <= max_features
    return dims.local_table(df.sparkSession, [(r["term"], r["df"], r["total"]) for r in kept], "term string, df bigint, total bigint")


def counted_frequencies(df: DataFrame, id_col: str, terms: Column, vocab: DataFrame) -> DataFrame:
    """(id, term, tf) of the terms of a local vocabulary: what
    ``term_frequencies`` joined with it gives, but other terms never leave
    their task, and one exchange by id serves this and sums per document."""
    words = [r["term"] for r in vocab.select("term").collect()]
    return _cells(term_bags(df, id_col, terms, words).repartition(id_col), id_col).groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))


def vocabulary(tf: DataFrame, id_col: str, n_docs: Column, max_features: int | None,
               min_df: float = 1, max_df: float = 1.0) -> DataFrame:
    """Terms kept by document-frequency bounds and a cap on total count
    (ties: term ascending).  ``min_df``/``max_df`` below 1 are fractions,
    at or above 1 are counts (max_df 1.0 means 100 %)."""
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return _most_frequent(stats, n_docs, max_features, min_df, max_df)


def _most_frequent(stats: DataFrame, n_docs: Column, max_features: int | None, min_df: float, max_df: float) -> DataFrame:
    lo = F.ceil(n_docs * min_df) if isinstance(min_df, float) and min_df < 1 else F.lit(min_df)
    hi = (F.floor(n_docs * max_df) if isinstance(max_df, float) and max_df <= 1.0 else F.lit(max_df))
    stats = stats.where((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features:
        # global top-k: TakeOrderedAndProject keeps k rows per partition
        stats = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    return stats


def tfidf(tf: DataFrame, vocab: DataFrame, id_col: str, n_docs: Column, sublinear: bool = True) -> DataFrame:
    """scikit-learn style weights: tf' = 1+ln(tf) (sublinear), idf = ln((1+n)/(1+df)) + 1,
    then L2 normalisation per document.  The vocabulary's size decides how it
    is joined."""
    j = tf.join(vocab.select("term", "df"), "term")
    tfw = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    w = j.select(id_col, "term", (tfw * idf).alias("w"))
    # one exchange on the document id for the L2 norm (no aggregate + join back)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("tfidf"))
