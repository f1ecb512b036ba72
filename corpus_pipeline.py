"""Training-data pipeline: quality filter, line dedup, near-dedup, benchmark
decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the output of
one, written as Parquet and read again, is the next one's input.  All but the
last return the columns of ``documents``.

Defined cases: null and empty texts pass every filter as empty texts do; very
long texts are handled whole; repeated rows are copies, of which near-dedup
keeps one; further columns pass through, whatever their names (working columns
are named so that they cannot meet them); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm import bpe, decontam, linededup, neardup, quality
from oriel.llm.common import materialize, read_table


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name.casefold() in {c.casefold() for c in docs.columns}:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.5; the rest go."""
    name = free_name(docs, "quality_score")
    scored = quality.scored_documents(spark, docs, sf_dir, name)
    return scored.where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines; n_chars follows the text.
    Documents that consisted of such lines alone go."""
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    cut = linededup.remove_boilerplate(docs, lines_out=n_lines, removed_out=n_removed)
    changed = F.col(n_removed) > 0
    kept = cut.where(~changed | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    _, kept = neardup.near_duplicates(docs)
    return neardup.keep_one(docs, kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    name = free_name(docs, "benchmark_matches")
    found = decontam.matches(docs, decontam.item_parts(read_table(spark, sf_dir, "benchmark")), out=name)
    return found.where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again: doc_id, n_tokens and digests.
    The ids are written between: a task that encodes and decodes at once would
    keep two Python workers on each core."""
    ranks, pattern = bpe.default_ranks()
    ids = materialize(bpe.encode(docs.select("doc_id", "text"), ranks, pattern), "pipeline-ids")
    full = bpe.decode(ids, ranks)
    return full.select("doc_id", *bpe.digest(full))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The classifier, the search and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
