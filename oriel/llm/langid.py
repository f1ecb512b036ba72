"""Language identification with language-bitmask n-gram filters.

The Bloom filters of all languages are stored bit-sliced: one table of slots
whose bits are languages.  The masks at an n-gram's ``K`` slots, combined by
AND, name all languages whose filter holds the n-gram.  For a text the hits
per language are counted over all its n-grams; with f the language's measured
rate of false positives (the product of its fill over the ``K`` slices),
``(hits/n - f) / (1 - f)`` is the corrected rate.  The largest decides, ties go
to the smaller name.  The score is its share of all corrected rates.

An n-gram enters a language's filter if it was seen there ``MIN_COUNT`` times
and its rate there is at least ``RHO`` times its largest rate in any language.

Filters are fitted on a bounded sample: ``max_per_lang`` labelled documents of
each language, the smallest hashes of doc_id first.

Defined cases: very long texts are read whole; a null text or one without a
letter is ``und`` with score 0; so
is every text if there is no labelled row; very short texts are padded with
spaces; repeated rows are predicted alike; other columns pass through inside
one struct, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import crc_mod, hash_cut, id_hash, read_table

N = 4
K = 2
MIN_COUNT = 3
RHO = 0.25
MAX_PER_LANG = 1500
WORD = 62  # languages in one mask
MAX_SLOTS = 1 << 22
FULL = 0.95


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_hashes(text: str, letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of the text's code point n-grams: lower case, all but
    letters as spaces, n-grams of spaces alone left out."""
    a = np.frombuffer(f"{' ' * (N - 1)}{text.lower()}{' ' * (N - 1)}".encode("utf-32-le", "replace"), dtype="<u4")
    a = np.where(letters[a], a, np.uint32(32)).astype(np.uint64)
    h, blank = a[:len(a) - N + 1].copy(), a[:len(a) - N + 1] == 32
    for i in range(1, N):
        part = a[i:len(a) - N + 1 + i]
        h = h * np.uint64(0x1F3D5B79A7C15) + part
        blank &= part == 32
    h = h[~blank]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def slot_numbers(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """An n-gram's slot in each of the K slices."""
    bits = int(slots).bit_length() - 1
    return [((h >> np.uint64(64 - bits * (i + 1))) & np.uint64(slots - 1)).astype(np.int64) for i in range(K)]


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # (words, K, slots) masks
    false: np.ndarray  # rate of false positives per language
    letters: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return "und", 0.0
        h = gram_hashes(text, self.letters)
        if not len(h):
            return "und", 0.0
        at = slot_numbers(h, self.table.shape[2])
        rate = np.zeros(len(self.langs))
        for w in range(self.table.shape[0]):
            mask = self.table[w, 0][at[0]]
            for i in range(1, K):
                mask &= self.table[w, i][at[i]]
            for b in range(min(WORD, len(self.langs) - w * WORD)):
                rate[w * WORD + b] = np.count_nonzero(mask & np.int64(1 << b))
        # a filter that is all but full says nothing
        rate = np.where(self.false < FULL, np.maximum((rate / len(h) - self.false) / np.maximum(1 - self.false, 1e-9), 0), 0.0)
        best = int(np.argmax(rate))
        return self.langs[best], float(rate[best] / rate.sum()) if rate[best] > 0 else 0.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_per_lang: int = MAX_PER_LANG) -> Filters:
    spark = docs.sparkSession
    letters = spark.sparkContext.broadcast(letter_table())
    named = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(lang_col).alias("lang"))
    rows = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # one row per language
    cut = F.element_at(F.create_map(*[F.lit(x) for k, n in rows.items() for x in (k, hash_cut(max_per_lang, n))]),
                       F.col("lang")) if rows else F.lit(0)
    # only the hashes that can be among the smallest reach the ranking
    rank = Window.partitionBy("lang").orderBy("h", "id", "key")
    sample = (named.withColumn("h", id_hash("id")).where(F.col("h") < cut)
              .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_per_lang)
              .select("id", "key", "lang").distinct())
    langs = sorted(rows)
    number = {lang: i for i, lang in enumerate(langs)}
    # the sample has at most max_per_lang rows a language
    picked = (docs.select(F.col(id_col).alias("id2"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang2"))
              .join(F.broadcast(sample), F.col("id").eqNullSafe(F.col("id2")) & (F.col("lang") == F.col("lang2"))
                    & (F.col("key") == F.xxhash64("text")))
              .select("lang", "text"))

    def count(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for lang in set(names):
                own = [gram_hashes(t, letters.value) for n, t in zip(names, b.column(1).to_pylist(), strict=True)
                       if n == lang and t]
                if own:
                    g, n = np.unique(np.concatenate(own).view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), number[lang], np.int32)), pa.array(g), pa.array(n.astype(np.int64))],
                        names=["l", "g", "n"])

    from oriel.llm.common import materialize

    grams = materialize(picked.mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    total = {r["l"]: r["n"] for r in grams.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # one row per language
    if not total:
        return Filters([], np.zeros((0, K, 2), np.int64), np.zeros(0), letters.value)
    totals = F.array(*[F.lit(float(total.get(i, 1))) for i in range(len(langs))])
    kept = (grams.withColumn("r", F.col("n") / F.get(totals, F.col("l")))
            .groupBy("g").agg(F.max("r").alias("top"), F.collect_list(F.struct("l", "n", "r")).alias("ls"))  # a row per language
            .select("g", "top", F.explode("ls").alias("x"))
            .where((F.col("x.n") >= MIN_COUNT) & (F.col("x.r") >= RHO * F.col("top"))).select("g", F.col("x.l").alias("l")))
    n = kept.select("g").distinct().count()
    slots = 1 << max(12, min(MAX_SLOTS.bit_length() - 1, (8 * n).bit_length()))
    bits = slots.bit_length() - 1
    slices = F.array(*[F.struct(F.lit(i).alias("k"), F.shiftrightunsigned(F.col("g"), 64 - bits * (i + 1)).bitwiseAND(slots - 1).alias("s"))
                       for i in range(K)])
    masks = (kept.select((F.col("l") / WORD).cast("int").alias("w"),
                         F.shiftleft(F.lit(1).cast("long"), 0).alias("one"), (F.col("l") % WORD).alias("b"), F.explode(slices).alias("x"))
             .select("w", "x.k", "x.s", F.expr("shiftleft(one, b)").alias("m"))
             .groupBy("w", "k", "s").agg(F.bit_or("m").alias("m")))
    table = np.zeros(((len(langs) - 1) // WORD + 1, K, slots), dtype=np.int64)
    for r in masks.toLocalIterator():  # at most words * K * slots rows
        table[r["w"], r["k"], r["s"]] = r["m"]
    fill = np.array([[np.count_nonzero(table[i // WORD, k] & np.int64(1 << (i % WORD))) / slots for k in range(K)]
                     for i in range(len(langs))])
    return Filters(langs, table, fill.prod(axis=1), letters.value)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (replaced if present)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in others if c != text_col] or [F.lit(0).alias("none")]).alias("row"),
                      F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*src.schema.fields, T.StructField("l", T.StringType()), T.StructField("s", T.DoubleType())])

    def run(batches):
        f = shared.value
        for b in batches:
            got = [f.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["row", "text", "l", "s"])

    return src.mapInArrow(run, schema).select(
        *[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in others],
        F.col("l").alias("lang_pred"), F.col("s").alias("score"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    filters = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")
