"""Token tables: explode, stopword anti-join, n-grams, dictionary lemmas,
vocabulary and top-k term counts.

In-array forms (``F.filter`` / ``F.transform``) need no shuffle and are used
where the per-row logic is enough.  The exploded ``(review_id, pos, token)``
form is used where a table join is the point (stopwords, lemma dictionary).
Re-assembly after an explode groups by the document id: Catalyst runs the
``collect_list`` partially on the map side, and since the explode keeps a
document's tokens in one partition, the shuffle carries one row per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import lemma as lm
from ..functions import text as tx
from ..session import cut_lineage


def explode_tokens(df: DataFrame, id_col: str, tokens: Column, keep: list[str] | None = None,
                   outer: bool = False) -> DataFrame:
    """(id, pos, token) with 0-based positions; ``outer`` keeps one null row
    for documents without tokens so re-assembly needs no join back."""
    keep = keep or []
    # posexplode_outer + filter: Catalyst infers no size(tokens) > 0 filter,
    # which would evaluate the (expensive) token expression a second time
    e = df.select(id_col, *keep, F.posexplode_outer(tokens).alias("pos", "token"))
    return e if outer else e.where(F.col("token").isNotNull())


def stopword_table(spark, variants=("general", "nlp_domain")) -> DataFrame:
    """Union of stopword variants, distinct."""
    s = dims.stopwords_df(spark)
    parts = [s.where(F.col("variant") == v).select("token") for v in variants]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def remove_stopwords_exploded(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Left-anti join with the stopword table, planned by its size
    (duplicates and positions of the kept tokens stay)."""
    return tokens.join(stop, "token", "left_anti")


def reassemble(tokens: DataFrame, id_col: str, value: str = "token", sep: str = " ") -> DataFrame:
    """Inverse of explode: tokens back in position order, joined with ``sep``."""
    g = tokens.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("__t"))
    kept = F.filter("__t", lambda s: s[value].isNotNull())
    return g.select(id_col, F.array_join(F.transform(kept, lambda s: s[value]), sep).alias(value))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """In-array n-grams joined by a space (empty when fewer than n tokens).

    Built from n shifted slices zipped together, so the lambda only sees the
    zipped struct: the token array is evaluated a fixed number of times, never
    once per position (an inlined expression inside a positional lambda would
    make the cost quadratic)."""
    m = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    if n == 1:
        return tokens
    if n == 2:
        return F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))
    z = F.arrays_zip(*[F.slice(tokens, i + 1, m) for i in range(n)])
    return F.transform(z, lambda s: F.concat_ws(" ", *[s[str(i)] for i in range(n)]))


def vectorizer_tokens(c) -> Column:
    """Default vectoriser tokens: lower-case word characters, 2 or more."""
    return F.regexp_extract_all(F.lower(tx._c(c)), F.lit(r"(?U)\b\w\w+\b"), 0)


# T13 / J8 -------------------------------------------------------------------
def word_actions(lemma_dict: DataFrame, stop: DataFrame) -> DataFrame:
    """(token, lemma, is_stop), one row per token: what the pipeline does with
    listed words.  Of several lemmas for a token the smallest counts."""
    rows = (lemma_dict.select("token", "lemma", F.lit(False).alias("is_stop"))
            .unionByName(stop.select("token", F.lit(None).cast("string").alias("lemma"), F.lit(True).alias("is_stop"))))
    return rows.groupBy("token").agg(F.min("lemma").alias("lemma"), F.max("is_stop").alias("is_stop"))


LEMMA_DICTIONARY = [
    # own small irregular-form dictionary; users pass a full one
    ("was", "be"), ("were", "be"), ("is", "be"), ("are", "be"), ("been", "be"),
    ("had", "have"), ("has", "have"), ("did", "do"), ("does", "do"),
    ("better", "good"), ("best", "good"), ("worse", "bad"), ("worst", "bad"),
    ("flights", "flight"), ("flying", "fly"), ("flew", "fly"), ("delayed", "delay"),
    ("delays", "delay"), ("cancelled", "cancel"), ("passengers", "passenger"),
    ("waiting", "wait"), ("seats", "seat"), ("bags", "bag"), ("hours", "hour"),
    ("children", "child"), ("people", "person"), ("went", "go"), ("gone", "go"),
    ("took", "take"), ("taken", "take"), ("told", "tell"), ("got", "get"),
]


def lemma_dictionary_df(spark, rows=None) -> DataFrame:
    return dims.local_table(spark, rows if rows is not None else LEMMA_DICTIONARY, "token string, lemma string")


#: Listed words that a task holds as one dictionary; longer lists are joined.
MAX_LISTED = 200_000


def token_text(text_col: str) -> Column:
    """The cleaned tokens of a text, joined by spaces (they hold none)."""
    return F.array_join(tx.tokenize(tx.nlp_clean_string(text_col)), " ")


def nlp_pipeline(df: DataFrame, id_col: str, text_col: str, lemma_dict: DataFrame,
                 stop: DataFrame, cleaned_col: str | None = None) -> DataFrame:
    """Lower → URLs/e-mails → punctuation → alphabetic tokens (2+) →
    stopwords → dictionary lemmas (fallback suffix rules) → joined string.

    Up to ``MAX_LISTED`` listed words (stopwords and lemmas) are sent to the
    tasks, which answer for each distinct token once: no shuffle, no sort.
    Longer lists are joined with the exploded tokens (``_nlp_by_join``).  Rows
    stay rows: those without tokens, those that lose all tokens, and those
    with repeated ids.  ``cleaned_col`` holds ``token_text`` of the texts, where
    a caller has it already."""
    cleaned = df.select(F.col(id_col).alias("__id"), (F.col(cleaned_col) if cleaned_col else token_text(text_col)).alias("__text"))
    acts = cut_lineage(word_actions(lemma_dict, stop))   # a list made from the texts is made once, for the join too
    listed = acts.limit(MAX_LISTED + 1).collect()
    if len(listed) > MAX_LISTED:
        return _nlp_by_join(cleaned.select("__id", F.filter(F.split("__text", " "), lambda t: t != "").alias("__toks")), id_col, acts)
    shared = df.sparkSession.sparkContext.broadcast({r["token"]: None if r["is_stop"] else r["lemma"] for r in listed
                                                     if r["is_stop"] or r["lemma"] is not None})

    @F.pandas_udf("string")
    def lemmas(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = LemmaWords(shared.value)
        for part in parts:
            yield pd.Series([" ".join(x for x in map(words.__getitem__, t.split(" ")) if x) for t in part], dtype=object)

    return cleaned.select(F.col("__id").alias(id_col), lemmas(F.coalesce("__text", F.lit(""))).alias("cleaned_review"))


class LemmaWords(dict):
    """token -> what the pipeline keeps of it ('' for nothing), made at the
    first look-up; emptied when it holds ``most`` tokens."""

    def __init__(self, listed: dict, most: int = MAX_LISTED):
        super().__init__()
        self.listed, self.most = listed, most

    def __missing__(self, token: str) -> str:
        lemma = self.listed[token] if token in self.listed else lm.suffix_lemma_word(token)
        if lemma is None or len(lemma) < 2 or not lemma.isalpha():
            lemma = ""
        if len(self) >= self.most:
            self.clear()
        self[token] = lemma
        return lemma


def _nlp_by_join(cleaned: DataFrame, id_col: str, actions: DataFrame) -> DataFrame:
    """``nlp_pipeline`` for lists of any length: the exploded tokens meet one
    table of listed words, and every row is put together again by a row number
    made before the explode."""
    cleaned = cleaned.select(F.monotonically_increasing_id().alias("__rid"), "__id", "__toks")
    ex = cleaned.select("__rid", "__id", F.posexplode_outer("__toks").alias("__pos", "__token"))
    acts = actions.select(F.col("token").alias("__token"), F.col("lemma").alias("__lemma"), F.col("is_stop").alias("__stop"))
    j = ex.join(acts, "__token", "left").withColumn(
        "__lemma", F.when(F.col("__stop").isNull() | ~F.col("__stop"),
                          F.coalesce("__lemma", lm.suffix_lemma(F.col("__token")))))
    keep = tx.is_alpha(F.col("__lemma")) & (F.length("__lemma") > 1)
    words = F.array_sort(F.collect_list(F.when(keep, F.struct("__pos", "__lemma"))))
    g = j.groupBy("__rid", "__id").agg(words.alias("__w"))
    return g.select(F.col("__id").alias(id_col),
                    F.array_join(F.transform("__w", lambda s: s["__lemma"]), " ").alias("cleaned_review"))


# W6 / O3 / O4 ---------------------------------------------------------------
def top_k_per_group(counts: DataFrame, group: list[str], term: str, n: str, k: int) -> DataFrame:
    """Top-k by count (ties: term ascending).  The rank filter lets Spark run a
    partial window-group limit before the shuffle, so only k rows per group
    and map partition move."""
    w = Window.partitionBy(*group).orderBy(F.desc(n), F.asc(term))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def explode_terms(df: DataFrame, keep: list[str], terms: Column) -> DataFrame:
    """explode without the inferred size() filter (see explode_tokens)."""
    return df.select(*keep, F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())


def term_counts(df: DataFrame, group: list[str], terms: Column) -> DataFrame:
    return explode_terms(df, group, terms).groupBy(*group, "term").agg(F.count("*").alias("n"))
