"""Rule-based lexicon sentiment as a Spark job, N3: batch model scoring
plug-in, and the label rules that feed comparisons (P7–P12).

Method (published lexicon-and-rules scorer, Hutto & Gilbert 2014), as built
here — an own specification, not a copy of any package:

* words: whitespace split; a word is stripped of ASCII punctuation at both
  ends when what is left has more than 2 characters; look-ups use lower case.
* a word in the booster table, or not in the lexicon, scores 0.
* a lexicon word starts at its valence; all-caps word in mixed-case text
  adds ±CAPS_INCREMENT; then for each of the 3 preceding words (nearest
  first) that is not itself a lexicon word: a booster adds its delta (sign of
  the current valence, ±CAPS_INCREMENT if it is all-caps, decayed 1 / .95 / .9)
  and a negation word (or one containing "n't") multiplies by NEGATION_SCALAR.
* contrast word (default "but", first occurrence): scores before it x0.5,
  after it x1.5.
* document: sum ± punctuation emphasis (min(!,4)·0.292; 2–3 '?' ·0.18 each,
  more 0.96); compound = x / sqrt(x² + 15) clipped to ±1 (4 dp);
  pos/neg/neu are shares of Σ(s+1), Σ(s−1), count(s = 0), emphasis added to
  the larger side (3 dp, half-even).  No words: all 0.

Plan: per-document context (neighbour words, caps flags, contrast position,
emphasis) is computed in-array — no shuffle, no window.  Only lexicon hits
are kept after one join with the word table; neighbour look-ups are three more
joins on those hits (small word tables are broadcast by their size); the
per-document sums are a hash aggregation by row number whose partial step
collapses each document map-side, so the shuffle carries about one row per
document.  Rows stay rows: repeated ids are never merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx

PUNCT_EDGES = dims.ASCII_PUNCTUATION


def is_all_caps(w: Column) -> Column:
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")


def scorer_words(text: Column) -> Column:
    def strip(w):
        s = F.trim(w, F.lit(PUNCT_EDGES))
        return F.when(F.length(s) > 2, s).otherwise(w)
    return F.transform(tx.split_ws(text), strip)


def word_table(lexicon: DataFrame, boosters: DataFrame) -> DataFrame:
    """(token, valence, delta): one bounded table for all look-ups, one row
    per token (a repeated token in a user lexicon cannot double a hit)."""
    lex = lexicon.select(F.lower("token").alias("token"), F.col("valence").cast("double"),
                         F.lit(None).cast("double").alias("delta"))
    bst = boosters.select(F.lower("token").alias("token"), F.lit(None).cast("double").alias("valence"),
                          F.col("delta").cast("double"))
    return lex.unionByName(bst).groupBy("token").agg(F.max("valence").alias("valence"), F.max("delta").alias("delta"))


def lexicon_scores(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, boosters: DataFrame,
                   negations: list[str] | None = None, contrast: str = "but",
                   carry: list[str] | None = None) -> DataFrame:
    """(id, neg, neu, pos, compound, *carry), one row per row of ``df``.

    ``carry`` columns (small per-row values such as a topic or a snippet) are
    grouping columns beside the row number, so callers need no join back and
    the aggregation buffers hold numbers only."""
    carry = list(carry or [])
    negations = negations if negations is not None else dims.STARTER_NEGATIONS
    C = dims.CAPS_INCREMENT
    kept = [f"__c{i}" for i in range(len(carry))]
    whole = ["__rid", "__id", *kept]

    d = df.select(F.monotonically_increasing_id().alias("__rid"), F.col(id_col).alias("__id"), F.col(text_col).alias("__t"),
                  *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    d = d.select(*whole, "__t", F.transform(scorer_words(F.col("__t")),
                                            lambda w: F.struct(F.lower(w).alias("w"), is_all_caps(w).alias("up"))).alias("__ws"))
    n_caps = F.size(F.filter("__ws", lambda s: s["up"]))
    bang = F.least(tx.count_char("__t", "!"), F.lit(dims.EXCLAMATION_MAX)) * dims.EXCLAMATION_INCREMENT
    qn = tx.count_char("__t", "?")
    ques = F.when(qn > 1, F.when(qn <= 3, qn * dims.QUESTION_INCREMENT).otherwise(dims.QUESTION_MANY)).otherwise(0.0)
    d = d.select(*whole, "__ws",
                 F.size("__ws").alias("__n"),
                 ((n_caps > 0) & (n_caps < F.size("__ws"))).alias("__cap"),
                 (F.array_position(F.transform("__ws", lambda s: s["w"]), contrast) - 1).alias("__but"),
                 (bang + ques).alias("__amp"))

    # one row per word with the three words before it; documents without words keep one null row
    near = F.transform("__ws", lambda w, i: F.struct(w.alias("cur"), *[F.get("__ws", i - k).alias(f"p{k}") for k in (1, 2, 3)]))
    base_cols = [*whole, "__n", "__cap", "__but", "__amp", "__pos", "__near"]
    e = d.select(*whole, "__n", "__cap", "__but", "__amp", near.alias("__all"))
    e = e.select(*base_cols[:-2], F.posexplode_outer("__all").alias("__pos", "__near"))
    wt = word_table(lexicon, boosters)

    def look_up(frame, key: Column, k: int, extra: list[str]) -> DataFrame:
        # the same table every time: one exchange, reused
        t = wt.select(F.col("token").alias(f"__tok{k}"), F.col("valence").alias(f"__val{k}"), F.col("delta").alias(f"__b{k}"))
        return frame.join(t, key == F.col(f"__tok{k}"), "left").select(*base_cols, *extra, f"__val{k}", f"__b{k}")

    e = look_up(e, F.col("__near")["cur"]["w"], 0, [])
    hit = F.col("__val0").isNotNull() & F.col("__b0").isNull()
    # keep lexicon hits plus one placeholder row per document (its first word)
    e = e.where(hit | F.col("__pos").isNull() | (F.col("__pos") == 0)).withColumn("__hit", hit)
    extra = ["__val0", "__b0", "__hit"]
    for k in (1, 2, 3):
        e = look_up(e, F.col("__near")[f"p{k}"]["w"], k, extra)
        extra += [f"__val{k}", f"__b{k}"]

    v = F.col("__val0")
    e = e.withColumn("__v", F.when(F.col("__near")["cur"]["up"] & F.col("__cap"),
                                   F.when(v > 0, v + C).otherwise(v - C)).otherwise(v))
    for k, decay in zip((1, 2, 3), dims.BOOST_DECAY):
        v = F.col("__v")
        p = F.col("__near")[f"p{k}"]
        usable = p.isNotNull() & F.col(f"__val{k}").isNull()
        b = F.col(f"__b{k}")
        s = F.when(v < 0, -b).otherwise(b)
        s = F.when(p["up"] & F.col("__cap"), F.when(v > 0, s + C).otherwise(s - C)).otherwise(s)
        s = F.when(b.isNotNull(), s * decay).otherwise(F.lit(0.0))
        e = e.withColumn("__v", F.when(usable, v + s).otherwise(v))
        negated = usable & (p["w"].isin(*[w.lower() for w in negations]) | p["w"].contains("n't"))
        e = e.withColumn("__v", F.when(negated, F.col("__v") * dims.NEGATION_SCALAR).otherwise(F.col("__v")))

    bp = F.col("__but")
    factor = (F.when((bp >= 0) & (F.col("__pos") < bp), dims.BUT_BEFORE)
              .when((bp >= 0) & (F.col("__pos") > bp), dims.BUT_AFTER).otherwise(1.0))
    e = e.select(*whole, "__n", "__amp", F.when(F.col("__hit"), F.col("__v") * factor).alias("__s"))

    s = F.col("__s")
    g = e.groupBy(*whole).agg(
        F.first("__n").alias("__n"), F.first("__amp").alias("__amp"),
        F.coalesce(F.sum(s), F.lit(0.0)).alias("__sum"),
        F.coalesce(F.sum(F.when(s > 0, s + 1)), F.lit(0.0)).alias("__up"),
        F.coalesce(F.sum(F.when(s < 0, s - 1)), F.lit(0.0)).alias("__down"),
        F.count_if(s.isNotNull() & (s != 0)).alias("__nz"))
    return finish_scores(g, id_col, carry, kept)


def finish_scores(g: DataFrame, id_col: str, carry: list[str], kept: list[str]) -> DataFrame:
    x, amp = F.col("__sum"), F.col("__amp")
    x = F.when(x > 0, x + amp).when(x < 0, x - amp).otherwise(x)
    comp = x / F.sqrt(x * x + dims.COMPOUND_ALPHA)
    comp = F.least(F.greatest(comp, F.lit(-1.0)), F.lit(1.0))
    up, down = F.col("__up"), F.col("__down")
    g = g.select("__id", "__n", *kept, F.when(up > F.abs(down), up + amp).otherwise(up).alias("__p"),
                 F.when(up < F.abs(down), down - amp).otherwise(down).alias("__q"),
                 (F.col("__n") - F.col("__nz")).cast("double").alias("__u"), comp.alias("__comp"))
    total = F.col("__p") + F.abs(F.col("__q")) + F.col("__u")
    empty = F.col("__n") == 0
    return g.select(
        F.col("__id").alias(id_col),
        F.when(empty, 0.0).otherwise(F.bround(F.abs(F.col("__q") / total), 3)).alias("neg"),
        F.when(empty, 0.0).otherwise(F.bround(F.abs(F.col("__u") / total), 3)).alias("neu"),
        F.when(empty, 0.0).otherwise(F.bround(F.abs(F.col("__p") / total), 3)).alias("pos"),
        F.when(empty, 0.0).otherwise(F.bround(F.col("__comp"), 4)).alias("compound"),
        *[F.col(k).alias(c) for c, k in zip(carry, kept)])


# N3 -------------------------------------------------------------------------
def score_batches(df: DataFrame, text_col: str, scorer_factory, batch_size: int = 32,
                  max_chars: int = 1500, out_schema: str = "raw_label string, confidence double") -> DataFrame:
    """Run a pre-trained text classifier over Arrow batches.

    ``scorer_factory()`` is called once per task (model load), and returns a
    callable list[str] -> (labels, confidences).  Text is cut to ``max_chars``.
    All input columns are passed through."""
    @F.pandas_udf(out_schema)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for part in parts:
            labels, confs, texts = [], [], part.tolist()
            for i in range(0, len(texts), batch_size):
                la, co = scorer(texts[i:i + batch_size])
                labels.extend(la)
                confs.extend(co)
            yield pd.DataFrame({"raw_label": pd.Series(labels, dtype="object"), "confidence": pd.Series(confs, dtype="float64")})

    # the task's Python sees the cut text alone; other columns stay outside
    cut = F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, max_chars)
    return df.withColumn("__scored", score(cut)).select(*df.columns, "__scored.*")
