"""Driver query catalogue: one DataFrame builder per SURVEY §7.5 query.

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the whole
driver tables.  Column names and types are fixed so the DuckDB oracle in
``oracle.py`` can be compared value by value: counts are bigint, doubles are
rounded, booleans stay booleans.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import labels as lb
from ..functions import text as tx
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _docs(spark, sf):
    return tb.table(spark, sf, "documents")


def _labels(spark, sf):
    return tb.table(spark, sf, "labels")


def pseudo_score(doc_id="doc_id", n_chars="n_chars") -> F.Column:
    """Deterministic stand-in score in [-1, 1] (0.01 steps, hits ±0.05 exactly)."""
    return ((F.col(doc_id) * 37 + F.col(n_chars)) % 201 - 100) / 100.0


# q01 T1 T2 A3 ---------------------------------------------------------------
@query("q01_text_lengths")
def q01(spark, sf):
    r = _docs(spark, sf).select(
        "lang",
        tx.char_length("text").alias("review_length"),
        tx.word_count("text").alias("review_word_count"),
        tx.char_length(tx.first_line("text")).alias("title_length"),
    )
    return r.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("review_length"), 4).alias("mean_length"),
        F.percentile("review_length", 0.5).cast("double").alias("median_length"),
        F.min("review_length").cast("bigint").alias("min_length"),
        F.max("review_length").cast("bigint").alias("max_length"),
        F.round(F.avg("review_word_count"), 4).alias("mean_words"),
        F.percentile("review_word_count", 0.5).cast("double").alias("median_words"),
        F.min("review_word_count").cast("bigint").alias("min_words"),
        F.max("review_word_count").cast("bigint").alias("max_words"),
        F.round(F.avg("title_length"), 4).alias("mean_title_length"),
    )


# q02 T3 T4 T5 ---------------------------------------------------------------
@query("q02_normalize_text")
def q02(spark, sf):
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("review_id"),
        tx.strip_ws(tx.first_line("text")).alias("title"),
        tx.strip_ws("text").alias("reviews"),
    )
    d = d.select(
        "review_id",
        tx.normalize_quotes("title").alias("title_clean"),
        tx.normalize_quotes("reviews").alias("reviews_clean"),
    )
    return d.withColumn("combined_text", tx.combine_title_review("title_clean", "reviews_clean"))


# q03 T6–T9 T11 ----------------------------------------------------------------
@query("q03_clean_letters")
def q03(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"),
                                tx.clean_letters("text").alias("text_processed"))
    return d.select(
        "review_id", "text_processed",
        tx.char_length("text_processed").cast("bigint").alias("char_count"),
        tx.word_count("text_processed").cast("bigint").alias("word_count"),
    )


# q04 T10 T21 ----------------------------------------------------------------
@query("q04_strip_punct")
def q04(spark, sf):
    d = _docs(spark, sf).select(
        F.col("doc_id").alias("review_id"), "text",
        tx.remove_punctuation(tx.lower("text")).alias("no_punct"),
    )
    return d.select(
        "review_id", "no_punct",
        tx.round_half_even(
            (F.length("text") - F.length("no_punct")) / F.greatest(F.length("text"), F.lit(1)), 4
        ).alias("removed_share"),
    )


# q05 T17–T19 T23 --------------------------------------------------------------
@query("q05_numeric_features")
def q05(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text",
                                tx.clean_letters("text").alias("tp"))
    feats = d.select(
        "review_id",
        tx.char_length("tp").cast("bigint").alias("char_count"),
        tx.word_count("tp").cast("bigint").alias("word_count"),
        tx.count_char("text", "!").cast("bigint").alias("exclamation_count"),
        tx.count_char("text", "?").cast("bigint").alias("question_count"),
        F.round(tx.uppercase_ratio("text"), 6).alias("uppercase_ratio"),
    )
    m = F.create_map(F.lit("exclamation_count"), F.col("exclamation_count").cast("double"),
                     F.lit("question_count"), F.col("question_count").cast("double"))
    return feats.select(
        "*",
        F.round(tx.safe_ratio("char_count", "word_count"), 4).alias("avg_word_length"),
        tx.map_get_or_zero(m, "exclamation_count").alias("feat_exclamation"),
        tx.map_get_or_zero(m, "sentiment_score").alias("feat_sentiment_score"),
    )


# q06 A1 A25 -----------------------------------------------------------------
NULL_PROFILE_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _docs_left_labels(spark, sf):
    return _docs(spark, sf).join(_labels(spark, sf), "doc_id", "left")


@query("q06_null_profile")
def q06(spark, sf):
    from ..operators.profile import null_profile
    return null_profile(_docs_left_labels(spark, sf), NULL_PROFILE_COLS)


# q07 P5–P15 -----------------------------------------------------------------
@query("q07_label_rules")
def q07(spark, sf):
    d = (_docs(spark, sf).join(_labels(spark, sf), "doc_id")
         .where(F.col("lang").isNotNull()))                       # P5 (pushed to the scan)
    d = d.select(
        F.col("doc_id").alias("review_id"), "quality", "n_chars",
        tx.as_text("text").alias("text"),                          # P2
        pseudo_score().alias("compound"),
        F.when(F.col("n_chars") % 2 == 0, "POSITIVE").otherwise("NEGATIVE").alias("raw_label"),
        ((F.col("n_chars") % 100) / 100.0).alias("raw_confidence"),
    )
    d = d.withColumns({                                            # P4
        "satisfied_pred": lb.satisfied_from_compound("compound"),  # P6
        "label3": lb.three_class("compound"),                      # P7
        "clf_score": lb.classifier_signed_score("raw_label", "raw_confidence"),  # P8
        "clf_label": lb.classifier_label("raw_label", "raw_confidence"),
    })
    d = d.withColumns({
        "label_bin": lb.label_to_binary("label3"),                 # P9
        "label_bin_cons": lb.label_to_binary("label3", conservative=True),
        "agree": lb.agrees("label3", "clf_label"),                 # P10
        "sentiment_label": F.col("label3"),                        # P12
        "sentiment_score": F.col("compound"),
        "satisfaction": lb.satisfaction_text("quality"),           # P14
        "snippet": F.substring("text", 1, 200),                    # P15
    })
    d = d.withColumn("correct", lb.correct_or_null("label_bin", "quality"))  # P11
    return d.drop("text", "raw_label", "raw_confidence", "n_chars").na.fill("", ["snippet"])  # P1 P13


# q08 P1–P4 P17 --------------------------------------------------------------
@query("q08_select_existing")
def q08(spark, sf):
    d = _docs(spark, sf).join(_labels(spark, sf), "doc_id")
    d = d.withColumns({"review_word_count": tx.word_count("text").cast("bigint"),
                       "compound": pseudo_score(), "satisfied": F.col("quality")})
    wanted = ["Unnamed: 0", "doc_id", "review_word_count", "compound", "satisfied", "vader_pos"]
    out = tb.select_existing(d, wanted, required=["doc_id", "compound"])
    return out.withColumnRenamed("doc_id", "review_id")


# q09 S1 S2 P16 --------------------------------------------------------------
@query("q09_csv_round_trip")
def q09(spark, sf):
    src = tb.reviews(spark, sf).select("review_id", "title", "reviews")
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    tb.write_csv(src, path)
    back = tb.read_reviews_csv(spark, path)
    return back


# q10 T12 --------------------------------------------------------------------
@query("q10_tokens")
def q10(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"),
                                tx.tokenize(tx.nlp_clean_string("text")).alias("toks"))
    return d.select("review_id", F.array_join("toks", " ").alias("tokens"),
                    F.size("toks").cast("bigint").alias("n_tokens"))


# q11 J3 U1 ------------------------------------------------------------------
@query("q11_stopword_filter")
def q11(spark, sf):
    from ..operators import tokens as tk
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    toks = tk.explode_tokens(d, "review_id", tx.tokenize(tx.nlp_clean_string("text")))
    kept = tk.remove_stopwords_exploded(toks, tk.stopword_table(spark, ("general", "nlp_domain")))
    return kept.select("review_id", F.col("pos").cast("bigint").alias("pos"), "token")


# q12 T14 T16 ----------------------------------------------------------------
@query("q12_suffix_lemma")
def q12(spark, sf):
    from ..functions import lemma as lm
    from ..functions.text import is_alpha, serving_clean_string, split_ws
    stop = dims.stopwords("frozen")
    toks = F.filter(split_ws(serving_clean_string("text")),
                    lambda t: is_alpha(t) & ~t.isin(*stop) & (F.length(t) > 2))
    vocab = _docs(spark, sf).select(F.explode(toks).alias("token")).distinct()
    # the 47-branch CASE runs once per distinct token, not once per occurrence
    return vocab.select("token", lm.suffix_lemma(F.col("token")).alias("lemma"))


# q13 T13 T15 J8 -------------------------------------------------------------
@query("q13_dict_lemma_pipeline")
def q13(spark, sf):
    from ..operators import tokens as tk
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    out = tk.nlp_pipeline(d, "review_id", "text", tk.lemma_dictionary_df(spark),
                          tk.stopword_table(spark, ("general", "nlp_domain")))
    return out.select("review_id", "cleaned_review",
                      tx.word_count("cleaned_review").cast("bigint").alias("cleaned_word_count"),
                      F.length("cleaned_review").cast("bigint").alias("cleaned_char_count"))


# q14 O3 M5 W6 ---------------------------------------------------------------
@query("q14_top_bigrams_by_class")
def q14(spark, sf):
    from ..operators import tokens as tk
    d = _docs(spark, sf).select("doc_id", "text").join(
        _labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied")), "doc_id")
    toks = F.filter(tx.split_ws(tx.clean_letters("text")), lambda t: F.length(t) >= 2)
    d = d.select("satisfied", toks.alias("toks"))   # a column, so the n-gram lambda does not re-clean
    counts = tk.term_counts(d, ["satisfied"], tk.ngrams(F.col("toks"), 2))
    top = tk.top_k_per_group(counts, ["satisfied"], "term", "n", 15)
    return top.select("satisfied", F.col("term").alias("bigram"), F.col("n").cast("bigint").alias("n"),
                      F.col("rank").cast("bigint").alias("rank"))


# q15 A13 O4 -----------------------------------------------------------------
@query("q15_word_freq_by_class")
def q15(spark, sf):
    from ..operators import tokens as tk
    d = _docs(spark, sf).select("doc_id", "text").join(
        _labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied")), "doc_id")
    toks = tx.drop_stopwords(tx.split_ws(tx.clean_letters("text")), dims.stopwords("wordfreq"))
    d = d.select("satisfied", toks.alias("toks"))
    counts = tk.term_counts(d, ["satisfied"], F.concat("toks", tk.ngrams(F.col("toks"), 2)))
    top = tk.top_k_per_group(counts, ["satisfied"], "term", "n", 150)
    return top.select("satisfied", "term", F.col("n").cast("bigint").alias("n"),
                      F.col("rank").cast("bigint").alias("rank"))


# q16 A14 U3 -----------------------------------------------------------------
@query("q16_vocabulary")
def q16(spark, sf):
    d = _docs(spark, sf).select("lang", "text")
    before = d.select("lang", F.explode(tx.split_ws(F.lower("text"))).alias("w"))
    after = d.select("lang", F.explode(tx.tokenize(tx.nlp_clean_string("text"))).alias("w"))
    vb = before.distinct().groupBy("lang").agg(F.count("*").alias("vocab_before"))   # U3
    va = after.distinct().groupBy("lang").agg(F.count("*").alias("vocab_after"))
    out = vb.join(va, "lang", "left")
    return out.select("lang", F.col("vocab_before").cast("bigint").alias("vocab_before"),
                      F.coalesce("vocab_after", F.lit(0)).cast("bigint").alias("vocab_after"),
                      F.round((1 - F.coalesce("vocab_after", F.lit(0)) / F.col("vocab_before")) * 100, 2)
                      .alias("reduction_pct"))


# profiling inputs -------------------------------------------------------------
def _features(spark, sf, labelled: bool = False):
    from ..operators.features import review_features
    d = _docs(spark, sf).select("doc_id", "text", "n_chars")
    if labelled:
        d = d.join(_labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied"), "toxic"), "doc_id")
    keep = ["doc_id", "n_chars"] + (["satisfied", "toxic"] if labelled else [])
    return review_features(d, "text", keep)


DESCRIBE_COLS = ["char_count", "word_count", "avg_word_length", "exclamation_count", "uppercase_ratio", "n_chars"]
CORR_COLS = ["review_length", "review_word_count", "title_length", "neg", "neu", "pos", "compound", "satisfied",
             "char_count", "word_count", "avg_word_length", "exclamation_count", "question_count", "uppercase_ratio"]


def _corr_features(spark, sf):
    """Length, lexicon and text features of the labelled reviews."""
    from ..operators.features import review_features
    from ..operators.sentiment import lexicon_scores
    lab = _labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied"))
    d = _docs(spark, sf).select("doc_id", "text").join(lab, "doc_id")
    d = d.select("*", F.length("text").alias("review_length"), tx.word_count("text").alias("review_word_count"),
                 F.length(tx.first_line("text")).alias("title_length"))
    f = review_features(d, "text", ["doc_id", "satisfied", "review_length", "review_word_count", "title_length"])
    s = lexicon_scores(d, "doc_id", "text", dims.lexicon_df(spark, QUERY_LEXICON), dims.booster_df(spark, QUERY_BOOSTERS),
                       QUERY_NEGATIONS, QUERY_CONTRAST)
    return f.join(s, "doc_id")


# q17 A2 ---------------------------------------------------------------------
@query("q17_describe")
def q17(spark, sf):
    from ..operators.profile import describe
    return describe(_features(spark, sf), DESCRIBE_COLS, dp=3)


# q18 A4 A5 W7 ---------------------------------------------------------------
@query("q18_value_counts_filled")
def q18(spark, sf):
    from ..operators.profile import value_counts_filled
    lab = _labels(spark, sf)
    cats = dims.local_table(spark, [(0,), (1,)], "category int")
    parts = [value_counts_filled(lab.select(F.col(c).alias("category")), "category", cats)
             .select(F.lit(c).alias("column_name"), "*") for c in ("quality", "toxic")]
    return parts[0].unionByName(parts[1])


# q19 A6 A10 -----------------------------------------------------------------
@query("q19_group_stats")
def q19(spark, sf):
    from ..operators.profile import group_stats
    d = _docs(spark, sf).join(_labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied")), "doc_id")
    d = d.select("satisfied", F.length("text").alias("review_length"),
                 tx.word_count("text").alias("review_word_count"),
                 F.length(tx.first_line("text")).alias("title_length"))
    out = group_stats(d, "satisfied", ["review_length", "review_word_count", "title_length"], dp=1)
    return out.withColumn("n", F.col("n").cast("bigint"))


# q20 A7 ---------------------------------------------------------------------
@query("q20_histogram")
def q20(spark, sf):
    from ..operators.profile import histogram
    return histogram(_docs(spark, sf), "n_chars", 50)


# q21 A8 J9 ------------------------------------------------------------------
@query("q21_kde")
def q21(spark, sf):
    from ..operators.profile import kde
    d = _docs(spark, sf).select("doc_id", "n_chars").join(
        _labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied")), "doc_id")
    return kde(d, "n_chars", "satisfied", points=1000)


# q22 A9 ---------------------------------------------------------------------
@query("q22_box_stats")
def q22(spark, sf):
    from ..operators.profile import box_stats
    d = _docs(spark, sf).join(_labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied")), "doc_id")
    return box_stats(d.select("satisfied", F.length("text").alias("review_length")), "review_length", "satisfied")


# q23 A11 --------------------------------------------------------------------
@query("q23_corr_matrix")
def q23(spark, sf):
    from ..operators.profile import corr_pairs
    return corr_pairs(_corr_features(spark, sf), CORR_COLS)


# q24 A12 O1 -----------------------------------------------------------------
@query("q24_target_corr")
def q24(spark, sf):
    from pyspark.sql import Window
    f = _corr_features(spark, sf)
    cols = [c for c in CORR_COLS if c != "satisfied"]
    from ..operators.profile import corr
    wide = f.agg(*[corr(c, "satisfied").alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) as (feature, corr)")
    long = long.select("feature", F.round("corr", 6).alias("corr"))
    # 13 rows: a global ordering window is fine here
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("corr"), "feature")).cast("bigint"))


# q25 A15 --------------------------------------------------------------------
@query("q25_text_comparison")
def q25(spark, sf):
    from ..operators import tokens as tk
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    from ..session import cut_lineage
    # written once: both the statistics and the vocabulary read it
    clean = cut_lineage(tk.nlp_pipeline(d, "review_id", "text", tk.lemma_dictionary_df(spark),
                                        tk.stopword_table(spark, ("general", "nlp_domain"))))

    per_doc = (d.select(F.lit("original").alias("stage"), F.length("text").alias("c"), tx.word_count("text").alias("w"))
               .unionByName(clean.select(F.lit("cleaned").alias("stage"), F.length("cleaned_review").alias("c"),
                                         tx.word_count("cleaned_review").alias("w"))))
    stats = per_doc.groupBy("stage").agg(
        F.round(F.avg("c"), 2).alias("mean_chars"), F.round(F.avg("w"), 2).alias("mean_words"),
        F.round(F.avg(F.col("c") / F.greatest(F.col("w"), F.lit(1))), 3).alias("mean_word_length"),
        F.min("w").cast("bigint").alias("min_words"), F.max("w").cast("bigint").alias("max_words"),
        F.sum("w").alias("total_words"))
    words = (d.select(F.lit("original").alias("stage"), F.explode_outer(tx.split_ws(F.lower("text"))).alias("v"))
             .unionByName(clean.select(F.lit("cleaned").alias("stage"),
                                       F.explode_outer(tx.split_ws("cleaned_review")).alias("v"))))
    # outer, then a filter: no inferred size() filter that splits the text a second time
    vocab = words.where("v IS NOT NULL").distinct().groupBy("stage").agg(F.count("*").cast("bigint").alias("vocab"))   # U3
    both = stats.join(vocab, "stage")      # two rows each
    from pyspark.sql import Window
    orig_total = F.max(F.when(F.col("stage") == "original", F.col("total_words"))).over(Window.partitionBy())
    return both.select("stage", "mean_chars", "mean_words", "mean_word_length", "min_words", "max_words", "vocab",
                       F.round(F.col("total_words") * 100.0 / orig_total, 2).alias("words_vs_original_pct"))


# q26 A16 --------------------------------------------------------------------
@query("q26_word_reduction")
def q26(spark, sf):
    from ..functions.lemma import serving_tokens
    d = _docs(spark, sf).join(_labels(spark, sf).select("doc_id", F.col("quality").alias("satisfied")), "doc_id")
    d = d.select("satisfied", tx.word_count("text").alias("before"), F.size(serving_tokens("text")).alias("after"))
    red = F.try_divide((F.col("before") - F.col("after")) * 100.0, F.col("before"))
    d = d.select("satisfied", red.alias("reduction_pct"))
    return d.groupBy("satisfied").agg(
        F.count("*").cast("bigint").alias("n"),
        F.round(F.avg("reduction_pct"), 2).alias("mean_reduction_pct"),
        F.round(F.min("reduction_pct"), 2).alias("min_reduction_pct"),
        F.round(F.max("reduction_pct"), 2).alias("max_reduction_pct"))


# q27 O7 A26 -----------------------------------------------------------------
@query("q27_seeded_sample")
def q27(spark, sf):
    from ..operators.profile import null_indicators
    d = _docs_left_labels(spark, sf).select(
        F.col("doc_id").alias("review_id"), "lang", "quality", "toxic",
        tx.seeded_order_key("doc_id", 42).alias("sample_key"))
    # the sample size is the feature: TakeOrderedAndProject keeps 200 rows per partition
    s = d.orderBy("sample_key").limit(200)
    return null_indicators(s, ["quality", "toxic"])


# sentiment queries -----------------------------------------------------------
# Query lexicon: words frequent in the driver's English documents with
# arbitrary valences (the driver text is invented, so a real lexicon would
# hardly hit).  The same lists are used by the oracle SQL.
QUERY_LEXICON = [
    ("the", 1.2), ("of", -1.6), ("and", 0.7), ("to", -0.4), ("in", 0.9), ("is", -1.1),
    ("that", 2.0), ("for", -2.3), ("it", 1.5), ("was", -0.8), ("on", 0.6), ("with", -1.9),
    ("be", 0.3), ("are", 1.1), ("from", -1.3), ("rewh", 2.6), ("th", -2.7), ("er", 1.8),
    ("ha", -0.9), ("re", 0.4), ("he", -0.6), ("en", 1.0), ("es", -1.4), ("ti", 0.2),
    ("ed", -2.1), ("ing", 1.7), ("nt", -0.3), ("ly", 2.2), ("tion", -1.5), ("orre", 3.1),
]
QUERY_BOOSTERS = [("by", 0.293), ("this", 0.293), ("at", -0.293), ("or", -0.293), ("an", 0.293), ("to", 0.293)]
QUERY_NEGATIONS = ["a", "nd", "ou", "st"]
QUERY_CONTRAST = "as"


def _scored(spark, sf, text_expr=None):
    from ..operators.sentiment import lexicon_scores
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"),
                 (text_expr if text_expr is not None else F.col("text")).alias("t"))
    return lexicon_scores(d, "review_id", "t", dims.lexicon_df(spark, QUERY_LEXICON),
                          dims.booster_df(spark, QUERY_BOOSTERS), QUERY_NEGATIONS, QUERY_CONTRAST)


# q28 N1 N2 W5 ---------------------------------------------------------------
@query("q28_lexicon_sentiment")
def q28(spark, sf):
    return _scored(spark, sf)


def _two_scorers(spark, sf):
    """Scorer A: lexicon on the review text; scorer B (a stand-in for a batch
    classifier, P8): label and confidence from the lexicon on title + review."""
    from ..operators.sentiment import lexicon_scores
    # both texts of a row go through one scoring; its row number brings them together again, so rows stay rows
    texts = F.array(F.struct(F.lit("a").alias("which"), F.col("text").alias("t")),
                    F.struct(F.lit("b").alias("which"), tx.combine_title_review(tx.first_line("text"), F.col("text")).alias("t")))
    # numbered before the explode: in one select the number would be made after it
    d = _docs(spark, sf).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("review_id"), texts.alias("texts"))
    d = d.select("row", "review_id", F.explode("texts").alias("x"))
    s = lexicon_scores(d.select("row", "review_id", "x.which", "x.t"), "row", "t", dims.lexicon_df(spark, QUERY_LEXICON),
                       dims.booster_df(spark, QUERY_BOOSTERS), QUERY_NEGATIONS, QUERY_CONTRAST, carry=["review_id", "which"])
    j = s.groupBy("row", "review_id").agg(*[F.max(F.when(F.col("which") == w, F.col("compound"))).alias(n) for w, n in (("a", "compound"), ("b", "other"))])
    j = j.select("review_id", "compound", F.when(F.col("other") >= 0, "POSITIVE").otherwise("NEGATIVE").alias("raw_label"),
                 F.abs("other").alias("confidence"))
    return j.select(
        "review_id",
        lb.three_class("compound").alias("lexicon_label"),            # P7
        F.col("compound").alias("lexicon_score"),
        "raw_label", "confidence",
        F.round(lb.classifier_signed_score("raw_label", "confidence"), 4).alias("model_score"),   # P8
        lb.classifier_label("raw_label", "confidence").alias("model_label"),
    )


# q29 P8–P12 T26 -------------------------------------------------------------
@query("q29_sentiment_labels")
def q29(spark, sf):
    j = _two_scorers(spark, sf)
    return j.select(
        "*",
        F.col("lexicon_label").alias("sentiment_label"),                # P12
        F.col("lexicon_score").alias("sentiment_score"),
        F.round(tx.score_to_percent("lexicon_score"), 3).alias("score_pct"),   # T26
        lb.label_to_binary("lexicon_label").alias("lexicon_bin"),      # P9
        lb.label_to_binary("model_label", conservative=True).alias("model_bin_cons"),
        lb.agrees("lexicon_label", "model_label").alias("agree"),      # P10
    )


LABEL_ORDER = ["Negative", "Neutral", "Positive"]


def _label_grid(spark):
    return dims.local_table(spark, [(a, b) for a in LABEL_ORDER for b in LABEL_ORDER],
                            "lexicon_label string, model_label string")


# q30 A20 A17 ----------------------------------------------------------------
@query("q30_model_agreement")
def q30(spark, sf):
    j = _two_scorers(spark, sf)
    counts = j.groupBy("lexicon_label", "model_label").agg(F.count("*").alias("n"))
    full = _label_grid(spark).join(counts, ["lexicon_label", "model_label"], "left") \
        .select("lexicon_label", "model_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    # totals from the 9-row grid (a bounded window), not from scalar
    # subqueries that would re-run both scorers
    from pyspark.sql import Window
    w = Window.partitionBy()
    total = F.sum("n").over(w)
    agree = F.sum(F.when(F.col("lexicon_label") == F.col("model_label"), F.col("n")).otherwise(0)).over(w)
    return full.select(
        "*",
        F.round(F.col("n") * 100.0 / total, 2).alias("pct"),
        F.round(agree.cast("double") / total, 4).alias("agreement_rate"),
        (total - agree).cast("bigint").alias("disagreements"))


# q31 A19 --------------------------------------------------------------------
@query("q31_disagreement_crosstab")
def q31(spark, sf):
    j = _two_scorers(spark, sf).where(F.col("lexicon_label") != F.col("model_label"))
    p = j.groupBy("lexicon_label").pivot("model_label", LABEL_ORDER).count().na.fill(0)
    return p.select("lexicon_label", *[F.col(c).cast("bigint").alias(c) for c in LABEL_ORDER])


# q32 A21 N4 ------------------------------------------------------------------
@query("q32_accuracy_coverage")
def q32(spark, sf):
    j = _two_scorers(spark, sf).join(_labels(spark, sf).select(F.col("doc_id").alias("review_id"), "quality"),
                                     "review_id")
    long = j.select("quality", F.expr("stack(2, 'lexicon', lexicon_label, 'model', model_label) as (scorer, label)"))
    long = long.withColumn("b", lb.label_to_binary("label"))
    covered = F.col("b") != -1
    # all figures come from the confusion cells (a few rows, written once)
    from ..session import cut_lineage
    every = cut_lineage(long.groupBy("scorer", "quality", "b").agg(F.count("*").alias("c")))
    n_covered = F.sum(F.when(covered, F.col("c")).otherwise(0))
    known = covered & F.col("quality").isNotNull()
    right = F.sum(F.when(known & (F.col("b") == F.col("quality")), F.col("c")).otherwise(0)).cast("double")
    base = every.groupBy("scorer").agg(
        F.sum("c").cast("bigint").alias("n"),
        n_covered.cast("bigint").alias("covered"),
        F.round(F.try_divide(right, F.sum(F.when(known, F.col("c")))), 4).alias("accuracy"),
        F.round(n_covered.cast("double") / F.sum("c") * 100, 2).alias("coverage_pct"))
    # Support-weighted F1 on covered rows
    cells = every.where(covered)
    by_actual = cells.groupBy("scorer", F.col("quality").alias("cls")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("quality") == F.col("b"), F.col("c")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy("scorer", F.col("b").alias("cls")).agg(F.sum("c").alias("npred"))
    st = by_actual.join(by_pred, ["scorer", "cls"], "full").na.fill(0, ["support", "tp", "npred"])
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    st = st.select("scorer", "support", p.alias("p"), r.alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    wf = st.groupBy("scorer").agg(F.round(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")), 4)
                                  .alias("weighted_f1"))
    out = base.join(wf, "scorer", "left")
    from pyspark.sql import Window
    best = F.max("weighted_f1").over(Window.partitionBy())   # one row per scorer
    return out.withColumn("is_winner", F.col("weighted_f1") == best)


# q33 A22 U2 N4 --------------------------------------------------------------
@query("q33_label_mix_by_class")
def q33(spark, sf):
    j = _two_scorers(spark, sf).join(_labels(spark, sf).select(F.col("doc_id").alias("review_id"), "quality"),
                                     "review_id")
    # One row per scorer, without scoring twice for a union
    both = j.select(F.col("quality").alias("actual"), F.expr("stack(2, 'lexicon', lexicon_label, 'model', model_label) as (scorer, label)"))
    counts = both.groupBy("scorer", "actual", "label").agg(F.count("*").alias("n"))
    grid = dims.local_table(spark, [(s, c, lab) for s in ("lexicon", "model") for c in (0, 1) for lab in LABEL_ORDER],
                            "scorer string, actual int, label string")
    full = grid.join(counts, ["scorer", "actual", "label"], "left") \
        .select("scorer", "actual", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("scorer", "actual")   # 12-row grid
    return full.withColumn("pct_of_class", F.round(F.try_divide(F.col("n") * 100.0, F.sum("n").over(w)), 2))


# topics and recommendations ---------------------------------------------------
@query("q34_detect_topic")
def q34(spark, sf):
    from ..operators.topics import detect_topic
    docs = _docs(spark, sf).select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                   F.lit(0).cast("bigint").alias("turn"), "text")
    conv = tb.table(spark, sf, "conversations").select(
        F.lit("conv").alias("src"), F.col("conv_id").alias("id"), "turn", "text")
    u = docs.unionByName(conv)
    return u.select("src", "id", "turn", detect_topic("text", "lambda").alias("topic"),
                    detect_topic("text", "app").alias("topic_app"))


@query("q35_topic_rollup")
def q35(spark, sf):
    from pyspark.sql import Window
    from ..operators.topics import detect_topic
    c = _docs(spark, sf).select(detect_topic("text").alias("topic")).groupBy("topic").agg(
        F.count("*").cast("bigint").alias("n"))
    # at most 11 topic rows: the global ranking window is bounded
    r = c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "topic")).cast("bigint"))
    return r.where(F.col("rank") <= 10)


def _reviews(spark, sf, keep=()):
    """E1 over all documents: one scan, one shuffle of small rows."""
    from ..operators.score import score_reviews
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text",
                                *([F.substring("text", 1, 1000).alias("prompt_review")] if "prompt_review" in keep else []))
    return score_reviews(d, "review_id", "text", _query_scoring(spark), keep=list(keep))


@query("q36_recommend")
def q36(spark, sf):
    return _reviews(spark, sf).select("review_id", F.col("detected_topic").alias("topic"), "sentiment_score",
                                      "predicted_satisfaction", "action", "priority", "owner", "kpi")


@query("q37_recommend_report")
def q37(spark, sf):
    from ..operators.recommend import first_per_group, priority_rank, recommend, round_robin_topics
    s = _scored(spark, sf)
    neg = s.where(lb.three_class("compound") == "Negative").select(
        "review_id", F.col("compound").alias("sentiment_score"), F.lit(0).alias("satisfied"))
    topics = [t for t, _ in dims.TOPIC_PRIORITY]
    rr = round_robin_topics(neg, spark, "review_id", topics)
    rec = recommend(rr, spark, "topic", "sentiment_score", "satisfied").withColumn("prio_rank", priority_rank("priority"))
    rec = first_per_group(rec, "topic", ["prio_rank", "review_id"])
    return rec.select("review_id", "topic", "sentiment_score", "predicted_satisfaction", "action", "priority",
                      "owner", "kpi", F.col("prio_rank").cast("int").alias("prio_rank"), "is_topic_sample") \
        .orderBy("prio_rank", "review_id")


@query("q38_prompt_table")
def q38(spark, sf):
    from ..operators.recommend import prompt_text
    d = _reviews(spark, sf, ("prompt_review",))
    cols = ("prompt_review", "sentiment_label", "sentiment_score", "predicted_satisfaction", "detected_topic", "confidence")
    return d.select("review_id", prompt_text(*cols).alias("prompt"), prompt_text(*cols, form="short").alias("short_prompt"))


@query("q39_canned_reply")
def q39(spark, sf):
    from ..operators.recommend import canned_reply, fallback_text
    r = _reviews(spark, sf).withColumnRenamed("detected_topic", "topic")
    c = canned_reply(r, spark, "topic", "sentiment_score", "predicted_satisfaction")
    return c.select("review_id", "topic", "reply", fallback_text("action").alias("fallback_text"),
                    F.lit("fallback").alias("genai_source"))


# split, folds, evaluation -------------------------------------------------------
@query("q40_stratified_split")
def q40(spark, sf):
    from ..operators.split import stratified_split
    s = stratified_split(_labels(spark, sf).select("doc_id", "quality"), "doc_id", "quality")
    return s.select("doc_id", "quality", F.col("rn").cast("bigint").alias("rn"), "split")


@query("q41_folds")
def q41(spark, sf):
    from ..operators.split import stratified_folds, stratified_split
    s = stratified_split(_labels(spark, sf).select("doc_id", "quality"), "doc_id", "quality")
    train = s.where(F.col("split") == "train").select("doc_id", "quality")
    return stratified_folds(train, "doc_id", "quality", k=5).select("doc_id", "quality", "fold")


def _rule_predictions(spark, sf):
    s = _scored(spark, sf)
    return s.join(_labels(spark, sf).select(F.col("doc_id").alias("review_id"), "quality"), "review_id").select(
        "review_id", "quality", "compound", lb.satisfied_from_compound("compound").alias("pred"))


@query("q42_classification_report")
def q42(spark, sf):
    from ..operators.evaluate import classification_report
    return classification_report(_rule_predictions(spark, sf), "quality", "pred")


@query("q43_roc_auc")
def q43(spark, sf):
    from ..operators.evaluate import roc_points
    return roc_points(_rule_predictions(spark, sf), "compound", "quality")


# request edge, prediction log, trend ---------------------------------------------
def _query_scoring(spark):
    from ..operators.score import Scoring
    return Scoring(spark, dims.lexicon_df(spark, QUERY_LEXICON), dims.booster_df(spark, QUERY_BOOSTERS),
                   QUERY_NEGATIONS, QUERY_CONTRAST)


def _requests(spark, sf):
    from ..sources.requests import build_requests
    # every turn is a request; four of twelve come in the malformed shapes
    rid = F.col("conv_id") * 1000 + F.col("turn")
    k = rid % 12
    c = tb.table(spark, sf, "conversations").select(
        rid.alias("request_id"), "text",
        F.when(k == 8, "object").when(k == 9, "broken").when(k == 10, "text").when(k == 11, "number")
        .when(k % 2 == 0, "gateway").otherwise("direct").alias("shape"))
    return build_requests(c, "request_id", "text", "shape")


@query("q44_request_parse_respond")
def q44(spark, sf):
    from ..sources.requests import respond
    return respond(_requests(spark, sf), "request_id", "payload", _query_scoring(spark))


@query("q45_prediction_log")
def q45(spark, sf):
    from ..operators.score import score_reviews
    from ..sources.predlog import append_log, log_rows
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    rows = log_rows(score_reviews(d, "review_id", "text", _query_scoring(spark)))
    path = os.path.join(ensure_checkpoint_dir(spark), f"predlog-{uuid.uuid4().hex}")
    append_log(rows, path)
    back = spark.read.parquet(path)
    return back.select("prediction_id", "review_snippet", "sentiment_label", "sentiment_score",
                       "predicted_satisfaction", "confidence", "detected_topic", "priority")


@query("q46_topic_trend")
def q46(spark, sf):
    from ..streaming.trend import daily_trend
    from ..operators.score import score_reviews
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    s = score_reviews(d, "review_id", "text", _query_scoring(spark))
    ev = tb.table(spark, sf, "events").select(F.col("event_id").alias("review_id"), "ts")
    return daily_trend(s.join(ev, "review_id"), "ts")


# features -------------------------------------------------------------------------
def _clean_docs(spark, sf):
    """(review_id, text): the cleaned documents, written once, since vocabulary and counts both read them."""
    from ..session import cut_lineage
    return cut_lineage(_docs(spark, sf).select(F.col("doc_id").alias("review_id"), tx.clean_letters("text").alias("text")))


def _vec_terms(df, text_col, stop=None):
    """Terms of cleaned texts."""
    from ..operators import tokens as tk
    toks = tk.vectorizer_tokens(text_col)
    if stop:
        toks = tx.drop_stopwords(toks, stop)
    d = df.select("review_id", toks.alias("toks"))
    return d.select("review_id", F.concat("toks", tk.ngrams(F.col("toks"), 2)).alias("terms"))


@query("q47_tfidf")
def q47(spark, sf):
    from ..operators.features import counted_frequencies, counted_vocabulary, tfidf
    d = _clean_docs(spark, sf)
    t = _vec_terms(d, "text")
    n_docs = d.agg(F.count("*")).scalar()
    voc = counted_vocabulary(t, "review_id", F.col("terms"), n_docs, 5000, min_df=3, max_df=0.95)
    w = tfidf(counted_frequencies(t, "review_id", F.col("terms"), voc), voc, "review_id", n_docs, sublinear=True)
    return w.select("review_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query("q48_count_vectors")
def q48(spark, sf):
    from ..operators.features import counted_frequencies, counted_vocabulary
    d = _clean_docs(spark, sf)
    t = _vec_terms(d, "text", stop=dims.stopwords("general"))
    n_docs = d.agg(F.count("*")).scalar()
    voc = counted_vocabulary(t, "review_id", F.col("terms"), n_docs, 3000, min_df=3)
    return counted_frequencies(t, "review_id", F.col("terms"), voc).select(
        "review_id", "term", F.col("tf").cast("bigint").alias("n"))


SCALED_COLS = ["char_count", "word_count", "avg_word_length", "exclamation_count", "uppercase_ratio"]


@query("q49_scaled_features")
def q49(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from ..operators.split import stratified_split
    f = _features(spark, sf, labelled=True).na.fill(0.0, ["avg_word_length"])
    sp = stratified_split(_labels(spark, sf).select("doc_id", "quality"), "doc_id", "quality")
    j = f.join(sp.select("doc_id", "split"), "doc_id")                         # J7
    pipe = Pipeline(stages=[VectorAssembler(inputCols=SCALED_COLS, outputCol="raw"),      # M7
                            StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True)])  # M6
    model = pipe.fit(j.where(F.col("split") == "train"))                       # fit on train only (C12)
    z = model.transform(j).withColumn("za", vector_to_array("z"))
    return z.select(F.col("doc_id").alias("review_id"), "split",
                    *[F.round(F.col("za")[i], 6).alias(f"z_{c}") for i, c in enumerate(SCALED_COLS)])


# models, LDA, batch scorer plug-in, stream ------------------------------------------
MODEL_NUMERIC = ["char_count", "word_count", "avg_word_length", "exclamation_count", "question_count",
                 "uppercase_ratio", "neg", "neu", "pos", "compound"]


def _model_data(spark, sf):
    from ..operators.features import review_features
    from ..operators.split import stratified_folds, stratified_split
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    f = review_features(d, "text", ["review_id", "text"]).na.fill(0.0, ["avg_word_length"])
    s = _scored(spark, sf)
    lab = _labels(spark, sf).select(F.col("doc_id").alias("review_id"), F.col("quality").alias("label"))
    sp = stratified_split(lab, "review_id", "label")
    folds = stratified_folds(sp.where(F.col("split") == "train").select("review_id", "label"), "review_id", "label")
    sp = sp.join(folds.select("review_id", "fold"), "review_id", "left")
    return f.join(s, "review_id").join(sp.select("review_id", "label", "split", "fold"), "review_id")


@query("q50_train_compare")
def q50(spark, sf):
    from ..operators.train import train_compare
    save = os.path.join(ensure_checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    comp, _, _ = train_compare(_model_data(spark, sf), "text_processed", MODEL_NUMERIC, size="full",
                               k_folds=5, vocab_size=5000, min_df=3.0, max_df=0.95, save_dir=save)
    return comp


@query("q64_trained_serving")
def q64(spark, sf):
    """A model trained on the labelled documents, published, loaded again and
    served over all documents (S4, M9, E1)."""
    from ..operators import registry
    from ..operators.score import score_reviews
    from ..operators.train import train_compare
    root = os.path.join(ensure_checkpoint_dir(spark), f"registry-{uuid.uuid4().hex}")
    train_compare(_model_data(spark, sf), "text_processed", MODEL_NUMERIC, size="small", k_folds=2, save_dir=root)
    cfg = _query_scoring(spark)
    cfg.model = registry.load(spark, f"{root}/registry")
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    return score_reviews(d, "review_id", "text", cfg).select(
        "review_id", "predicted_satisfaction", "confidence", F.col("detected_topic").alias("topic"), "priority")


@query("q51_lda_topics")
def q51(spark, sf):
    from ..operators.lda import lda_topics
    from ..session import cut_lineage
    s = _scored(spark, sf).where(lb.three_class("compound") == "Negative")     # L1
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text").join(s.select("review_id"), "review_id")
    # cleaned behind the join: the negative texts only
    neg = d.select("review_id", tx.clean_letters("text").alias("cleaned_review")).na.drop(subset=["cleaned_review"])  # P13
    return lda_topics(cut_lineage(neg), "cleaned_review", k=10, max_iter=30, vocab_size=3000, min_df=3.0, seed=42)


def length_parity_scorer():
    """Stand-in for a pre-trained text classifier (N3): loaded once per task,
    scores a list of texts; label by length parity, confidence from length."""
    def score(texts):
        return (["POSITIVE" if len(t) % 2 == 0 else "NEGATIVE" for t in texts],
                [round((len(t) % 100) / 100.0, 4) for t in texts])
    return score


@query("q52_batch_model_score")
def q52(spark, sf):
    from ..operators.sentiment import score_batches
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    s = score_batches(d, "text", length_parity_scorer, batch_size=32, max_chars=1500)
    return s.select("review_id", "raw_label", "confidence",
                    F.round(lb.classifier_signed_score("raw_label", "confidence"), 4).alias("model_score"),
                    lb.classifier_label("raw_label", "confidence").alias("model_label"))


@query("q53_stream_score")
def q53(spark, sf):
    from ..streaming.score_stream import start_scoring_stream
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    # the arriving files: the documents table cut into files of as many partitions as the session shuffles into
    _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text").repartition("review_id") \
        .write.parquet(f"{base}/incoming")
    q = start_scoring_stream(spark, f"{base}/incoming", f"{base}/log", f"{base}/checkpoint", _query_scoring(spark))
    q.awaitTermination()
    return spark.read.parquet(f"{base}/log").select(
        "prediction_id", "review_snippet", "sentiment_label", "sentiment_score", "predicted_satisfaction",
        "confidence", "detected_topic", "priority")


# serving, and operators whose inputs are derived from the tables ---------------------
def served_rule_model(path: str):
    """A pipeline of fixed coefficients, saved and loaded again."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    from ..operators.score import load_model
    logit = ("-0.2 + 1.5 * compound + 0.8 * pos - 1.1 * neg - 0.01 * exclamation_count + 0.5 * uppercase_ratio"
             " + 0.0001 * word_count")
    PipelineModel(stages=[
        SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({logit}))) AS probability FROM __THIS__"),
        SQLTransformer(statement="SELECT *, CAST(probability >= 0.5 AS DOUBLE) AS prediction FROM __THIS__"),
    ]).write().overwrite().save(path)
    return load_model(path)


# q54 S4 E1 M9 -------------------------------------------------------------------
@query("q54_model_serving")
def q54(spark, sf):
    from ..operators.score import score_reviews
    cfg = _query_scoring(spark)
    cfg.model = served_rule_model(os.path.join(ensure_checkpoint_dir(spark), f"served-{uuid.uuid4().hex}"))
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    return score_reviews(d, "review_id", "text", cfg).select(
        "review_id", "predicted_satisfaction", "confidence", F.col("detected_topic").alias("topic"), "priority")


# q55 A18 ------------------------------------------------------------------------
@query("q55_confusion_row_pct")
def q55(spark, sf):
    from ..operators.evaluate import confusion_with_row_pct
    return confusion_with_row_pct(_rule_predictions(spark, sf), "quality", "pred", [0, 1])


# q56 J5 A24 L6 ------------------------------------------------------------------
@query("q56_topic_names")
def q56(spark, sf):
    from ..operators import tokens as tk
    from ..operators.topics import name_topic, rollup_by_name
    # the 40 most frequent letter runs of three or more of each source stand for a topic's top words
    d = _docs(spark, sf).where(F.col("source").isNotNull())
    toks = F.filter(tx.split_ws(tx.clean_letters("text")), lambda t: F.length(t) >= 3)
    top = tk.top_k_per_group(tk.term_counts(d, ["source"], toks), ["source"], "term", "n", 40)
    words = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
    table = words.select("source", F.array_join(F.transform("w", lambda s: s["term"]), " ").alias("Top_Words")).join(
        d.groupBy("source").agg(F.count("*").alias("Count")), "source")
    named = table.withColumn("Business_Name", F.coalesce(name_topic(F.col("Top_Words")), F.lit("Unnamed")))
    return rollup_by_name(named)


# q57 O4 -------------------------------------------------------------------------
@query("q57_top_cleaned_words")
def q57(spark, sf):
    from ..operators import tokens as tk
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text")
    clean = tk.nlp_pipeline(d, "review_id", "text", tk.lemma_dictionary_df(spark),
                            tk.stopword_table(spark, ("general", "nlp_domain")))
    counts = tk.term_counts(clean, [], tx.split_ws("cleaned_review"))
    return counts.orderBy(F.desc("n"), "term").limit(20).select(F.col("term").alias("word"), F.col("n").cast("bigint").alias("n"))


# q58 P16 ------------------------------------------------------------------------
@query("q58_head_and_rows")
def q58(spark, sf):
    from ..sources.tables import head_rows, rows_at
    d = tb.reviews(spark, sf).select("review_id", "title")
    head = head_rows(d, "review_id", 5).select(F.lit("head").alias("part"), "*")
    return head.unionByName(rows_at(d, "review_id", [0, 42, 150]).select(F.lit("picked").alias("part"), "*"))


# q59 M3 -------------------------------------------------------------------------
@query("q59_tfidf_min2")
def q59(spark, sf):
    from ..operators.features import counted_frequencies, counted_vocabulary, tfidf
    d = _clean_docs(spark, sf)
    t = _vec_terms(d, "text")
    n_docs = d.agg(F.count("*")).scalar()
    voc = counted_vocabulary(t, "review_id", F.col("terms"), n_docs, 5000, min_df=2)
    w = tfidf(counted_frequencies(t, "review_id", F.col("terms"), voc), voc, "review_id", n_docs, sublinear=True)
    return w.select("review_id", "term", F.round("tfidf", 6).alias("tfidf"))


# q60 O5 M14 ---------------------------------------------------------------------
@query("q60_top_features")
def q60(spark, sf):
    from ..operators.features import term_frequencies
    from ..operators.train import top_by_importance
    lab = _labels(spark, sf).select(F.col("doc_id").alias("review_id"), "quality")
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), "text").join(lab, "review_id")
    tf = term_frequencies(_vec_terms(d, tx.clean_letters("text")), "review_id", F.col("terms")).join(lab, "review_id")
    # a linear term's coefficient: the difference of the classes' document counts
    coef = tf.groupBy("term").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("c"))
    imp = coef.select(F.col("term").alias("idx"), F.col("term").alias("feature"), F.lit("term").alias("kind"),
                      F.abs("c").cast("double").alias("importance"))
    return top_by_importance(imp, 25).drop("idx")


# q61 O7 -------------------------------------------------------------------------
@query("q61_disagreement_sample")
def q61(spark, sf):
    j = _two_scorers(spark, sf).where(F.col("lexicon_label") != F.col("model_label"))
    s = j.withColumn("sample_key", tx.seeded_order_key("review_id", 42))
    # the sample size is the feature
    return s.orderBy("sample_key").limit(8).select("review_id", "lexicon_label", "lexicon_score", "model_label", "model_score")


# q62 M2 as vectors ----------------------------------------------------------------
@query("q62_tfidf_vectors")
def q62(spark, sf):
    from ..operators.train import feature_pipeline
    from ..operators.trees import sparse_rows
    d = _docs(spark, sf).select(F.col("doc_id").alias("review_id"), tx.clean_letters("text").alias("t"))
    model = feature_pipeline("t", [], vocab_size=5000, min_df=3.0, max_df=0.95).fit(d)
    vocab = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    terms = dims.local_table(spark, list(enumerate(vocab)), "i int, term string")
    stored = sparse_rows(model.transform(d), "text_vec", "review_id long")      # the stored entries only
    cells = stored.select("review_id", F.explode(F.arrays_zip("ids", "xs")).alias("c")).select("review_id", F.col("c.ids").alias("i"), F.col("c.xs").alias("x")).where("x <> 0")
    return cells.join(terms, "i").select("review_id", "term", F.round("x", 6).alias("tfidf"))


# q63 T13 T15 with a long dictionary --------------------------------------------------
@query("q63_long_dictionary")
def q63(spark, sf):
    from ..operators import tokens as tk
    from ..session import cut_lineage
    # cleaned once: for the words' counts and for the pipeline
    d = cut_lineage(_docs(spark, sf).select(F.col("doc_id").alias("review_id"), tk.token_text("text").alias("cleaned")))
    # one lemma for each frequent word: its first four letters
    words = tk.term_counts(d, [], F.split("cleaned", " ")).where("n >= 20 AND length(term) > 4")
    lemmas = words.select(F.col("term").alias("token"), F.substring("term", 1, 4).alias("lemma"))
    out = tk.nlp_pipeline(d, "review_id", "text", lemmas, tk.stopword_table(spark, ("general", "nlp_domain")), cleaned_col="cleaned")
    return out.select("review_id", F.md5("cleaned_review").alias("cleaned_md5"))


# q65 J4 with thousands of keywords -----------------------------------------------------
@query("q65_keyword_automaton")
def q65(spark, sf):
    from ..operators.topics import detect_topic_table
    d = _docs(spark, sf).select("text")
    # the frequent words of the documents are keywords, in the order of a hash, searched in the conversations
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)
    common = d.select(F.explode_outer(words).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).where("n >= 3 AND keyword IS NOT NULL")
    keys = common.select(F.conv(F.substring(F.md5("keyword"), 1, 8), 16, 10).cast("long").alias("ord"),
                         F.concat(F.lit("topic "), F.substring("keyword", 1, 3)).alias("topic"), "keyword")
    c = tb.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")
    return detect_topic_table(c, "request_id", "text", keys).select("request_id", "topic")
