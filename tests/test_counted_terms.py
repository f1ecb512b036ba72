"""Term counting, cleaning and scoring without tables of all words: the same rows as the plain forms."""
import pytest
from pyspark.sql import functions as F

from oriel import dims
from oriel.functions import lemma as lm
from oriel.functions import text as tx
from oriel.operators import features as ft
from oriel.operators import sentiment as se
from oriel.operators import tokens as tk

ROWS = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (2, ["b", "d", None]), (2, ["b", "c"]), (None, ["c", "a"]), (None, ["c"]), (3, []), (4, None), (5, ["a", "e", "b"])]


@pytest.mark.parametrize("bounds", [(1, 1.0, 10), (2, 1.0, 10), (1, 0.5, 10), (1, 1.0, 2)])
def test_counted_terms_equal_the_table_of_all_pairs(spark, bounds):
    """Repeated and null ids are one document each, as in the table of pairs."""
    low, high, most = bounds
    df = spark.createDataFrame(ROWS, "id long, terms array<string>").repartition(3)
    tf = ft.term_frequencies(df, "id", F.col("terms"))
    want = ft.vocabulary(tf, "id", F.lit(len(ROWS)), most, min_df=low, max_df=high)
    voc = ft.counted_vocabulary(df, "id", F.col("terms"), F.lit(len(ROWS)), most, min_df=low, max_df=high)
    assert sorted(map(tuple, voc.collect())) == sorted(map(tuple, want.select("term", "df", "total").collect()))
    got = ft.counted_frequencies(df, "id", F.col("terms"), voc)
    assert sorted(map(str, got.collect())) == sorted(map(str, tf.join(voc.select("term"), "term").select("id", "term", "tf").collect()))


def test_other_terms_do_not_leave_their_task(spark):
    """before, every (document, term) pair was shuffled and written."""
    df = spark.createDataFrame([(i, ["x"] + [f"w{i}-{k}" for k in range(50)]) for i in range(20)], "id long, terms array<string>")
    voc = ft.counted_vocabulary(df, "id", F.col("terms"), F.lit(20), 5, min_df=2)
    bags = ft.term_bags(df, "id", F.col("terms"), [r["term"] for r in voc.collect()])
    assert bags.select(F.sum(F.size("bag"))).first()[0] == 20
    plan = bags._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nlp_pipeline_needs_no_shuffle_and_equals_the_join(spark, monkeypatch):
    """before, all tokens were sorted and put together again."""
    texts = ["The children were waiting; nationalisations, kindness &amp; hours!", None, "", "42 %", "the of", "Über-große Straßen flying",
             "a b delays cancelled http://x.y z@q.de", "“quoted” words – dashes…"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, text string")
    words, stop = tk.lemma_dictionary_df(spark), tk.stopword_table(spark, ("general", "nlp_domain"))
    out = tk.nlp_pipeline(df, "id", "text", words, stop)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(tk, "MAX_LISTED", 3)
    joined = tk.nlp_pipeline(df, "id", "text", words, stop)
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    assert got == sorted(map(tuple, joined.collect())) and any(t for _, t in got)


def test_lemma_of_a_word_equals_the_expression(spark):
    stems = ["a", "go", "walk", "happi", "natur", "straß", "x"]
    words = [s + x for s in stems for x, _ in dims.LEMMA_RULES] + stems
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm.suffix_lemma(F.col("w")).alias("l")).collect()
    assert {r["w"]: r["l"] for r in got} == {w: lm.suffix_lemma_word(w) for w in words}


def test_edge_punctuation_and_whitespace(spark):
    texts = ["«!!a!!» (b) '' -- \"word\" …x", "  x \t　y ", "&amp; “a”&lt;b – c", "   ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = F.transform(tx.split_ws("t"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    words = F.transform(F.arrays_zip(strip.alias("s"), tx.split_ws("t").alias("w")), lambda z: F.when(F.length(z["s"]) > 2, z["s"]).otherwise(z["w"]))
    squeezed = tx.strip_ws(F.regexp_replace("t", r"(?U)\s+", " "))
    punct = F.regexp_replace(F.regexp_replace("t", "[‘’“”„–—]", " "), r"(?U)&\w+;", " ")
    r = df.select(words, se.scorer_words(F.col("t")), squeezed, tx.squeeze_ws("t"),
                  tx.strip_ws(F.regexp_replace(tx.delete_ascii_punct(punct), r"(?U)\s+", " ")), tx.remove_punctuation("t")).collect()
    assert all(x[0] == x[1] and x[2] == x[3] and x[4] == x[5] for x in r)


def test_a_scorer_task_sees_the_cut_text_alone(spark):
    """F8: before, whole texts and all other columns went through the task's Python."""
    def factory():
        return lambda texts: (["SHORT" if len(t) <= 3 else "LONG" for t in texts], [float(len(t)) for t in texts])

    df = spark.createDataFrame([(1, "abcdef" * 1000, "k" * 5000), (2, None, None), (3, "a😀c", "")], "id long, text string, other string")
    out = se.score_batches(df, "text", factory, batch_size=2, max_chars=3)
    assert [(r["id"], r["raw_label"], r["confidence"]) for r in out.orderBy("id").collect()] == [(1, "SHORT", 3.0), (2, "SHORT", 0.0), (3, "SHORT", 3.0)]
    assert out.columns == ["id", "text", "other", "raw_label", "confidence"] and out.where("id = 1").first()["text"] == "abcdef" * 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "substring" in plan and "MapInPandas" not in plan
