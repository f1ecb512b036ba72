from pyspark.sql import functions as F

from expr_cases import one
from oriel.functions import labels as lb
from oriel.functions import lemma as lm
from oriel.functions import text as tx


def test_lower(spark):
    assert one(spark, tx.lower(F.col("x")), "Our FERRY was Moved TWICE!") == \
        "our ferry was moved twice!"


def test_urls_and_emails_keep_double_spaces(spark):
    s = "Look at https://ferry.example.org or write to desk@ferry.example.org for times"
    x = tx.remove_emails(tx.remove_urls(F.col("x"), "strict"), "dotted")
    assert one(spark, x, s) == "Look at  or write to  for times"


def test_normalize_quotes_each_end_on_its_own(spark):
    assert one(spark, tx.normalize_quotes(F.col("x")), "“Calm” sea  \n‘blue’") == "Calm\" sea 'blue"


def test_serving_cleaner(spark):
    assert one(spark, lm.serving_clean(F.col("x")), "The waiters were hasty and our soups arrived in 2 bowls.") == \
        "waiter hasty soup arriv bowl"


def test_suffix_lemmas(spark):
    words = ["curiously", "organised", "consultations", "kindness", "lawful", "hating", "cup", "'s"]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    got = [r[0] for r in df.select(lm.suffix_lemma(F.col("x"))).collect()]
    assert got == ["curious", "organise", "consultate", "kind", "law", "hat", "cup", "'s"]


def test_empty_text_features(spark):
    assert one(spark, tx.uppercase_ratio(F.col("x")), "") == 0.0
    assert one(spark, tx.word_count(F.col("x")), "") == 0
    assert one(spark, tx.word_count(F.col("x")), "   \n ") == 0
    assert one(spark, tx.safe_ratio(F.lit(0), F.lit(0)), "") is None


def test_label_gates(spark):
    df = spark.createDataFrame([(0.05,), (0.0,), (-0.05,)], "x double")
    got = df.select(lb.satisfied_from_compound("x"), lb.three_class("x")).collect()
    assert [tuple(r) for r in got] == [(1, "Positive"), (0, "Neutral"), (0, "Negative")]


def test_classifier_gate(spark):
    df = spark.createDataFrame([("NEGATIVE", 0.85), ("POSITIVE", 0.849)], "l string, c double")
    got = df.select(lb.classifier_signed_score("l", "c"), lb.classifier_label("l", "c")).collect()
    assert [tuple(r) for r in got] == [(-0.85, "Negative"), (0.849, "Neutral")]


def test_tokenize_and_stopwords_keep_duplicates(spark):
    toks = tx.tokenize(F.col("x"))
    kept = tx.drop_stopwords(toks, ["the", "was"])
    assert one(spark, kept, "the cabin the crew was x crew") == ["cabin", "crew", "crew"]


def test_ngrams(spark):
    from oriel.operators.tokens import ngrams
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(ngrams(F.col("t"), 2)).collect()]
    assert got == [["a b", "b c"], [], []]
    got3 = [r[0] for r in df.select(ngrams(F.col("t"), 3)).collect()]
    assert got3 == [["a b c"], [], []]


def test_sql_functions_match_columns(spark):
    from oriel.functions.sql import register_sql_functions
    from oriel.operators import recommend as rc
    from oriel.operators import topics as tp
    register_sql_functions(spark)
    rows = [("MEDIUM", -0.85, "Staff kept us in a queue and dinner was late", "consultations"),
            ("HIGH", -0.7, "Sunny deck", "curiously"), ("LOW", 0.3, "one bag", "hating"), ("x", 0.05, "", "lawful")]
    df = spark.createDataFrame(rows, "p string, s double, t string, w string")
    df.createOrReplaceTempView("sqlfn_cases")
    extra = spark.sql("SELECT oriel_label_to_binary('Positive'), oriel_score_to_percent(0.5), oriel_word_count('a  b c'), "
                      "oriel_count_char('a!b!', '!')").first()
    assert tuple(extra) == (1, 75.0, 3, 2)
    a = spark.sql("SELECT oriel_escalate(p, s), oriel_three_class(s), oriel_satisfied(s), oriel_detect_topic(t), "
                  "oriel_suffix_lemma(w), oriel_priority_rank(p) FROM sqlfn_cases").collect()
    b = df.select(rc.escalate("p", "s"), lb.three_class("s"), lb.satisfied_from_compound("s"),
                  tp.detect_topic("t"), lm.suffix_lemma(F.col("w")), rc.priority_rank("p")).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_head_rows_and_rows_at(spark):
    from oriel.sources.tables import head_rows, rows_at
    df = spark.range(100).withColumnRenamed("id", "review_id")
    assert [r[0] for r in head_rows(df, "review_id", 3).collect()] == [0, 1, 2]
    assert sorted(r[0] for r in rows_at(df, "review_id", [7, 42]).collect()) == [7, 42]
    ids = df.select(tx.random_id().alias("u")).distinct().count()
    assert ids == 100


def test_tokens_and_emails_in_one_scan_equal_the_two_step_forms(spark):
    """Tokens were runs of non-space characters tested one by one, e-mails were sought from every character."""
    texts = ["", " ", "a", "ab", " ab cd1 ef\u00a0gh\u2028ij \u00e9t\u00e9 x\ty\nzz 12 a-b caf\u00e9\u0301 \U0001d4d0\U0001d4d1 \U0001d4d0", "ab\x85cd\x1cef\u200bgh",
             "me@a.b @a.b a@.b a@b. x@@y.z,q (me@a.b) a@b@c.d.e \u00e9@\u00fc.de", "www.a@b.c http://x@y.z xhttp://a@b.c @@b a@b@", None]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    for n in (1, 2, 3):
        want = F.expr(f"filter(regexp_extract_all(t, r'{tx.NON_WS_RUN}', 0), x -> x RLIKE r'^\\p{{L}}+$' AND length(x) >= {n})")
        assert all(r[0] == r[1] for r in d.select(tx.tokenize("t", n).alias("a"), want.alias("b")).collect())
    for got, old in ((tx.remove_emails("t", "loose"), r"(?U)\S+@\S+"), (tx.remove_emails("t", "dotted"), r"(?U)\S+@\S+\.\S+"),
                     (tx.remove_urls("t", "serving"), r"(?U)https?://\S+|www\.\S+|\S+@\S+")):
        assert all(r[0] == r[1] for r in d.select(got.alias("a"), F.regexp_replace("t", old, "").alias("b")).collect())


def test_long_dictionary_cleans_its_texts_once(spark, monkeypatch, tmp_path):
    from oriel.operators import tokens as tk
    from oriel.plans.catalog import QUERIES
    texts = [("flights " * 3 + "delayed delayed x1 Me@a.b the") if i % 2 else "Delayed, passengers!" for i in range(30)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, old = [], tx.nlp_clean_string
    monkeypatch.setattr(tx, "nlp_clean_string", lambda c: calls.append(c) or old(c))
    got = {r[0]: r[1] for r in QUERIES["q63_long_dictionary"](spark, str(tmp_path)).collect()}
    assert len(calls) == 1                                        # was 2: for the counts, and again in the pipeline
    monkeypatch.setattr(tk, "MAX_LISTED", 3)
    assert got == {r[0]: r[1] for r in QUERIES["q63_long_dictionary"](spark, str(tmp_path)).collect()}
    d = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    words = spark.createDataFrame([("flights", "flig"), ("delayed", "dela")], "token string, lemma string")
    want = tk.nlp_pipeline(d, "review_id", "text", words, tk.stopword_table(spark)).select("review_id", F.md5("cleaned_review")).collect()
    assert got == {r[0]: r[1] for r in want}
