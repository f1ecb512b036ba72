"""DuckDB oracle per query (fast subset) on the sf0.001 driver tables.

The full gate over all queries is ``tools/oracle_check.py``."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, rows_of  # noqa: E402
from oriel.plans.catalog import QUERIES  # noqa: E402
from oriel.plans.oracle import ORACLE  # noqa: E402

FAST = ["q13_dict_lemma_pipeline", "q15_word_freq_by_class", "q17_describe", "q21_kde", "q29_sentiment_labels",
        "q36_recommend", "q44_request_parse_respond", "q45_prediction_log", "q47_tfidf", "q54_model_serving",
        "q55_confusion_row_pct", "q58_head_and_rows", "q60_top_features", "q62_tfidf_vectors", "q63_long_dictionary",
        "q01_text_lengths", "q02_normalize_text", "q03_clean_letters", "q05_numeric_features", "q06_null_profile",
        "q07_label_rules", "q10_tokens", "q12_suffix_lemma", "q20_histogram", "q28_lexicon_sentiment",
        "q34_detect_topic", "q40_stratified_split", "q43_roc_auc", "q52_batch_model_score"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, got) == rows_of(cols, want)


def test_every_query_is_registered_with_an_oracle_or_rows_only():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    own = {k for k in q if k.startswith("q")}
    assert len(own) == 65 and set(o) <= set(q)
    assert own - set(o) == {"q50_train_compare", "q51_lda_topics", "q64_trained_serving"}
