"""Benchmark the headline queries.

Runs each query over the whole tables at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS], forcing full evaluation with
the no-op sink (no collect to the driver), and prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q03_clean_letters", "q13_dict_lemma_pipeline", "q14_top_bigrams_by_class", "q17_describe",
    "q21_kde", "q28_lexicon_sentiment", "q34_detect_topic", "q36_recommend", "q40_stratified_split",
    "q43_roc_auc", "q45_prediction_log", "q47_tfidf",
    "q29_sentiment_labels", "q30_model_agreement", "q31_disagreement_crosstab", "q32_accuracy_coverage",
    "q33_label_mix_by_class", "q53_stream_score", "q54_model_serving", "q62_tfidf_vectors",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from oriel.session import local_session
    from oriel.plans.catalog import QUERIES

    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16),
                          app="oriel-bench")
    # the documents are one file here: deal them out over the cores before text work
    spark.conf.set("oriel.text.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
    # warm-up (JVM, codegen caches) on the smallest tables, not timed
    QUERIES["q01_text_lengths"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    n_docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).count()
    t0 = time.time()
    from oriel import dims
    from oriel.operators.sentiment import lexicon_scores
    from oriel.plans.catalog import QUERY_BOOSTERS, QUERY_CONTRAST, QUERY_LEXICON, QUERY_NEGATIONS
    from oriel.sources.tables import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon_scores(docs, "doc_id", "text", dims.lexicon_df(spark, QUERY_LEXICON),
                   dims.booster_df(spark, QUERY_BOOSTERS), QUERY_NEGATIONS, QUERY_CONTRAST) \
        .write.format("noop").mode("overwrite").save()
    lex_secs = time.time() - t0
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus,
        "lexicon_reviews_per_sec": round(n_docs / lex_secs, 1) if lex_secs > 0 else None,
        "documents": n_docs,
    }))


if __name__ == "__main__":
    main()
