import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline as cp  # noqa: E402
from oriel.llm import bpe, decontam, linededup, neardup


def test_stages_on_the_tables(spark, sf):
    """Each stage on its own input, against brute force where there is one."""
    from tests_llm_brute import classes_of, lines_left

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    good = cp.quality_filter(spark, docs, sf).persist()
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    seen = {i: q for i, q in labels.items() if q is not None}
    assert good.columns == columns and sum((i in kept) == (q == 1) for i, q in seen.items()) > 0.95 * len(seen)

    rows = [tuple(r) for r in good.orderBy("doc_id").collect()]
    lines = cp.line_dedup(spark, good, sf).persist()
    want = lines_left(rows, linededup.MIN_SITES)
    assert lines.columns == columns and sorted(tuple(r) for r in lines.collect()) == want

    rows = sorted(want)
    one = cp.near_dedup(spark, lines, sf).persist()
    assert one.columns == columns
    first = classes_of([(r[0], r[1]) for r in rows])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({rows[i][0] for i in first})

    clean = cp.decontaminate(spark, one, sf).persist()
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    for r in one.collect():
        words = f" {' '.join(re.findall(r'\w+', r['text'].lower()))} "
        if any(f" {' '.join(i)} " in words for i in items):
            assert r["doc_id"] not in left
    assert clean.columns == columns and len(left) > 0.9 * one.count()

    ranks, pattern = bpe.default_ranks()
    enc = bpe._encoding(ranks, pattern)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    out = cp.tokenize(spark, clean, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}


def test_run_and_names(spark, docs, table_dir):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokenize"]
    rows = [(1, "one text that stays here for good"), (2, "one text that stays here for good"), (3, None), (4, "")]
    d = table_dir(documents=docs(rows), labels=spark.createDataFrame([], "doc_id long, quality int"),
                  benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in cp.run(spark, d).collect()) == [1, 3]
    empty = table_dir(documents=docs([]))
    assert cp.run(spark, empty).count() == 0


def test_stages_keep_clashing_columns(spark, docs, table_dir):
    from pyspark.sql import functions as F

    rows = [(1, "one text that stays here for good"), (2, "another text with words of its own in it"), (3, None)]
    d = table_dir(documents=docs(rows), labels=spark.createDataFrame([], "doc_id long, quality int"),
                  benchmark=spark.createDataFrame([], "item_id long, text string"))
    odd = docs(rows).select("*", *[F.lit(77).alias(c) for c in ("score", "quality_score", "n_lines", "n_removed", "benchmark_matches", "row", "node", "id", "lines", "out")])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns, name
        got = out.collect()
        assert len(got) == 3 and all(r[c] == 77 for r in got for c in odd.columns[5:]), name


def test_no_task_keeps_two_python_workers(spark, docs):
    """Encoding and decoding in one task would."""
    out = cp.tokenize(spark, docs([(1, "alpha beta"), (2, None), (2, None)]), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CoGroups" not in plan
    n = len(bpe._encoding(*bpe.default_ranks()).encode_ordinary("alpha beta"))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == [(1, n), (2, 0), (2, 0)]


def test_modules_used():
    assert {decontam, neardup, linededup, bpe}
