"""Batch LDA: special functions, one E-step, the bound, planted topics, partitioning."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.operators import lda


def test_special_functions():
    x = np.array([0.05, 0.1, 0.7, 1.0, 2.5, 10.0, 123.4])
    assert np.allclose(lda.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    h = 1e-5
    assert np.allclose(lda.digamma(x), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], rtol=1e-5)


def plain_document(ids, n, beta, alpha):
    """The coordinate ascent of one document, entry by entry."""
    k = beta.shape[1]
    gamma = np.ones(k)
    for _ in range(100):
        theta = np.exp(lda.expected_log(gamma))
        new = np.full(k, alpha)
        for i, c in zip(ids, n, strict=True):
            phi = theta * beta[i]
            new += c * phi / phi.sum()
        done = np.abs(new - gamma).mean() < 1e-3
        gamma = new
        if done:
            break
    return gamma


def test_e_step_equals_documents_one_by_one():
    rng = np.random.default_rng(1)
    beta = rng.gamma(1.0, 1.0, (40, 4))
    sizes = [0, 3, 12, 0, 1, 30]
    ids = np.concatenate([rng.choice(40, s, replace=False) for s in sizes]).astype(int)
    n = rng.integers(1, 5, len(ids)).astype(float)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    gamma, _ = lda.e_step(ptr, ids, n, beta, 0.25)
    for d, s in enumerate(sizes):
        part = slice(ptr[d], ptr[d + 1])
        want = plain_document(ids[part], n[part], beta, 0.25) if s else np.full(4, 0.25)
        assert np.allclose(gamma[d], want)


def corpus(n=240, k=3, seed=4):
    rng = np.random.default_rng(seed)
    words = [[f"{t}{c}" for c in "abcdefgh"] for t in ("seat", "meal", "delay")]
    return [(i, " ".join(rng.choice(words[i % k], 25))) for i in range(n)]


@pytest.fixture(scope="module")
def bags(spark):
    d = spark.createDataFrame(corpus(), "id long, text string").repartition(5)
    tf, rows = lda.numbered_terms(d, "text", [])
    words = sorted(r[0] for r in tf.select("term").distinct().collect() if " " not in r[0])
    return lda.cut_lineage(lda.bags_of(tf, spark.createDataFrame(list(enumerate(words)), "idx int, term string"))), words


def test_bound_rises_and_planted_topics_are_found(bags):
    model = lda.fit_topics(*bags, k=3, max_iter=12)
    assert all(b > a - 1e-3 * abs(a) * 1e-3 for a, b in zip(model.bounds, model.bounds[1:], strict=False)), model.bounds
    tops = [{w.rstrip("abcdefgh") if not w.startswith("delay") else "delay" for w in t.split()} for t in model.top_words(8)]
    assert sorted(len(t) for t in tops) == [1, 1, 1] and len(set.union(*tops)) == 3
    sizes = {r["Topic"]: r["count"] for r in lda.assign_topics(bags[0], model).groupBy("Topic").count().collect()}
    assert sorted(sizes.values()) == [80, 80, 80]


def test_same_result_for_any_partitioning(bags):
    a = lda.fit_topics(bags[0].repartition(1), bags[1], k=3, max_iter=4)
    b = lda.fit_topics(bags[0].repartition(7), bags[1], k=3, max_iter=4)
    assert np.allclose(a.lam, b.lam, rtol=1e-8) and np.allclose(a.bounds, b.bounds)


def test_small_blocks_change_nothing(spark, bags, monkeypatch):
    out = [(r["row"], r["Topic"]) for r in lda.assign_topics(bags[0], lda.fit_topics(*bags, k=3, max_iter=2)).orderBy("row").collect()]
    rows = bags[0].coalesce(1).toArrow().combine_chunks().to_batches()
    whole = list(lda.blocks(rows))
    monkeypatch.setattr(lda, "BLOCK_ENTRIES", 20)
    cut = list(lda.blocks(rows))
    assert len(cut) > len(whole) and sum(len(b[0]) for b in cut) == len(out)
    assert np.array_equal(np.concatenate([b[2] for b in cut]), np.concatenate([b[2] for b in whole]))


def test_topic_table_counts_every_document(spark, tmp_path):
    docs = spark.createDataFrame([*corpus(60), (98, ""), (99, None), (99, None)], "id long, text string")
    out = lda.lda_topics(docs, "text", k=3, max_iter=5, save_dir=str(tmp_path)).collect()
    assert [r["Topic"] for r in sorted(out)] == [0, 1, 2] and sum(r["Count"] for r in out) == 63
    assert [r["Count"] for r in out] == sorted((r["Count"] for r in out), reverse=True)
    assert all(len(r["Top_Words"].split()) >= 8 for r in out)
    model = lda.TopicModel.load(spark, f"{tmp_path}/lda")
    by = {r["Topic"]: r["Top_Words"] for r in out}
    assert model.top_words(8) == [by[t] for t in range(3)] and len(model.bounds) == 5


def test_counted_bags_equal_the_relational_ones(spark):
    docs = spark.createDataFrame([*corpus(40), (98, ""), (99, None), (99, "zz")], "id long, text string")
    tf, _ = lda.numbered_terms(docs, "text", [])
    words = sorted(r[0] for r in tf.select("term").distinct().collect())[::2]
    want = lda.bags_of(tf, spark.createDataFrame(list(enumerate(words)), "idx int, term string")).collect()
    terms = lda.numbered(docs, "text").select("row", lda.document_terms(F.col("text"), []).alias("terms"))
    got = lda.counted_bags(terms, words).collect()
    key = lambda rows: sorted((tuple(r["ids"]), tuple(r["counts"])) for r in rows if r["ids"])
    assert key(got) == key(want) and len(got) == 43


def test_every_core_has_a_part_of_a_pass(spark, monkeypatch):
    """Bags are small, so they are dealt out again; many partitions meet in a few tasks, and the sums do not depend on it."""
    seen = {}
    fit = lda.fit_topics
    monkeypatch.setattr(lda, "fit_topics", lambda bags, *a: seen.update(parts=bags.rdd.getNumPartitions()) or fit(bags, *a))
    docs = spark.createDataFrame(corpus(60), "id long, text string").coalesce(1)
    lda.lda_topics(docs, "text", k=3, max_iter=2)
    assert seen["parts"] == lda.PASS_TASKS * spark.sparkContext.defaultParallelism


def test_groups_hold_every_document_once_and_stay_small(monkeypatch):
    monkeypatch.setattr(lda, "GROUP_ENTRIES", 100)
    size = np.array([0, 1, 5, 5, 6, 30, 31, 33, 0, 400, 2, 1, 90])
    groups = list(lda.alike(size))
    assert sorted(np.concatenate(groups).tolist()) == np.flatnonzero(size).tolist()
    assert all(len(g) == 1 or size[g].max() * len(g) <= 100 and size[g].max() <= 1.2 * size[g].min() + 1e-9 for g in groups)
