import numpy as np
from pyspark.sql import functions as F

from oriel.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, each):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    dim = max({len(v) for _, v in ok}, key=lambda d: (sum(len(v) == d for _, v in ok), -d)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = []
    for i, q in ok:
        if i % each == 0:
            near = sorted((-(v * q).sum(), j) for j, v in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def _vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim)) * 3
    return [(i, (centers[i % 8] + rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = _vectors(3000)
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, leaf_rows=32, max_sample=1000).collect()
    want = brute(rows, 20, 20)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == len(want)
    assert np.mean([(q, v) in found for q, _, v, _ in want]) >= 0.9
    exact = {(q, v): s for q, _, v, s in want}
    assert all(abs(exact[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_recall_on_the_tables(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {(r["query_id"], r["vec_id"]) for r in ann.op9_ann(spark, sf).collect()}
    want = brute(rows, 20, 20)
    assert np.mean([(q, v) in found for q, _, v, _ in want]) >= 0.9


def test_visits_fewer_leaves_than_there_are():
    x = np.array([v for _, v in _vectors(4000)], np.float64)
    tree = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), 4000, leaf_rows=64)
    assert tree.leaves > 20
    for q in x[:20]:
        order = list(tree.visit(q))
        assert sorted(order) == list(range(tree.leaves))
    leaf = tree.assign(x)
    assert set(leaf) <= set(range(tree.leaves))


def test_order_of_all_leaves_is_that_of_the_walk():
    x = np.array([v for _, v in _vectors(4000)], np.float64)
    tree = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), 4000, leaf_rows=64)
    held = np.bincount(tree.assign(x), minlength=tree.leaves)
    bits = np.unpackbits(ann.visited(tree, x[:100], 3, held, 200), axis=1)
    for q, order, on in zip(x[:100], tree.order(x[:100]), bits, strict=True):
        walk = list(tree.visit(q))
        assert order.tolist() == walk
        seen = np.cumsum(held[walk]) - held[walk]
        assert set(np.flatnonzero(on)) == {leaf for n, leaf in enumerate(walk) if n < 3 or seen[n] < 200}


def test_a_query_is_stored_once_however_many_leaves_it_visits(spark, monkeypatch):
    stored, old = {}, ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df, name, *a, **b: stored.setdefault(name, old(df, name, *a, **b)))
    monkeypatch.setattr(ann, "PART_BYTES", 4000)                  # 100 queries in several parts
    rows = _vectors(2000)
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 10, recall=1.0, leaf_rows=16, max_sample=1000).collect()
    assert stored["ann-visits"].count() == 100                    # was a row with the vector for each leaf
    assert len(got) == 1000
    exact = {(q, v): s for q, _, v, s in brute(rows, 10, 20)}
    assert np.mean([(r["query_id"], r["vec_id"]) in exact for r in got]) >= 0.95


def test_hot_vector_ties_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(ann, "V_BLOCK", 50)
    monkeypatch.setattr(ann, "Q_BLOCK", 7)
    rows = _vectors(300, dim=4) + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    rows += [(2000, None), (2020, [0.0] * 4), (2040, [float("nan"), 1.0, 1.0, 1.0]), (2060, [1.0, None, 1.0, 1.0]),
             (2080, [float("inf"), 1.0, 1.0, 1.0]), (2100, [1.0, 2.0]), (None, [1.0] * 4), (5000, [9.0] * 4)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, leaf_rows=16, recall=1.0).collect()
    want = brute(rows, 20, 20)
    assert {r["query_id"] for r in got} == {q for q, *_ in want} and len(got) == len(want)
    hot = {(q, n): v for q, n, v, _ in want if q >= 1000}
    mine = {(r["query_id"], r["rank"]): r["vec_id"] for r in got if r["query_id"] >= 1000}
    assert mine == hot


def test_few_rows_empty_table_and_other_columns(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("v", F.lit(1))
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20, 20)
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20).count() == 0
    one = ann.search(spark.createDataFrame([(0, [1.0])], SCHEMA), F.col("vec_id") % 20 == 0, 20)
    assert one.count() == 0
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(twice, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 1)]
