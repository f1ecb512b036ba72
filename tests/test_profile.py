import random

from pyspark.sql import functions as F

from oriel.operators import profile as pr


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "v double")
    h = {r["bin"]: r["n"] for r in pr.histogram(df, "v", 5).collect()}
    assert sum(h.values()) == 6 and h[4] == 1 and h[0] == 2


def test_kde_integrates_to_one(spark):
    rows = [(0, float(x)) for x in [1, 2, 2, 3, 7, 8, 8, 9]]
    k = pr.kde(spark.createDataFrame(rows, "g int, v double"), "v", "g", points=400, bins=64).collect()
    xs = sorted((r["x"], r["density_e6"] / 1e6) for r in k)
    area = sum((xs[i + 1][0] - xs[i][0]) * (xs[i][1] + xs[i + 1][1]) / 2 for i in range(len(xs) - 1))
    assert 0.95 < area < 1.01


def test_describe_uses_the_raw_values(spark):
    df = spark.createDataFrame([(i * 1e-6,) for i in range(1, 101)], "v double")
    r = pr.describe(df, ["v"], dp=7).first()
    assert (r["q25"], r["q50"], r["q75"]) == (2.58e-05, 5.05e-05, 7.53e-05)


def test_kde_exact_and_binned_are_close(spark):
    rows = [(0, float(x)) for x in [1, 2, 2, 3, 7, 8, 8, 9]]
    df = spark.createDataFrame(rows, "g int, v double")
    a, b = ({r["i"]: r["density_e6"] for r in pr.kde(df, "v", "g", points=50, bins=n).collect()} for n in (None, 1024))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 0.01 * max(a.values())


def test_value_counts_fill_zero(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "c int")
    cats = spark.createDataFrame([(0,), (1,)], "c int")
    got = {r["c"]: (r["n"], r["balance"]) for r in pr.value_counts_filled(df, "c", cats).collect()}
    assert got == {0: (0, 0.0), 1: (3, 0.0)}


def test_balance(spark):
    rows = [(0,)] * 658 + [(1,)] * 642
    df = spark.createDataFrame(rows, "c int")
    cats = spark.createDataFrame([(0,), (1,)], "c int")
    assert pr.value_counts_filled(df, "c", cats).first()["balance"] == 0.98


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, None)], "a int, b string")
    got = {r["column_name"]: (r["null_count"], r["null_pct"]) for r in pr.null_profile(df).collect()}
    assert got == {"a": (1, 33.33), "b": (2, 66.67)}


def test_box_stats(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [1, 2, 3, 4, 100]], "g int, v double")
    r = pr.box_stats(df, "v", "g").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_hi"], r["n_outliers"]) == (2.0, 3.0, 4.0, 4.0, 1)


def test_quantiles_equal_percentile(spark):
    """Ties, one-row groups, nulls and null groups; many more values than partitions."""
    from oriel.operators.profile import quantiles
    rng = random.Random(2)
    rows = [(g, rng.choice([None, 0.0, 0.0, round(rng.gauss(0, 5), 3)])) for g in ("a", "b", "b", None) for _ in range(400)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p9": 0.9, "hi": 1.0}
    got = {r["g"]: tuple(r[k] for k in probs) for r in quantiles(df, ["g"], "v", probs).collect()}
    want = {r["g"]: tuple(r[k] for k in probs) for r in df.groupBy("g").agg(*[F.percentile("v", p).alias(k) for k, p in probs.items()]).collect()}
    assert want.pop("none") == (None,) * 5
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_no_task_holds_all_values(spark):
    """The plan of exact quartiles has no percentile buffer."""
    from oriel.operators.profile import describe
    df = spark.range(1000).select((F.rand(1) * 100).alias("x"))
    plan = describe(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "ObjectHashAggregate" not in plan


def test_box_expansion_equals_direct_sums(spark):
    """Clusters, ties, an outlier far beyond the reach, a constant and a one-row group."""
    rng = random.Random(8)
    rows = [("a", rng.gauss(0, 1)) for _ in range(300)] + [("a", 5.0)] * 40 + [("b", rng.expovariate(0.01)) for _ in range(200)] + [("b", 90000.0)]
    rows += [("flat", 2.0)] * 5 + [("one", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    fast = {(r["g"], r["i"]): (r["x"], r["density_e6"]) for r in pr.kde(df, "v", "g", points=200).collect()}
    plain = {(r["g"], r["i"]): (r["x"], r["density_e6"]) for r in pr.kde(df, "v", "g", points=200, direct=True).collect()}
    assert fast.keys() == plain.keys() and {g for g, _ in fast} == {"a", "b"} and len(fast) == 400
    assert all(fast[k][0] == plain[k][0] and abs(fast[k][1] - plain[k][1]) <= 1.01e-4 for k in fast)
