"""The comparison, its bundle, switching and serving."""
import pytest
from pyspark.sql import functions as F

from oriel.operators import registry
from oriel.operators.score import score_reviews
from oriel.operators.train import train_compare
from oriel.plans import catalog
from oriel.sources.tables import table


@pytest.fixture(scope="module")
def trained(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    data = catalog._model_data(spark, sf)
    comp, best, top = train_compare(data, "text_processed", catalog.MODEL_NUMERIC, size="small", k_folds=2, save_dir=path)
    return path, comp.collect(), best, top.collect()


def test_comparison_table(trained):
    _, comp, best, top = trained
    assert [r["Model"] for r in comp] == ["Logistic Regression", "Random Forest", "Boosted Trees A", "Boosted Trees B"]
    assert all(0 <= r[c] <= 1 for r in comp for c in ("Accuracy", "Precision", "Recall", "F1", "ROC_AUC", "CV_F1"))
    winner = max(comp, key=lambda r: (r["F1"], r["ROC_AUC"], r["Model"]))
    assert [r["Model"] for r in comp if r["Is_Best"]] == [winner["Model"]]                     # O8
    assert len(top) == 25 and [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
    assert {r["kind"] for r in top} <= {"term", "numeric"}


def test_saved_features_are_those_of_the_split(spark, sf, trained):
    rows = spark.read.parquet(f"{trained[0]}/features")
    n = catalog._labels(spark, sf).join(table(spark, sf, "documents"), "doc_id").count()
    assert rows.count() == n and {r[0] for r in rows.select("split").distinct().collect()} == {"train", "test"}
    assert rows.where("(split = 'train') = (fold IS NULL)").count() == 0


def test_published_switched_and_served(spark, sf, trained):
    path, comp, best, _ = trained
    root = f"{path}/registry"
    loaded = registry.load(spark, root)
    assert loaded.version == 1 and loaded.columns == best.columns
    assert registry.metrics(spark, root).count() == 4
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    cfg = catalog._query_scoring(spark)

    def served(model):
        cfg.model = model
        return {r[0]: tuple(r[1:]) for r in score_reviews(d, "review_id", "text", cfg).select("review_id", "predicted_satisfaction", "confidence").collect()}

    want = served(best)
    assert len(want) == d.count() and served(loaded) == want
    other = registry.ServedModel(best.features, type("Constant", (), {})(), best.columns)
    from oriel.operators.train import LinearModel
    other.classifier = LinearModel([0.0] * len(best.columns) + [5.0])
    assert registry.publish(spark, root, other, spark.range(1), make_current=False) == 2
    assert registry.load(spark, root).version == 1
    registry.switch(spark, root, 2)
    assert registry.load(spark, root).version == 2 and {v[1] for v in served(registry.load(spark, root)).values()} == {0.9933}
    registry.switch(spark, root, 1)
    assert served(registry.load(spark, root)) == want
    assert [tuple(r) for r in registry.pointers(spark, root).orderBy("number").collect()] == [(1, 1), (2, 2), (3, 1)]
    assert registry.load(spark, root, 2).version == 2


def test_no_model_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        registry.load(spark, str(tmp_path))


def test_population_deviation(spark):
    from oriel.operators.train import feature_pipeline
    rows = [(f"word other {i % 3}", float(v), float(v * v)) for i, v in enumerate([1, 2, 4, 7])]
    df = spark.createDataFrame(rows, "t string, a double, b double")
    for population, ddof in ((False, 1), (True, 0)):
        m = feature_pipeline("t", ["a", "b"], min_df=1.0, max_df=1.0, population=population).fit(df)
        got = [r["num_vec"].toArray().tolist() for r in m.transform(df).collect()]
        import numpy as np
        x = np.array([r[1:] for r in rows])
        assert np.allclose(got, (x - x.mean(axis=0)) / x.std(axis=0, ddof=ddof))
