"""Versioned model bundles with a current pointer.

A bundle is one folder: the fitted feature pipeline, the classifier (one row
per tree, or the coefficients), the ordered list of feature columns and the
comparison table.  Bundles are never changed.  The pointer is a log: each
publication or switch adds one small table with the next number, written in
one commit that fails if the number is taken; the current version is that of
the largest number.  A reader therefore sees the old or the new version, never
part of one, and any earlier version can be made current again.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import trees


class ServedModel:
    """Feature pipeline and classifier; ``transform`` adds probability (of
    class 1) and prediction."""

    def __init__(self, features: PipelineModel, classifier, columns: list[str], version: int | None = None):
        self.features, self.classifier, self.columns, self.version = features, classifier, columns, version

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.classifier)

        @F.pandas_udf("double")
        def probability(v: pd.DataFrame) -> pd.Series:
            # a vector arrives as (type, size, indices, values); dense ones have no indices
            ids = [np.arange(len(x)) if t else np.asarray(i) for t, i, x in zip(v["type"], v["indices"], v["values"], strict=True)]
            xs = [np.asarray(x) for x in v["values"]]
            held = [x != 0 for x in xs]
            return pd.Series(shared.value.probability([i[h] for i, h in zip(ids, held, strict=True)], [x[h] for x, h in zip(xs, held, strict=True)]))

        out = self.features.transform(df).withColumn("probability", probability("features"))
        return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))


def classifier_rows(model) -> list[tuple]:
    if isinstance(model, trees.TreeModel):
        head = {"settings": asdict(model.settings), "cuts": [c.tolist() for c in model.bins.cuts]}
        return [(-1, "trees", json.dumps(head))] + [(i, "tree", json.dumps(t)) for i, t in enumerate(trees.packed(model.trees))]
    return [(-1, "linear", json.dumps(model.w.tolist()))]


def classifier_of(rows: list[tuple]):
    from .train import LinearModel
    (_, kind, head), *rest = sorted(rows)
    if kind == "linear":
        return LinearModel(np.array(json.loads(head)))
    d = json.loads(head)
    return trees.TreeModel(trees.Settings(**d["settings"]), trees.unpacked([json.loads(t) for _, _, t in rest]), trees.Bins([np.array(c) for c in d["cuts"]]))


def pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """(number, version): every publication and switch."""
    try:
        return spark.read.schema("number long, version long").parquet(f"{root}/pointers/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def last(spark: SparkSession, root: str) -> tuple[int, int, int]:
    """Number and version of the current pointer, and the largest version; 0 where there is none."""
    table = pointers(spark, root)
    if table is None:
        return 0, 0, 0
    r = table.agg(F.max(F.struct("number", "version")).alias("p"), F.max("version").alias("v")).first()
    return (r["p"]["number"], r["p"]["version"], r["v"]) if r["p"] else (0, 0, 0)


def switch(spark: SparkSession, root: str, version: int) -> None:
    """Makes a stored version current.  Fails if another switch took the same number."""
    number = last(spark, root)[0] + 1
    spark.createDataFrame([(number, version)], "number long, version long").coalesce(1).write.mode("error").parquet(f"{root}/pointers/{number:010d}")


def publish(spark: SparkSession, root: str, model: ServedModel, metrics: DataFrame, make_current: bool = True) -> int:
    """Stores a new version and, last, points to it."""
    version = last(spark, root)[2] + 1
    path = f"{root}/versions/{version:010d}"
    model.features.write().save(f"{path}/features")       # fails if the version is there
    spark.createDataFrame(classifier_rows(model.classifier), "i int, kind string, body string").write.parquet(f"{path}/classifier")
    spark.createDataFrame(list(enumerate(model.columns)), "i int, name string").write.parquet(f"{path}/columns")
    metrics.write.parquet(f"{path}/metrics")
    if make_current:
        switch(spark, root, version)
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> ServedModel:
    """The current version, or a given one."""
    version = version if version is not None else last(spark, root)[1]
    if not version:
        raise ValueError(f"no model has been published in {root}")
    path = f"{root}/versions/{version:010d}"
    classifier = classifier_of([tuple(r) for r in spark.read.parquet(f"{path}/classifier").collect()])   # a row per tree
    columns = [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("i").collect()]
    return ServedModel(PipelineModel.load(f"{path}/features"), classifier, columns, version)


def metrics(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = version if version is not None else last(spark, root)[1]
    return spark.read.parquet(f"{root}/versions/{version:010d}/metrics")
