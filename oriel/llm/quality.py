"""Quality classifier: naive-Bayes support vectors.

Features are indicators of byte n-grams (1 to 3 bytes) of the whole text,
hashed into a fixed space.  Each indicator is scaled by the log ratio of its
class-conditional rates, rows get unit length, and a linear model with hinge
loss is fitted by dual coordinate descent.  A logistic curve over
out-of-fold margins turns the margin into a score.

The classifier is fitted on a bounded sample of labelled rows:
``max_per_class`` documents of either label, the smallest hashes of doc_id
first.  Everything else covers all rows.

Defined cases: a null text counts as empty and is scored like one (no n-grams:
the model's bias decides); labels other than 0 and 1, or null, are not used;
of several labels for one id the largest counts; with no usable label every
score is 0.5, with one class only the score is that class; repeated rows are
scored alike; very long texts are read whole; other columns pass through inside
one struct, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import crc_mod, giving_back, hash_cut, id_hash, read_table

BITS3 = 17
DIM = 256 + 65536 + (1 << BITS3)
MAX_PER_CLASS = 3000


def ngram_ids(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    a = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(DIM, dtype=bool)
    seen[a] = True
    if len(a) > 1:
        two = (a[:-1] << 8) | a[1:]
        seen[256 + two] = True
        if len(a) > 2:
            three = (two[:-1] << 8) | a[2:]
            seen[256 + 65536 + ((three * np.uint32(2654435761)) >> np.uint32(32 - BITS3))] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray  # per feature: log ratio times fitted weight
    ratio: np.ndarray    # log count ratio (for the length of a row)
    bias: float
    a: float
    b: float
    constant: float | None = None

    def margin(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratio[ids]).sum()))
        return (float(self.weights[ids].sum()) / norm if norm else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1.0 / (1.0 + np.exp(-np.clip(self.a * self.margin(ngram_ids(text)) + self.b, -30, 30))))


def log_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, DIM), smooth)
    for ids, label in zip(rows, y, strict=True):
        counts[int(label > 0), ids] += 1
    p, n = counts[1] / (y > 0).sum().clip(1), counts[0] / (y <= 0).sum().clip(1)
    return np.log(p / p.sum()) - np.log(n / n.sum())


def fit_margin(rows, y, c: float = 1.0, epochs: int = 12):
    """Dual coordinate descent for the L1 hinge loss; the cost of an error is
    weighted inversely to the size of its class.  Returns weights, ratio, bias."""
    ratio = log_ratio(rows, y)
    xs = []
    for ids in rows:
        v = ratio[ids]
        norm = np.sqrt(np.square(v).sum())
        xs.append(v / norm if norm else v)
    upper = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y <= 0).sum()))
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(y))
    diag = np.array([np.square(v).sum() + 1.0 for v in xs])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ xs[i] + bias) - 1.0
            new = min(max(alpha[i] - g / diag[i], 0.0), upper[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[rows[i]] += d * xs[i]
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w * ratio, ratio, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve a*m+b by Newton steps, with smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - t) * margin).sum() + 1e-3 * a, (weight * (p - t)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, share: tuple[float, float] | None = None) -> Model:
    """``share``: the classes' rows in the whole table, for the score's prior."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    empty = np.zeros(DIM)
    if not len(y) or len(set(y)) == 1:
        return Model(empty, empty, 0.0, 0.0, 0.0, 0.5 if not len(y) else float(y[0] > 0))
    out, fold = np.zeros(len(y)), np.zeros(len(y), int)
    for v in (-1, 1):
        fold[y == v] = np.arange((y == v).sum()) % 3
    for f in range(3):
        train = np.flatnonzero(fold != f)
        if len(set(y[train])) < 2:
            continue
        m = Model(*fit_margin([rows[i] for i in train], y[train]), 1.0, 0.0)
        for i in np.flatnonzero(fold == f):
            out[i] = m.margin(rows[i])
    n0, n1 = share or ((y < 0).sum(), (y > 0).sum())
    weight = np.where(y > 0, n1 / (y > 0).sum(), n0 / (y < 0).sum())
    a, b = platt(out, y, weight * len(y) / weight.sum())
    return Model(*fit_margin(rows, y), a, b)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_per_class: int):
    """At most ``max_per_class`` ids of either label, and the counts of both."""
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")))
    n = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # two rows
    # only the hashes that can be among the smallest reach the ranking
    cut = F.when(F.col("label") == 1, F.lit(hash_cut(max_per_class, n.get(1, 0)))).otherwise(F.lit(hash_cut(max_per_class, n.get(0, 0))))
    rank = Window.partitionBy("label").orderBy("h", "id")
    sample = (usable.withColumn("h", id_hash("id")).where(F.col("h") < cut)
              .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_per_class))
    return sample.select("id", "label"), (n.get(0, 0), n.get(1, 0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_per_class: int = MAX_PER_CLASS) -> Model:
    sample, share = labelled_sample(labels, id_col, label_col, max_per_class)
    # the sample has at most 2 * max_per_class rows
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([ngram_ids(t.as_py()).astype("<i4").tobytes() for t in b.column(1)], pa.binary())],
                names=["id", "label", "ids"])

    kind = {f.name: f.dataType for f in picked.schema}
    schema = T.StructType([T.StructField("id", kind["id"]), T.StructField("label", kind["label"]),
                           T.StructField("ids", T.BinaryType())])
    got = picked.select("id", "text", "label").mapInArrow(giving_back(run), schema)
    # ids that name several documents would let the sample grow: keep the bound per class
    rank = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("ids"))
    got = got.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_per_class)
    rows = sorted(((r["id"], r["label"], bytes(r["ids"])) for r in got.select("id", "label", "ids").collect()),
                  key=lambda r: (r[0], r[1], r[2]))
    return fit([np.frombuffer(r[2], "<i4") for r in rows], np.array([r[1] for r in rows]), share if min(share) else None)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``out``, which replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col] or [F.lit(0).alias("none")]).alias("row"),
                      F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*src.schema.fields, T.StructField("out", T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())],
                names=["row", "text", "out"])

    got = src.mapInArrow(giving_back(run), schema)
    return got.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept],
                      F.col("out").alias(out))


def held_out() -> F.Column:
    return crc_mod(F.col("doc_id"), 3) == 1


def scored_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, out: str = "score") -> DataFrame:
    """``docs`` with a score learnt from the labels of rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, train(docs, labels), out=out)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored_documents(spark, docs, sf_dir).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
