"""Complaint topics by batch variational LDA.

Bag of words (M4: stopwords before bigrams, vocabulary cap, min_df) as
(document, term, count) rows, written once with a document's counts in one
row.  A pass is one Spark job over all of them: every task runs the
coordinate-ascent E-step of its documents in Arrow batches against the
broadcast topic-term matrix (``k`` x vocabulary) and adds up the expected
topic-term counts and its part of the evidence lower bound; the tasks' sums
meet in one aggregation.  Every text is in every pass.  Documents start each
E-step from the same point, so partitioning and order change a result by
rounding only.

Document topic = the largest weight (first on ties), counts per topic (zeros
kept), top words per topic, business name by the ordered name rules, sorted by count.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..session import cut_lineage
from . import tokens as tk
from .features import counted_vocabulary, term_frequencies
from .sums import added
from .topics import name_topic

BAG = "row long, ids array<int>, counts array<double>"
#: Entries of an E-step block: bounds a task's memory whatever the documents.
BLOCK_ENTRIES = 200_000
#: Entries that iterate together: their weights (x k numbers) stay in a core's cache.
GROUP_ENTRIES = 32_000
#: Tasks of a pass per core, at most.
PASS_TASKS = 2


# special functions of positive arguments: recurrence up to 6, then the asymptotic series
def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(6):
        out = out - 1.0 / x
        x = x + 1.0
    f = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def lgamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(6):
        out = out - np.log(x)
        x = x + 1.0
    f = 1.0 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x


def expected_log(dirichlet: np.ndarray) -> np.ndarray:
    return digamma(dirichlet) - digamma(dirichlet.sum(axis=-1, keepdims=True))


def alike(size: np.ndarray):
    """Document numbers in groups of like sizes (the largest at most a fifth
    above the smallest) and of at most GROUP_ENTRIES padded entries, or one document."""
    docs = np.flatnonzero(size > 0)
    kind = np.ceil(np.log(size[docs]) / math.log(1.2)).astype(int)
    docs = docs[np.argsort(kind, kind="stable")]
    for part in np.split(docs, np.flatnonzero(np.diff(np.sort(kind))) + 1) if len(docs) else ():
        step = max(1, GROUP_ENTRIES // int(size[part].max()))
        for i in range(0, len(part), step):
            yield part[i:i + step]


def e_step(ptr: np.ndarray, ids: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: float,
           iterations: int = 100, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Documents' topic weights and the likelihood's normaliser per entry.
    Document d holds the entries ptr[d]..ptr[d+1]; ``beta``: exp E[log topic],
    (vocabulary, k).  A document leaves the iteration when its weights move by
    less than ``tol`` on average.  Documents of like sizes iterate together,
    padded by entries of count 0."""
    size = np.diff(ptr)
    gamma, norm = np.ones((len(size), beta.shape[1])), np.empty(len(ids))
    gamma[size == 0] = alpha
    for docs in alike(size):
        place = np.arange(size[docs].max())
        held = place < size[docs][:, None]
        at = ptr[docs][:, None] + np.where(held, place, 0)
        all_n, all_b = np.where(held, counts[at], 0.0), beta[ids[at]]
        n, b, mine, live = all_n, all_b, docs, np.ones(len(docs), bool)
        for _ in range(iterations):
            old = gamma[mine]
            theta = np.exp(expected_log(old))
            share = n / ((b @ theta[:, :, None])[:, :, 0] + 1e-100)
            new = alpha + theta * (share[:, None, :] @ b)[:, 0]
            gamma[mine[live]] = new[live]
            live &= np.abs(new - old).mean(axis=1) >= tol
            left = np.count_nonzero(live)
            if not left:
                break
            if left < 0.75 * len(live):           # those that stand still are dropped now and then: it copies the rest
                n, b, mine, live = n[live], b[live], mine[live], np.ones(left, bool)
        theta = np.exp(expected_log(gamma[docs]))
        norm[at[held]] = (all_b @ theta[:, :, None])[:, :, 0][held] + 1e-100
    return gamma, norm


def blocks(batches):
    """(row numbers, ptr, ids, counts) of bounded numbers of entries."""
    for batch in batches:
        rows, lists, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        begin = 0
        while begin < len(rows):
            held = np.cumsum(size[begin:])
            end = begin + max(1, int(np.searchsorted(held, BLOCK_ENTRIES, "right")))
            part = slice(begin, end)
            ids = lists[part].flatten().to_numpy(zero_copy_only=False)
            counts = n[part].flatten().to_numpy(zero_copy_only=False)
            yield rows[part], np.concatenate([[0], np.cumsum(size[part])]), ids, counts
            begin = end


def document_bound(gamma: np.ndarray, counts: np.ndarray, norm: np.ndarray, alpha: float) -> float:
    k = gamma.shape[1]
    log_theta = expected_log(gamma)
    return float((counts * np.log(norm)).sum() + ((alpha - gamma) * log_theta).sum() + lgamma(gamma).sum()
                 - lgamma(gamma.sum(axis=1)).sum() + len(gamma) * (lgamma(np.array(alpha * k)) - k * lgamma(np.array(alpha))))


def topic_bound(lam: np.ndarray, eta: float) -> float:
    log_beta, (k, v) = expected_log(lam), lam.shape
    return float(((eta - lam) * log_beta).sum() + lgamma(lam).sum() - lgamma(lam.sum(axis=1)).sum()
                 + k * (lgamma(np.array(eta * v)) - v * lgamma(np.array(eta))))


def one_pass(bags: DataFrame, lam: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Expected topic-term counts over all documents, and the documents' part of the bound."""
    k, v = lam.shape
    shared = bags.sparkSession.sparkContext.broadcast(np.exp(expected_log(lam)).T)

    def run(batches):
        beta = shared.value
        stats, bound = np.zeros((v, k)), 0.0
        for _, ptr, ids, counts in blocks(batches):
            gamma, norm = e_step(ptr, ids, counts, beta, alpha)
            theta = np.exp(expected_log(gamma))
            at, share = np.repeat(np.arange(len(gamma)), np.diff(ptr)), counts / norm
            for j in range(k):
                stats[:, j] += np.bincount(ids, weights=theta[at, j] * share, minlength=v)
            bound += document_bound(gamma, counts, norm, alpha)
        stats *= beta
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(k + 1)), pa.int32()), pa.array([*stats.T.tolist(), [bound]], pa.list_(pa.float64()))], names=["topic", "stat"])

    # a task adds up k x vocabulary numbers: a few tasks a core, not one per partition of the bags
    tasks = PASS_TASKS * bags.sparkSession.sparkContext.defaultParallelism
    parts = bags.coalesce(tasks).mapInArrow(run, "topic int, stat array<double>")
    sums = added(parts)                                  # k x vocabulary numbers and the bound
    shared.unpersist()
    return np.array([sums[j] for j in range(k)]), float(sums[k][0])


@dataclass
class TopicModel:
    vocab: list[str]
    lam: np.ndarray          # (k, vocabulary): Dirichlet parameters of the topics
    alpha: float
    eta: float
    bounds: list[float] = field(default_factory=list)

    def top_words(self, n: int = 8) -> list[str]:
        """The words of the largest weights, ties by term."""
        return [" ".join(self.vocab[i] for i in sorted(range(len(self.vocab)), key=lambda i: (-row[i], self.vocab[i]))[:n])
                for row in self.lam]

    def save(self, spark, path: str) -> None:
        """A row per term with its weights, and the priors, as Parquet."""
        rows = [(i, t, self.lam[:, i].tolist()) for i, t in enumerate(self.vocab)]
        spark.createDataFrame(rows, "idx int, term string, weights array<double>").write.mode("overwrite").parquet(f"{path}/topics")
        spark.createDataFrame([(self.alpha, self.eta, [float(b) for b in self.bounds])],
                              "alpha double, eta double, bounds array<double>").write.mode("overwrite").parquet(f"{path}/priors")

    @classmethod
    def load(cls, spark, path: str) -> TopicModel:
        rows = sorted(spark.read.parquet(f"{path}/topics").collect())     # vocabulary rows
        p = spark.read.parquet(f"{path}/priors").first()
        return cls([r["term"] for r in rows], np.array([r["weights"] for r in rows]).T, p["alpha"], p["eta"], list(p["bounds"]))


def document_terms(text: Column, stop: list[str]) -> Column:
    """M4: words of two or more characters without stopwords, then their bigrams."""
    toks = tx.drop_stopwords(tk.vectorizer_tokens(text), stop)
    return F.concat(toks, tk.ngrams(toks, 2))


def bags_of(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row, ids, counts): a document's vocabulary terms in one row, in term order."""
    e = tf.join(vocab, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("idx", "tf"))).alias("e"))
    return e.select("row", F.transform("e", lambda x: x["idx"]).alias("ids"), F.transform("e", lambda x: x["tf"].cast("double")).alias("counts"))


def fit_topics(bags: DataFrame, vocab: list[str], k: int = 10, max_iter: int = 30, seed: int = 42) -> TopicModel:
    """Batch variational Bayes, both priors 1 / k; ``bags`` (row, ids, counts)
    is read in every pass, so give a materialised frame."""
    alpha = eta = 1.0 / k
    lam = np.random.default_rng(seed).gamma(100.0, 0.01, (k, len(vocab)))
    bounds = []
    for _ in range(max_iter):
        stats, bound = one_pass(bags, lam, alpha)
        bounds.append(bound + topic_bound(lam, eta))
        lam = eta + stats
    return TopicModel(vocab, lam, alpha, eta, bounds)


def assign_topics(bags: DataFrame, model: TopicModel) -> DataFrame:
    """(row, Topic, weights): each document's largest topic, the first on ties."""
    shared = bags.sparkSession.sparkContext.broadcast((np.exp(expected_log(model.lam)).T, model.alpha))

    def run(batches):
        beta, alpha = shared.value
        for rows, ptr, ids, counts in blocks(batches):
            gamma, _ = e_step(ptr, ids, counts, beta, alpha)
            share = gamma / gamma.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(share.argmax(axis=1), pa.int32()),
                                              pa.array(share.tolist(), pa.list_(pa.float64()))], names=["row", "Topic", "weights"])

    return bags.mapInArrow(run, "row long, Topic int, weights array<double>")


def counted_bags(terms: DataFrame, words: list[str]) -> DataFrame:
    """(row, ids, counts) of (row, terms): a row's vocabulary terms counted
    inside the task, in term order; a row without any has empty lists."""
    shared = terms.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(words)})
    most = 256                                    # rows of an output batch

    def run(batches):
        place = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                part = batch.slice(begin, most)
                held = [sorted(Counter(place[t] for t in x.as_py() or () if t in place).items()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[i for i, _ in h] for h in held], pa.list_(pa.int32())),
                                                  pa.array([[float(n) for _, n in h] for h in held], pa.list_(pa.float64()))],
                                                 names=["row", "ids", "counts"])

    return terms.select("row", "terms").mapInArrow(run, BAG)


def numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text), written once."""
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")))


def numbered_terms(docs: DataFrame, text_col: str, stop: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row, term, tf) over all documents and their row numbers, written once."""
    rows = numbered(docs, text_col)
    tf = term_frequencies(rows.select("row", document_terms(F.col("text"), stop).alias("terms")), "row", F.col("terms"))
    return cut_lineage(tf), rows.select("row")


def lda_topics(docs: DataFrame, text_col: str, k: int = 10, max_iter: int = 30, vocab_size: int = 3000,
               min_df: int = 3, n_top: int = 8, seed: int = 42, stop: list[str] | None = None,
               save_dir: str | None = None) -> DataFrame:
    """L2: Topic, Count, Business_Name, Top_Words over all documents; those
    without a vocabulary term go to the first topic, as a tie does."""
    spark = docs.sparkSession
    stop = stop if stop is not None else dims.stopwords("general")
    terms = numbered(docs, text_col).select("row", document_terms(F.col("text"), stop).alias("terms"))
    voc = counted_vocabulary(terms, "row", F.col("terms"), terms.agg(F.count("*")).scalar(), vocab_size, min_df=min_df, unique=True)
    words = sorted(r["term"] for r in voc.select("term").collect())          # <= vocab_size
    if not words:
        raise ValueError("no term is in enough documents")
    # small rows, so few files: dealt out again, that every core has a part of each pass
    bags = cut_lineage(counted_bags(terms, words).repartition(PASS_TASKS * spark.sparkContext.defaultParallelism, "row"))
    model = fit_topics(bags, words, k, max_iter, seed)
    if save_dir:                                                          # L5
        model.save(spark, f"{save_dir}/lda")
    counts = assign_topics(bags, model).groupBy("Topic").agg(F.count("*").alias("n"))
    topics = dims.local_table(spark, list(enumerate(model.top_words(n_top))), "Topic int, Top_Words string")
    return (topics.join(counts, "Topic", "left")
            .select("Topic", F.coalesce("n", F.lit(0)).cast("bigint").alias("Count"),
                    F.coalesce(name_topic(F.col("Top_Words")), F.concat(F.lit("Topic "), F.col("Topic").cast("string")))
                    .alias("Business_Name"), "Top_Words")
            .orderBy(F.desc("Count"), "Topic"))
