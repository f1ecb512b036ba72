"""Approximate nearest neighbours by inner product: a hierarchical k-means tree
searched best bin first.

Inner product becomes distance by one more component, sqrt(M^2 - |x|^2), with M
the largest norm.  The tree is fitted on a bounded sample (``max_sample``
vectors, smallest hashes of the id first); every vector is then indexed: it
goes to the leaf it descends to.  A query walks the tree with a priority queue
over all open branches, nearest centre first, and visits leaves in that order.
How many it visits is calibrated: for up to ``calibration`` queries the true
neighbours are found in all rows, and visits widen until ``recall`` of them lie
in the visited leaves (and the leaves hold enough rows to fill the answer).

The indexed vectors are stored in the order of their leaves, dealt out evenly, so
a leaf that a third of all vectors fall into is worked on by many tasks.  Queries
go to them in parts of ``PART_BYTES`` with a bit per leaf; a task compares each
leaf's vectors with the queries that visit it and sends on k rows per query.

Defined cases: vectors that are null, zero, of another length than most, or
that hold null or non-finite components, and rows without an id, take no part;
a query never gets rows with its own id; equal scores go by the smaller id;
repeated rows are separate candidates; fewer candidates than k give them all;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oriel.llm.common import batch_bytes, materialize, read_table, shuffle_partitions

MAX_SAMPLE = 20_000
BRANCH = 12
LEAF_ROWS = 256
RECALL = 0.98
CALIBRATION = 64
V_BLOCK = 4096
Q_BLOCK = 1024
#: Bytes of the queries, with their bits of leaves, that all tasks hold at once.
PART_BYTES = 16 << 20
#: Rows of a file of the index, if there are many; rows of a batch of answers.
INDEX_ROWS = 1 << 18
OUT_ROWS = 1 << 16
#: Bytes of the vectors that reach Python at once.
BATCH_BYTES = 8 << 20


@dataclass
class Tree:
    scale: float
    centers: list[np.ndarray] = field(default_factory=list)  # per node: one row per child
    children: list[list[int]] = field(default_factory=list)  # node numbers, or -1 - leaf
    leaves: int = 0

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.scale ** 2 - np.square(x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        x, out = self.lift(x), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centers else []
        while todo:
            node, rows = todo.pop()
            near = np.argmin(_distances(x[rows], self.centers[node]), axis=1)
            for c, child in enumerate(self.children[node]):
                own = rows[near == c]
                if len(own) and child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def visit(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        if not self.centers:
            yield 0
            return
        q = np.append(q * (self.scale / max(np.linalg.norm(q), 1e-300)), 0.0)[None]
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if node < 0:
                yield -1 - node
                continue
            for d, child in zip(_distances(q, self.centers[node])[0].tolist(), self.children[node], strict=True):
                heapq.heappush(heap, (d, child))

    @cached_property
    def paths(self) -> np.ndarray:
        """Per leaf the places of the centres from the root to it, -1 after the last."""
        first = np.cumsum([0, *[len(c) for c in self.centers]])
        found, todo = {}, [(0, ())] if self.centers else []
        while todo:
            node, above = todo.pop()
            for i, child in enumerate(self.children[node]):
                own = (*above, int(first[node]) + i)
                if child < 0:
                    found[-1 - child] = own
                else:
                    todo.append((child, own))
        out = np.full((self.leaves, max(map(len, found.values()), default=0)), -1)
        for leaf, own in found.items():
            out[leaf, :len(own)] = own
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """As ``visit`` for each query: a row of all leaves.  A branch waits until
        the farthest centre on the way to it is the nearest left, and then its own
        branches go by the farthest centre below that one, and so on."""
        if not self.centers:
            return np.zeros((len(q), 1), np.int64)
        q = q * (self.scale / np.maximum(np.linalg.norm(q, axis=1), 1e-300))[:, None]
        d = np.column_stack([_distances(np.column_stack([q, np.zeros(len(q))]), np.concatenate(self.centers)), np.full(len(q), -np.inf)])
        out = np.empty((len(q), self.leaves), np.int64)
        for i, own in enumerate(d):
            farthest = np.maximum.accumulate(own[self.paths][:, ::-1], axis=1)
            out[i] = np.lexsort(farthest.T)
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.square(x).sum(axis=1)[:, None] - 2 * x @ c.T + np.square(c).sum(axis=1)[None]


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    centers = np.unique(centers, axis=0)
    for _ in range(rounds):
        near = np.argmin(_distances(x, centers), axis=1)
        used = np.unique(near)
        fresh = np.stack([x[near == j].mean(axis=0) for j in used])
        if len(fresh) == len(centers) and np.allclose(fresh, centers):
            break
        centers = fresh
    return centers, np.argmin(_distances(x, centers), axis=1)


def fit(sample: np.ndarray, scale: float, rows: int, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> Tree:
    """``rows``: how many vectors the index will hold."""
    tree, rng = Tree(scale), np.random.default_rng(11)
    least = max(8, int(leaf_rows * len(sample) / max(rows, 1)))
    x = tree.lift(sample)

    def grow(own: np.ndarray) -> int:
        centers, near = _kmeans(x[own], branch, rng) if len(own) > 2 * least else (None, None)
        if centers is None or len(np.unique(near)) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.centers)
        tree.centers.append(centers)
        tree.children.append([])
        tree.children[node] = [grow(own[near == c]) if (near == c).any() else grow(own[:0]) for c in range(len(centers))]
        return node

    if grow(np.arange(len(x))) < 0:
        tree.leaves = 1
    return tree


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, v) that take part."""
    v = F.col("v")
    ok = (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    good = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ok)
    top = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # one row
    return good.where(F.size("v") == (top["n"] if top else -1))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    n = len(lists)
    return np.asarray(lists.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(q: np.ndarray, q_ids, x: np.ndarray, x_ids, k: int):
    """For each query row: positions and exact scores of its k best rows of x,
    rows of its own id left out, best first, ties by smaller id."""
    rough = q @ x.T
    for i in range(len(q)):
        s = np.where(x_ids == q_ids[i], -np.inf, rough[i])
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            some = np.flatnonzero((s >= least - 1e-9 * max(1.0, abs(least))) & (s > -np.inf))
        else:
            some = np.flatnonzero(s > -np.inf)
        exact = (x[some] * q[i]).sum(axis=1)  # the same order of additions for every row: equal vectors tie
        best = np.lexsort((x_ids[some], -exact))[:k]
        yield some[best], exact[best]


def _calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, most: int) -> int:
    """Leaves to visit: true neighbours of some queries, found in all rows, have to lie in them."""
    some = queries.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(most).collect()
    if not some:
        return 1
    q, ids = np.array([r["v"] for r in some], np.float64), np.array([r["vec_id"] for r in some])
    shared = indexed.sparkSession.sparkContext.broadcast((q, ids))

    def scan(batches):
        q, ids = shared.value
        for b in batches:
            x, x_ids, leaf = _matrix(b.column(2)), np.asarray(b.column(1)), np.asarray(b.column(0))
            if not len(x):
                continue
            for i, (at, s) in enumerate(nearest(q, ids, x, x_ids, k)):
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i, np.int32)), pa.array(x_ids[at]), pa.array(s), pa.array(leaf[at])],
                        names=["q", "vec_id", "score", "leaf"])

    kind = indexed.schema["vec_id"].dataType.simpleString()
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = (indexed.select("leaf", "vec_id", "v").mapInArrow(scan, f"q int, vec_id {kind}, score double, leaf int")
            .withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "leaf").collect())  # most * k rows
    place = np.argsort(tree.order(q), axis=1)
    need = sorted(place[r["q"]][r["leaf"]] for r in true)
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] + 1 if need else 1


def visited(tree: Tree, q: np.ndarray, visits_n: int, held: np.ndarray, rows: int) -> np.ndarray:
    """Bits of the leaves that each query visits: the first ``visits_n``, and more until they hold ``rows`` rows."""
    out = np.zeros((len(q), -(-tree.leaves // 8)), np.uint8)
    for b in range(0, len(q), 64):
        order = tree.order(q[b:b + 64])
        seen = np.cumsum(held[order], axis=1) - held[order]
        on = np.zeros(order.shape, bool)
        np.put_along_axis(on, order, (np.arange(tree.leaves) < visits_n) | (seen < rows), axis=1)
        out[b:b + 64] = np.packbits(on, axis=1)
    return out


class Best:
    """The k best rows so far of each query of a part.  ``asking``: per leaf the bits of the queries that visit it."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, asking: np.ndarray, k: int):
        self.q, self.q_ids, self.asking, self.k = q, q_ids, asking, k
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q), -np.inf)      # the score of the k-th

    def add(self, leaf: int, x: np.ndarray, x_ids: np.ndarray) -> None:
        """Rows of one leaf."""
        asks = np.flatnonzero(np.unpackbits(self.asking[leaf], count=len(self.q)))
        for a in range(0, len(asks), Q_BLOCK):
            for b in range(0, len(x), V_BLOCK):
                self._compare(asks[a:a + Q_BLOCK], x[b:b + V_BLOCK], x_ids[b:b + V_BLOCK])

    def _compare(self, asks: np.ndarray, x: np.ndarray, x_ids: np.ndarray) -> None:
        def near(least):
            with np.errstate(invalid="ignore"):
                return least - 1e-9 * np.maximum(1.0, np.abs(least))

        rough = self.q[asks] @ x.T
        some = rough >= np.nan_to_num(near(self.least[asks]), nan=-np.inf, neginf=-np.inf)[:, None]
        many = np.flatnonzero(some.sum(axis=1) > self.k)
        if len(many):                              # only the k best of these rows, its own id's left out
            s = np.where(x_ids == self.q_ids[asks[many], None], -np.inf, rough[many])
            least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            some[many] &= s >= np.nan_to_num(near(least), nan=-np.inf, neginf=-np.inf)[:, None]
        i, j = np.nonzero(some)
        keep = x_ids[j] != self.q_ids[asks[i]]
        i, j = asks[i[keep]], j[keep]
        if not len(i):
            return
        scores = np.concatenate([(x[j[c:c + V_BLOCK]] * self.q[i[c:c + V_BLOCK]]).sum(axis=1)  # the same order of additions for every row: equal vectors tie
                                 for c in range(0, len(i), V_BLOCK)])
        old = np.isin(self.at, i)
        at, ids, scores = np.concatenate([self.at[old], i]), np.concatenate([self.ids[old], x_ids[j]]), np.concatenate([self.scores[old], scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        full = rank == self.k - 1
        self.least[at[full]] = scores[full]
        first = rank < self.k
        self.at, self.ids, self.scores = (np.concatenate([mine[~old], new[first]]) for mine, new in
                                          ((self.at, at), (self.ids, ids), (self.scores, scores)))


def _compared(indexed: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(query_id, q_row, vec_id, score): the k best rows in each task for the queries of a part."""
    asks = part.toArrow()      # PART_BYTES or little more
    bits = np.frombuffer(b"".join(asks["leaves"].to_pylist()), np.uint8).reshape(max(asks.num_rows, 1), -1)
    # from bits of leaves to bits of queries, eight leaves at a time
    asking = np.concatenate([np.packbits(np.unpackbits(bits[:, c:c + 1], axis=1), axis=0).T for c in range(bits.shape[1])] or [np.zeros((0, 0), np.uint8)])
    shared = indexed.sparkSession.sparkContext.broadcast((_matrix(asks["q"]), asks["q_id"].to_numpy(), asks["q_row"].to_numpy(), asking))

    def run(batches):
        q, q_ids, q_rows, asking = shared.value
        best = Best(q, q_ids, asking, k)
        for b in batches:
            if not len(q) or not b.num_rows:
                continue
            leaf, x_ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2))
            ends = [*np.flatnonzero(np.diff(leaf)) + 1, len(leaf)]
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                best.add(int(leaf[begin]), x[begin:end], x_ids[begin:end])
        for c in range(0, len(best.at), OUT_ROWS):
            at = best.at[c:c + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(q_rows[at]), pa.array(best.ids[c:c + OUT_ROWS]), pa.array(best.scores[c:c + OUT_ROWS])],
                                             names=["query_id", "q_row", "vec_id", "score"])

    return indexed.select("leaf", "vec_id", "v").mapInArrow(run, "query_id bigint, q_row bigint, vec_id bigint, score double")


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
           recall: float = RECALL, max_sample: int = MAX_SAMPLE, leaf_rows: int = LEAF_ROWS,
           calibration: int = CALIBRATION) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each row where
    ``is_query`` (an expression over vec_id) holds."""
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col)
    facts = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()
    kind = good.schema["vec_id"].dataType.simpleString()
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("v").toArrow()  # bounded
    tree = fit(_matrix(sample["v"]), float(np.sqrt(facts["m"] or 1.0)) * (1 + 1e-12), facts["n"], leaf_rows=leaf_rows)
    shared = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in batches:
            x = _matrix(b.column(1))
            leaf = shared.value.assign(x) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.columns], names=["leaf", "vec_id", "v", "row"])

    vec = good.schema["v"].dataType.simpleString()
    # the range's sample runs the index once more; storing it unsorted first would cost as much disk as the vectors
    parts = max(shuffle_partitions(spark), -(-facts["n"] // INDEX_ROWS))
    with batch_bytes(spark, BATCH_BYTES):
        indexed = materialize(good.withColumn("row", F.monotonically_increasing_id())
                              .mapInArrow(index, f"leaf int, vec_id {kind}, v {vec}, row bigint")
                              .repartitionByRange(parts, "leaf", "row").sortWithinPartitions("leaf"), "ann-index")
    held = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():
        held[r["leaf"]] = r["count"]
    queries = indexed.where(is_query).select("vec_id", "v", "row")
    visits_n = _calibrate(indexed, queries.select("vec_id", "v"), tree, k, recall, calibration)
    own, asked = queries.groupBy("vec_id").count().agg(F.max("count"), F.sum("count")).first()
    enough = spark.sparkContext.broadcast((visits_n, held, k + (own or 1)))

    def visit(batches):
        for b in batches:
            bits = visited(shared.value, _matrix(b.column(1)), *enough.value) if b.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in bits], pa.binary())], names=["q_id", "q", "q_row", "leaves"])

    with batch_bytes(spark, BATCH_BYTES):
        visits = materialize(queries.mapInArrow(visit, f"q_id {kind}, q {vec}, q_row bigint, leaves binary"), "ann-visits")
    size = good.select(F.size("v")).first()
    parts = max(1, -(-(asked or 0) * (8 * (size[0] if size else 0) + tree.leaves // 8 + 1) // PART_BYTES))
    found = [_compared(indexed, visits.where(F.pmod(F.xxhash64("q_row"), F.lit(parts)) == p), k) for p in range(parts)]
    found = reduce(DataFrame.unionAll, found)
    best = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0, 20)
