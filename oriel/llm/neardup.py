"""Near-duplicates by DartMinHash signatures and banded joining.

Every element (a hash of five consecutive words) of weight w owns the region
[0, w) x [0, inf) of weight and rank.  Hashed darts arrive there as a Poisson
process that depends on the element alone, and each dart names one of ``k``
coordinates.  Documents throw only the darts of rank below t / total weight,
t = k ln k + 2k; the earliest dart per coordinate is the signature (documents
that miss a coordinate double t).  Two signatures agree at a coordinate with
the weighted Jaccard similarity of their sets.

Equal texts are grouped first (128-bit text hash).  Signatures are cut into
bands; equal bands make candidates.  In each band bucket members are compared
with a pivot, never all with all, so a bucket costs its size; the similarity
of the full sets (at least ``threshold``) decides.  Further rounds take new
pivots for buckets whose members still are in different groups, until none is
left: no link between different groups is lost.  Before that a bucket's most central
member (the smallest share of elements that no other open text has: of a text
and its edited copies the one most others are near to) is compared with all
others.  The elements that two members share with it, and those outside it that
other open texts have, bound what the two can have in common, and pairs whose
bound is too small for the threshold are never written.  With ``sieve``
pairs whose signatures agree in so few coordinates that a similarity of the
threshold is six standard deviations away are left out before the sets are
compared; without it every pair is compared.  With ``weighted`` an element
counts as often as it occurs, in the signatures and in the comparison (the
sum of the smaller counts over that of the larger).  Groups are the connected components of the
links, computed by alternating large-star and small-star steps on tables; each
round works on the groups of the round before.

Defined cases: a null text counts as an empty one; very long texts are taken
whole; texts without words form a
group only with equal texts; texts of fewer than five words are one element;
ids may be null (they sort after all others) and repeated rows are copies; other
columns are not touched; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oriel.llm.common import batch_bytes, giving_back, materialize, read_table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
PIVOTS = (64, 4096)
WORD = re.compile(r"\w+")
CHUNK_ELEMENTS = 60_000
#: Bytes of an Arrow batch: of texts, elements, or pairs with the elements of both texts.
BATCH_BYTES = 8 << 20


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: _Hashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct element hashes of a text and their counts."""
    words = WORD.findall((text or "").lower())
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(w):
        return w, np.zeros(0)
    n = min(size, len(w))
    h = w[:len(w) - n + 1].copy()
    for i in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i]
    return np.unique(_mix(h), return_counts=True)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """(docs, k) signatures of weighted sets; row i belongs to set doc[i].
    Sets without elements keep zeros."""
    sig = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weights, minlength=docs)
    # unit cells of the weight axis: cell c of an element covers [c, c + 1)
    cells = np.ceil(weights).astype(np.int64)
    el, d, top = np.repeat(elements, cells), np.repeat(doc, cells), np.repeat(weights, cells)
    c = np.arange(len(el)) - np.repeat(np.cumsum(cells) - cells, cells)
    el, top = _mix(el + c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), top - c
    t = k * np.log(k) + 2 * k
    left = np.flatnonzero(total > 0)
    while len(left):
        bound = np.zeros(docs)
        bound[left] = t / total[left]
        active = np.flatnonzero(bound[d] > 0)
        rank, step, thrown = np.zeros(len(active)), 0, []
        while len(active):
            u = _mix(el[active] + np.uint64((step * 0xA0761D6478BD642F) % (1 << 64)))
            rank = rank - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740993.0)
            inside = rank <= bound[d[active]]
            active, rank, u = active[inside], rank[inside], u[inside]
            dart = _mix(u ^ np.uint64(0xE7037ED1A0B428DB))
            hit = (dart >> np.uint64(32)).astype(np.float64) / 4294967296.0 < top[active]
            thrown.append((d[active][hit], (dart[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k), rank[hit], dart[hit]))
            step += 1
        at, coord, ranks, darts = (np.concatenate(x) for x in zip(*thrown, strict=True))
        order = np.argsort(-ranks, kind="stable")  # the earliest dart is written last
        sig[at[order], coord[order].astype(np.int64)] = darts[order]
        left = left[(sig[left] == 0).any(axis=1)]
        sig[left] = 0
        t *= 2
    return sig


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """(docs, bands) hashes of the signature's bands."""
    parts = sig.reshape(len(sig), bands, -1)
    h = np.zeros(parts.shape[:2], np.uint64)
    for i in range(parts.shape[2]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h


def _pack(h: np.ndarray) -> bytes:
    """The low 48 bits of sorted hashes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return raw.view("<u8").reshape(-1)


def similarity(a: bytes, b: bytes) -> float:
    x, y = _unpack(a), _unpack(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _node(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode()).digest()


def _signer(bands: int, rows: int, weighted: bool):
    def run(batches):
        hashes = _Hashes()
        for b in batches:
            texts, lo = b.column(1), 0
            while lo < len(b):
                nodes, els, ns, n, hi = [], [], [], 0, lo
                while hi < len(b) and (hi == lo or n < CHUNK_ELEMENTS):
                    text = texts[hi].as_py()
                    h, c = shingles(text, hashes)
                    nodes.append(_node(text))
                    els.append(h)
                    ns.append(c)
                    n += len(h)
                    hi += 1
                doc = np.repeat(np.arange(len(els)), [len(h) for h in els])
                el = np.concatenate(els)
                w = np.concatenate(ns).astype(np.float64) if weighted else np.ones(len(el))
                sig = dart_signatures(el, w, doc, len(els), bands * rows)
                keys, low = band_hashes(sig, bands).astype(np.int64), sig.astype(np.uint8)
                has = [len(h) > 0 for h in els]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(nodes, pa.binary()),
                     pa.array([keys[i].tolist() if has[i] else [] for i in range(len(els))], pa.list_(pa.int64())),
                     pa.array([low[i].tobytes() for i in range(len(els))], pa.binary())],
                    names=["did", "node", "keys", "sig"])
                lo = hi

    return giving_back(run)


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An element per occurrence: sets of them have the weighted similarity of
    the elements with their counts."""
    c = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return _mix(np.repeat(elements, counts) + c.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def _packer(weighted: bool):
    def run(batches):
        hashes = _Hashes()
        for b in batches:
            got = []
            for t in b.column(1):
                el, n = shingles(t.as_py(), hashes)
                el = occurrences(el, n) if weighted and len(el) else el
                got.append(_pack(np.sort(el & np.uint64((1 << 48) - 1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["node", "elements"])

    return giving_back(run)


def _measurer(batches):
    """How many elements the two texts of a pair have in common."""
    for b in batches:
        n = [len(np.intersect1d(_unpack(x.as_py()), _unpack(y.as_py()), assume_unique=True)) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["a", "b", "common"])


def _comparer(threshold: float):
    def run(batches):
        for b in batches:
            keep = pa.array([similarity(x.as_py(), y.as_py()) >= threshold for x, y in zip(b.column(2), b.column(3), strict=True)],
                            pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keep], names=["a", "b", "linked"])

    return giving_back(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (a, b): comp is the component's
    smallest node.  Alternates large-star and small-star until every edge
    joins a node to the smallest of its component."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = near.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = (joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
                   .union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))))
        return out.where(F.col("a") != F.col("b")).distinct()

    def done(e: DataFrame) -> bool:
        """Edges go from the smaller node a to b.  If no b has two and none is
        an a of other edges, they are stars around their smallest nodes."""
        ends = e.select(F.col("b").alias("node"), F.lit(1).alias("as_b"), F.lit(0).alias("as_a")).union(
            e.select("a", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("as_b").alias("n"), F.max("as_a").alias("m")).where("n > 1 OR (n = 1 AND m = 1)").isEmpty()

    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where(F.col("a") != F.col("b")).distinct(), "edges")
    while not done(e):
        e = materialize(star(star(e, True), False), "edges")
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def _siever(least: int):
    """Keeps pairs whose signatures agree in at least ``least`` coordinates."""

    def run(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(b), -1) for c in (b.column(2), b.column(3)))
                b = b.filter(pa.array((x == y).sum(axis=1) >= least))
            yield b.select(["a", "b"])

    return giving_back(run)


def links(docs: DataFrame, nodes: DataFrame, text_col: str, threshold: float, coordinates: int,
          pivots: tuple[int, ...] = PIVOTS, weighted: bool = False, sieve: bool = True) -> DataFrame:
    """(node, comp): the group of every text node that shares a bucket."""
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    # buckets of at least two texts
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = materialize(keyed.join(sizes, ["band", "key"]), "bucket-members")
    text_node = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    candidates = members.select("node").distinct()
    texts = (docs.select(text_node.alias("node"), F.col(f"`{text_col}`").alias("text"))
             .join(candidates, "node", "left_semi").dropDuplicates(["node"]))
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        elements = materialize(texts.mapInArrow(_packer(weighted), "node binary, elements binary"), "elements", codec="uncompressed")
    signatures = materialize(nodes.select("node", "sig").join(candidates, "node", "left_semi"), "candidate-signatures")
    least = int(coordinates * threshold - 6 * np.sqrt(coordinates * threshold * (1 - threshold)))

    def beside(pairs: DataFrame, table: DataFrame, col: str) -> DataFrame:
        return (pairs.join(table.select(F.col("node").alias("b"), F.col(col).alias("y")), "b")
                .join(table.select(F.col("node").alias("a"), F.col(col).alias("x")), "a").select("a", "b", "x", "y"))

    def verify(pairs: DataFrame) -> DataFrame:
        near = beside(pairs, signatures, "sig").mapInArrow(_siever(least), "a binary, b binary") if sieve else pairs
        with batch_bytes(docs.sparkSession, BATCH_BYTES):
            return materialize(beside(near, elements, "elements").mapInArrow(
                _comparer(threshold), "a binary, b binary, linked boolean").where("linked").select("a", "b"), "links")

    def relabel(labels: DataFrame, found: DataFrame) -> DataFrame:
        """Groups after ``found`` links are added to those of ``labels``."""
        ends = (found.join(labels.withColumnsRenamed({"node": "a", "comp": "ca"}), "a")
                .join(labels.withColumnsRenamed({"node": "b", "comp": "cb"}), "b").where("ca != cb"))
        merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
            F.col("node").alias("comp"), F.col("comp").alias("to"))
        return materialize(labels.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")

    def between(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members (with comp and the size of their group in the bucket) of
        buckets in which several groups meet."""
        named = members.join(labels, "node")
        groups = named.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("size"))
        mixed = groups.groupBy("band", "key").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("band", "key")
        return materialize(named.join(groups.join(mixed, ["band", "key"]), ["band", "key", "comp"]), "open-members")

    # round 1: every member with its bucket's smallest node
    labels = candidates.select("node", F.col("node").alias("comp"))
    found = verify(members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    if not found.isEmpty():
        labels = relabel(labels, found)
    # buckets of two are done, and so is the first pivot
    met = between(members.where("n > 2 AND node != pivot").select("band", "key", "node"), labels)
    if met.isEmpty():
        return labels
    # Elements that no other open text has are in no intersection.  Of two texts
    # x and y and a third one p of their bucket, |x & y| is at most
    # min(|x & p|, |y & p|) + min(others of x, others of y), "others" being the
    # elements outside p that some other open text has.  A similarity of t needs
    # |x & y| >= t / (1 + t) * (|x| + |y|), and |x & y| >= t * |x|.
    own = lone_elements(elements.join(met.select("node").distinct(), "node", "left_semi"))
    stat = met.select("band", "key", "node").join(own, "node")
    central = stat.groupBy("band", "key").agg(F.min(F.struct((F.col("lone") / F.col("total")).alias("share"), F.col("node").alias("ref"))).alias("m"))
    stat = materialize(stat.join(central.select("band", "key", F.col("m.ref").alias("ref")), ["band", "key"]).where("node != ref"), "bucket-refs")
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        measured = materialize(beside(stat.select(F.col("ref").alias("a"), F.col("node").alias("b")).distinct(), elements, "elements")
                               .mapInArrow(giving_back(_measurer), "a binary, b binary, common long"), "measured")
    sizes_of = own.select(F.col("node").alias("a"), F.col("total").alias("ta"))
    near = (measured.join(sizes_of, "a").join(sizes_of.withColumnsRenamed({"a": "b", "ta": "tb"}), "b")
            .where(F.col("common") >= threshold * (F.col("ta") + F.col("tb") - F.col("common"))).select("a", "b"))
    if not near.isEmpty():
        labels = relabel(labels, near)
    share = F.lit(threshold / (1 + threshold) - 1e-9)
    open_ = materialize(
        stat.join(measured.withColumnsRenamed({"a": "ref", "b": "node"}), ["ref", "node"])
        .where(F.col("lone") <= F.col("total") * (1 - threshold + 1e-9))
        .select("band", "key", "node", "total", "common", (F.col("total") - F.col("lone") - F.col("common")).alias("others")), "open")
    tested, turn = None, 0
    while True:
        met = between(open_, labels)
        if met.isEmpty():
            return labels
        order = Window.partitionBy("band", "key").orderBy("size", "comp", "node")
        chosen = materialize(
            met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots[min(turn, len(pivots) - 1)])
            .select(F.col("band").alias("pband"), F.col("key").alias("pkey"), F.col("node").alias("p"), F.col("comp").alias("pc"),
                    F.col("common").alias("pcommon"), F.col("others").alias("pothers"), F.col("total").alias("ptotal")), "pivots")
        common = F.least("common", "pcommon") + F.least("others", "pothers")
        pairs = (met.join(chosen, (F.col("band") == F.col("pband")) & (F.col("key") == F.col("pkey")) & (F.col("comp") != F.col("pc"))
                          & (common >= (F.col("total") + F.col("ptotal")) * share))
                 .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct())
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = verify(pairs)
        if not found.isEmpty():
            labels = relabel(labels, found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        open_ = met.select("band", "key", "node", "total", "common", "others").join(
            chosen.select(F.col("pband").alias("band"), F.col("pkey").alias("key"), F.col("p").alias("node")),
            ["band", "key", "node"], "left_anti")
        turn += 1


def _unpacker(batches):
    for b in batches:
        for node, elements in zip(b.column(0), b.column(1), strict=True):
            h = _unpack(elements.as_py()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()] * len(h), pa.binary()), pa.array(h)], names=["node", "h"])


def lone_elements(elements: DataFrame) -> DataFrame:
    """(node, lone, total): how many of a text's elements no other text has, of how many."""
    each = elements.select("node", "elements").mapInArrow(giving_back(_unpacker), "node binary, h bigint")
    lone = (each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
            .groupBy("node").agg(F.count(F.lit(1)).alias("lone")))
    total = elements.select("node", (F.octet_length("elements") / 6).cast("long").alias("total"))
    with batch_bytes(elements.sparkSession, BATCH_BYTES):
        return materialize(total.join(lone, "node", "left").select("node", F.coalesce("lone", F.lit(0)).alias("lone"), "total"), "lone")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, weighted: bool = False, sieve: bool = True) -> tuple[DataFrame, DataFrame]:
    """(classes, kept).  classes: one row per row of ``docs``: id, node (text
    hash), comp (class, as the smallest text hash), class_id (smallest id of
    the class), class_rows.  kept: one row per class: node, id of the row that
    stays, rows (how many rows of that text have that id)."""
    kind = docs.schema[id_col].dataType.simpleString()
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        signed = materialize(
            docs.select(F.col(f"`{id_col}`").alias("did"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(_signer(bands, rows, weighted), f"did {kind}, node binary, keys array<bigint>, sig binary"),
            "signatures", codec="uncompressed")
    per_id = signed.groupBy("node", "did").agg(F.count(F.lit(1)).alias("same"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    first = F.min(F.struct(F.col("did").isNull().alias("none"), F.col("did").alias("did"), F.col("same").alias("same")))
    nodes = materialize(per_id.groupBy("node").agg(first.alias("first"), F.sum("same").alias("copies"), F.first("keys").alias("keys"),
                                                   F.first("sig").alias("sig")), "text-nodes", codec="uncompressed")
    labels = links(docs, nodes, text_col, threshold, bands * rows, weighted=weighted, sieve=sieve)
    named = nodes.drop("keys", "sig").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named, "classes")
    best = F.min(F.struct(F.col("first.none").alias("none"), F.col("first.did").alias("did"), F.col("node").alias("node"),
                          F.col("first.same").alias("same")))
    groups = named.groupBy("comp").agg(best.alias("best"), F.sum("copies").alias("class_rows"))
    classes = (signed.select("did", "node").join(named.select("node", "comp"), "node")
               .join(groups.select("comp", F.col("best.did").alias("class_id"), "class_rows"), "comp")
               .select(F.col("did").alias(id_col), "node", "comp", "class_id", "class_rows"))
    kept = groups.select(F.col("best.node").alias("node"), F.col("best.did").alias("did"), F.col("best.same").alias("rows"))
    return classes, kept


def keep_one(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs`` that stays of each class."""
    node = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("node"),
                      F.col(f"`{id_col}`").alias("id"))
    mine = src.join(kept, "node").where(F.col("id").eqNullSafe(F.col("did")))
    one = mine.where("rows = 1").select("row").union(
        mine.where("rows > 1").dropDuplicates(["node"]).select("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    classes, _ = near_duplicates(docs)
    return classes.select("doc_id", "class_id", "class_rows", F.hex("comp").alias("class_key"))
