import random
import re

import numpy as np

from oriel.llm import neardup


def brute(rows, threshold=neardup.THRESHOLD):
    """Classes by all pairs: {doc index: smallest index of its class}."""
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = len(sets[i] & sets[j])
            if same or both and both / len(sets[i] | sets[j]) >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def _corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((3, 8, 60, 200)))]
        for _ in range(rng.choice((1, 2, 6))):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 12))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    # a chain: each close to the next, the ends far apart
    chain = [word() for _ in range(120)]
    for i in range(8):
        rows.append(" ".join(chain[i * 6:i * 6 + 80]))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def _classes(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def test_classes_equal_brute_force(spark, docs):
    rows = _corpus()
    classes, kept = neardup.near_duplicates(docs(rows))
    want = brute(rows)
    assert _classes(classes) == dict(enumerate(want))
    stay = neardup.keep_one(docs(rows), kept)
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(want)) and stay.columns == docs(rows).columns


def test_classes_on_the_tables(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = _classes(neardup.op10_minhash(spark, sf))
    want = brute(rows)
    assert got == {rows[i][0]: rows[w][0] for i, w in enumerate(want)}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    k = 512
    for share in (0.3, 0.6, 0.9):
        el = np.arange(200, dtype=np.uint64) * np.uint64(7919) + np.uint64(11)
        a = rng.uniform(0.1, 4, 200)
        b = np.where(rng.random(200) < share, a, rng.uniform(0.1, 4, 200))
        sig = neardup.dart_signatures(np.tile(el, 2), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, k)
        assert (sig != 0).all()
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)


def test_signature_does_not_depend_on_the_batch():
    el = np.arange(50, dtype=np.uint64) + np.uint64(5)
    one = neardup.dart_signatures(el, np.ones(50), np.zeros(50, int), 1, 96)
    two = neardup.dart_signatures(np.concatenate([el[:9], el]), np.ones(59), np.repeat([0, 1], [9, 50]), 2, 96)
    assert (one[0] == two[1]).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(bytes([a]), bytes([a + 1])) for a in range(40, 90)] + [(bytes([rng.randrange(30)]), bytes([rng.randrange(30)])) for _ in range(25)]
    got = {bytes(r["node"]): bytes(r["comp"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    assert got == {n: root(n) for n in parent if n not in loops}


def test_defined_cases(spark, docs):
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "?!"), (4, "?!"), (5, "..."), (6, "Some Words"), (7, "some, words"), (8, long), (9, long + " end"),
            (10, "copy of this text here"), (10, "copy of this text here"), (None, "copy of this text here"), (11, "alone in the wide world now")]
    classes, kept = neardup.near_duplicates(docs(rows))
    got = classes.collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, None: 10, 11: 11}
    stay = sorted(r["doc_id"] for r in neardup.keep_one(docs(rows), kept).collect())
    assert stay == [1, 3, 5, 6, 8, 10, 11]
    classes, kept = neardup.near_duplicates(docs([]))
    assert classes.count() == 0 and neardup.keep_one(docs([]), kept).count() == 0
    odd = spark.createDataFrame([(1, "a b c", 5, 6, "x")], "node long, text string, rows long, did long, row string")
    classes, kept = neardup.near_duplicates(odd, "node")
    assert [r["did"] for r in neardup.keep_one(odd, kept, "node").collect()] == [6]


def test_wide_buckets_lose_no_link(spark, docs):
    """Many texts that share a frame but fall into different groups meet in the
    same buckets; several rounds of pivots are needed."""
    rng = random.Random(9)
    frame = [f"f{i}" for i in range(60)]
    rows = []
    for g in range(14):
        own = [f"g{g}x{i}" for i in range(12)]
        for _ in range(3):
            tail = list(own)
            tail[rng.randrange(12)] = f"r{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(frame + tail)))
    classes, _ = neardup.near_duplicates(docs(rows), bands=48, rows=2)
    assert _classes(classes) == dict(enumerate(brute(rows)))


def test_weighted_classes_follow_the_counts(spark, docs):
    """Weighted similarity 0.93, that of the sets 0.42: one class only when weighted."""
    phrase = "one two three four five "
    a = phrase * 40 + " ".join(f"a{i}" for i in range(3))
    b = phrase * 40 + " ".join(f"b{i}" for i in range(4))
    rows = [(1, a), (2, b), (3, " ".join(f"c{i}" for i in range(50)))]
    assert _classes(neardup.near_duplicates(docs(rows))[0]) == {1: 1, 2: 2, 3: 3}
    assert _classes(neardup.near_duplicates(docs(rows), weighted=True)[0]) == {1: 1, 2: 1, 3: 3}


def test_weighted_classes_equal_brute_force(spark, docs):
    from collections import Counter
    rng = random.Random(21)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(6)}" for _ in range(rng.choice((30, 80)))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, 5))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(6)}"
            rows.append((len(rows), " ".join(own)))

    def bag(t):
        w = t.split()
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    classes, _ = neardup.near_duplicates(docs(rows), bands=48, rows=2, weighted=True, sieve=False)
    assert _classes(classes) == dict(enumerate(parent))


def test_without_the_sieve(spark, docs):
    rows = _corpus(4)
    classes, _ = neardup.near_duplicates(docs(rows), sieve=False)
    assert _classes(classes) == dict(enumerate(brute(rows)))


def test_texts_reach_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    """Every step that sends texts or elements to Python, not the comparisons alone."""
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name, **kw: seen.update({name: spark.conf.get(key)}) or write(df, name, **kw))
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:30], f"x{i}", f"y{i}"])) for i in range(4)]
    before = spark.conf.get(key)
    neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    neardup.lone_elements(spark.createDataFrame([(b"a", b"123456"), (b"b", b"123456abcdef")], "node binary, elements binary"))
    assert {seen[n] for n in ("signatures", "elements", "lone")} == {str(neardup.BATCH_BYTES)} and spark.conf.get(key) == before
