import numpy as np

from oriel.llm import quality


def _rows():
    good = [(i, f"plain words about topic {i} and more of it.") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} $$$ ### CLICK!!") for i in range(30)]
    return good, bad


def test_held_out_accuracy_on_the_tables(spark, sf):
    got = quality.op2_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_labels_do_not_matter(spark, docs, table_dir):
    good, bad = _rows()
    d = docs(good + bad)
    lab = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    held = {r["doc_id"] for r in d.where(quality.held_out()).collect()}
    flipped = [(i, 1 - q if i in held else q) for i, q in lab]
    out = []
    for rows in (lab, flipped):
        path = table_dir(documents=d, labels=spark.createDataFrame(rows, "doc_id long, quality int"))
        out.append(sorted((r["doc_id"], r["score"]) for r in quality.op2_quality(spark, path).collect()))
    assert out[0] == out[1]
    scores = dict(out[0])
    assert min(scores[i] for i, _ in good) > 0.5 > max(scores[i] for i, _ in bad)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The dual's gap closes: primal and dual values of a small problem meet."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(30)]
    y = np.where([r[0] < 4 for r in rows], 1.0, -1.0)
    w, ratio, bias = quality.fit_margin(rows, y, epochs=2000)
    raw = np.divide(w, ratio, out=np.zeros_like(w), where=ratio != 0)
    x = [ratio[r] / np.sqrt(np.square(ratio[r]).sum()) for r in rows]
    upper = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    loss = sum(u * max(0, 1 - t * (raw[r] @ v + bias)) for u, t, r, v in zip(upper, y, rows, x))
    half = 0.5 * (np.square(raw).sum() + bias ** 2)
    # no nearby point is better than the solution
    for _ in range(200):
        step = np.zeros_like(raw)
        step[:40] = rng.normal(0, 0.02, 40)
        b = bias + rng.normal(0, 0.02)
        other = 0.5 * (np.square(raw + step).sum() + b ** 2) + sum(
            u * max(0, 1 - t * ((raw + step)[r] @ v + b)) for u, t, r, v in zip(upper, y, rows, x))
        assert other > half + loss - 1e-2


def test_defined_cases(spark, docs):
    d = docs([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y" * 50_000)])
    for rows, want in (([], 0.5), ([(3, 1)], 1.0), ([(3, 0)], 0.0), ([(3, None), (2, 7)], 0.5)):
        lab = spark.createDataFrame(rows, "doc_id long, quality int")
        got = quality.score(d, quality.train(d, lab)).collect()
        assert len(got) == 5 and {r["score"] for r in got} == {want}
    assert quality.score(docs([]), quality.train(docs([]), spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    # clashing names
    odd = spark.createDataFrame([(1, "a b", "r")], "row long, text string, out string")
    assert quality.score(odd, quality.Model(np.zeros(quality.DIM), np.zeros(quality.DIM), 0, 0, 0, 0.25)).first().asDict() == {
        "row": 1, "text": "a b", "out": "r", "score": 0.25}


def test_scores_equal_a_plain_sum_over_ngrams(spark, sf):
    """The query's rows against sets of byte n-grams, one text at a time."""
    import math
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out())
    model = quality.train(docs, labels)

    def plain(text):
        raw = (text or "").encode()
        ids = set(raw) | {256 + raw[i] * 256 + raw[i + 1] for i in range(len(raw) - 1)}
        ids |= {256 + 65536 + (((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2 ** 32) >> (32 - quality.BITS3)) for i in range(len(raw) - 2)}
        norm = math.sqrt(sum(model.ratio[i] ** 2 for i in ids))
        margin = (sum(model.weights[i] for i in ids) / norm if norm else 0.0) + model.bias
        return 1 / (1 + math.exp(-min(30, max(-30, model.a * margin + model.b))))

    got = {r["doc_id"]: r for r in quality.op2_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert abs(g["score"] - plain(r["text"])) < 1e-9 and g["predicted"] == int(g["score"] >= 0.5)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
