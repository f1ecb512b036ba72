"""Toxicity: kernel, folding and windows against enumeration; learning on planted insults."""
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.llm import toxicity as tx


def mapped(text):
    low = " " + text.lower()
    return ["".join(c) if c.isalpha() else " " if k + 1 < len(low) and low[k + 1].isalpha() else None for k, c in enumerate(low)]


def enumerated(chars, first=None, stop=None):
    """{subsequence: weight} by trying all places."""
    out = {}
    for size, span in ((3, 5), (4, 6)):
        for at in combinations(range(len(chars)), size):
            if at[-1] - at[0] < span and (first is None or first <= at[0] < stop) and all(chars[k] is not None for k in at):
                s = tuple(chars[k] for k in at)
                out[s] = out.get(s, 0.0) + tx.DECAY ** (at[-1] - at[0] + 1)
    return out


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


LANDMARKS = [" idiot", " worth", " the", "ßü", " aaaaaa"]


def test_kernel_equals_enumeration():
    k = tx.Kernel(LANDMARKS)
    for text in ["idiot", "You i-d-i-o-t, go", "worthless idiots", "aaaa aaa", "", "Weißü", "x"]:
        chars = mapped(text)
        want = np.zeros((len(chars), len(LANDMARKS)))
        for j, m in enumerate(LANDMARKS):
            f = enumerated(list(m))
            norm = np.sqrt(dot(f, f)) or 1.0
            for s in range(len(chars)):
                want[s, j] = dot(enumerated(chars, s, s + tx.WINDOW), f) / norm
        x = k.alphabet.numbers(tx.shown(text))
        got = k.coordinates(x, list(range(len(chars))))
        assert np.allclose(got, want @ k.root)
        w = np.arange(1.0, got.shape[1] + 1)
        form = tx.Folded(k.alphabet, *k.folded(w))
        assert np.allclose(form.windows(text), got @ w, atol=1e-4)


def test_blocks_do_not_change_the_values(monkeypatch):
    k = tx.Kernel(LANDMARKS)
    form = tx.Folded(k.alphabet, *k.folded(np.ones(k.root.shape[1])))
    rng = random.Random(3)
    text = "".join(rng.choice("idot worthe-.a") for _ in range(997))
    whole = form.windows(text)
    monkeypatch.setattr(tx, "BLOCK", 64)
    assert np.allclose(form.windows(text), whole, atol=1e-6) and len(whole) == 998


def planted(n, seed):
    rng = random.Random(seed)
    plain = ["river", "table", "window", "garden", "letter", "summer", "winter", "orange", "the", "and", "worthy", "idea", "lose", "trust"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 40))]
        toxic = i % 5 == 0
        if toxic:
            stem = rng.choice(["idiot", "moron", "zukkwe" + rng.choice(["ta", "ren", "lo", "schaft"])])
            words.insert(rng.randint(0, len(words)), stem)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 0, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = planted(400, 1)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return tx.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_planted_insults_are_found(fitted):
    rows, labels = planted(300, 2)
    hits = [(fitted.score(t) >= 0.7) == bool(y) for (_, t), (_, _, y) in zip(rows, labels, strict=True)]
    assert np.mean(hits) >= 0.99


@pytest.mark.parametrize("text", ["you i.diot there", "such a mor*on now", "the id iot garden", "zukkwe.ren and table", "m.oron", "IDIOT"])
def test_gapped_and_inserted_characters(fitted, text):
    assert fitted.score(text) > max(fitted.score(t) for t in ("the garden and table", "winter idea", "trust the river", ""))
    assert fitted.score(text) >= 0.5


def test_score_of_a_text_is_that_of_its_worst_window(fitted):
    long = "the garden and table " * 20_000
    assert fitted.score(long + "idiot " + long) == pytest.approx(fitted.score("table idiot the"), abs=0.05)
    assert fitted.score(long) < 0.5


def test_query_on_the_given_table(spark, sf):
    rows = tx.op12_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_defined_cases(spark, fitted):
    d = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (3, "an idiot", 7)], "doc_id long, text string, toxicity int")
    d = d.select("*", F.lit("r").alias("row"), F.lit("o").alias("out"), F.lit(1).alias("a.b"))
    out = tx.score(d, fitted)
    assert out.columns == ["doc_id", "text", "row", "out", "a.b", "toxicity"]
    got = {(r["doc_id"], r["text"]): r["toxicity"] for r in out.collect()}
    assert got[1, None] == got[2, ""] < 0.5 < got[3, "an idiot"]
    assert tx.score(d.where("false"), fitted).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, None), (3, 1, 7), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert tx.train(d, labels).score("x") == 1.0 and tx.train(d, labels.where("false")).score("x") == 0.5
