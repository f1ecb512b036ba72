"""Spelling variants against brute force over all edits."""
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oriel.llm import spelling

UP = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return n


def brute(n, factor=5):
    """{word: (form, root, n, n_near, form_n)} by comparing all words with all."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, count = {}, {}
    for w in n:
        found = [x for x in n if near(w, x)]
        count[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = set()
    for _ in range(40):   # few letters, so runs of one letter, ties and chains are common
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(1, 9)))
        words |= {w, w + rng.choice("ab"), w[1:] + "a"}
    n = {w: 5 ** rng.randint(0, 6) + rng.randint(0, 1) for w in words if w}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.variants(df)) == brute(n)


def test_long_chain_of_forms(spark):
    n = {"x" * (k + 1): 5 ** k for k in range(12)}
    out = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == brute(n) and out["x"][1] == "x" * 12


def test_word_counts_damage_some_runs(spark, docs):
    rows = [(i, f"Grundstück GRUNDSTÜCK {w} {w.upper()} 9{w}9") for i, w in enumerate(["letters", "colour", "Éléphant", "ab"] * 30)]
    rows += [(5, rows[5][1])] * 2
    df = spelling.word_counts(docs(rows), damage_every=7, min_count=1)
    want = {w: c for w, c in counted(rows, 7).items() if len(w) >= 6}
    assert {r["word"]: r["n"] for r in df.collect()} == want


def test_query_equals_brute_force_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute({w: c for w, c in counted(rows).items() if len(w) >= 6 and c >= 5})
    assert got(spelling.op13_spelling(spark, sf)) == want


def test_defined_cases(spark, docs):
    long = "w" * 30000
    d = docs([(None, None), (1, ""), (2, "12 ...")] + [(None, "variant")] * 5 + [(3, "variant " * 30), (4, (long + " ") * 6)])
    d = d.select("*", F.lit(1).alias("word"), F.lit(2).alias("n"), F.lit("k").alias("key"))
    out = got(spelling.variants(spelling.word_counts(d)))
    assert out["variant"] == (None, "variant", 35, 0, None) and out[long][2] == 6 and len(out) == 2
    assert got(spelling.variants(spelling.word_counts(d.where("false")))) == {}
