import numpy as np

from oriel.llm import langid

EN = "the cat and the dog went over there with some other people when it was raining"
DE = "der hund und die katze gingen ueber die strasse weil es nicht mehr regnen wollte"


def _rows():
    rng = np.random.default_rng(2)
    make = lambda s: " ".join(rng.choice(s.split(), 12))
    return [(i, make(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(80)]


def test_held_out_accuracy_on_the_tables(spark, sf):
    got = langid.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_filters_hold_every_kept_ngram_and_rates_are_corrected(spark, docs):
    f = langid.train(docs(_rows()))
    assert f.langs == ["de", "en"] and f.table.shape[:2] == (1, langid.K)
    assert f.predict(EN)[0] == "en" and f.predict(DE)[0] == "de"
    # a filter in which every slot is set says nothing
    full = langid.Filters(["de", "en"], f.table | 1, np.array([1.0, f.false[1]]), f.letters)
    assert full.predict(EN)[0] == "en"


def test_false_positive_rate_is_measured_well(spark, docs):
    """Hits of random n-grams come at about the rate that the fill predicts."""
    f = langid.train(docs(_rows()))
    h = np.random.default_rng(0).integers(0, 2 ** 63, 200_000).astype(np.uint64) * np.uint64(2)
    at = langid.slot_numbers(h, f.table.shape[2])
    mask = f.table[0, 0][at[0]] & f.table[0, 1][at[1]]
    for i in range(2):
        assert abs(np.mean((mask >> i) & 1) - f.false[i]) < 0.002


def test_defined_cases(spark, docs):
    f = langid.train(docs(_rows() + [(500, "no label", None), (501, None, "en"), (502, "", "fr")]))
    rows = [(1, None), (2, ""), (3, "12 345 !!"), (4, "x"), (5, EN), (5, EN), (None, DE), (7, EN * 2000)]
    got = langid.predict(docs(rows), f).collect()
    by = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert len(got) == len(rows)
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en"), (None, "de"), (7, "en")} <= set(by)
    assert langid.predict(docs([]), f).count() == 0
    none = langid.train(docs([(1, EN, None)]))
    assert [r["lang_pred"] for r in langid.predict(docs([(1, EN)]), none).collect()] == ["und"]
    odd = spark.createDataFrame([(1, EN, "r", 3.0)], "l long, text string, row string, score double")
    r = langid.predict(odd, f).first()
    assert r["l"] == 1 and r["row"] == "r" and r["lang_pred"] == "en"


def test_many_languages_take_several_masks(spark, docs):
    rng = np.random.default_rng(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03d}": ["".join(rng.choice(list(letters), 6)) for _ in range(12)] for i in range(70)}
    rows = [(i * 10 + j, " ".join(rng.choice(w, 30)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(2)]
    f = langid.train(docs(rows))
    assert f.table.shape[0] == 2
    assert all(f.predict(" ".join(w))[0] == lang for lang, w in words.items())
