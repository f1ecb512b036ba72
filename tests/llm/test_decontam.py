import random

from oriel.llm import decontam


def brute(index, texts):
    """Every passage against every item."""
    out = []
    for t in texts:
        codes = [index.vocab.get(w, -1) for w in decontam.words_of(t)]
        span, best = index.longest, {}
        for lo in range(0, max(1, len(codes) - span), span):
            passage = codes[lo:lo + 2 * span]
            for i, (item_id, _, _) in enumerate(index.items):
                q, a = index.check(i, passage)
                if q >= index.overlap and a >= index.overlap:
                    best[item_id] = max(best.get(item_id, (0, 0)), (q, a))
        out.append(sorted((i, *x) for i, x in best.items()))
    return out


def _corpus(seed=3, items=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    its = [(i, " ".join(draw(rng.randint(2, 40))), " ".join(draw(rng.randint(0, 12)))) for i in range(items)]
    texts = []
    for _ in range(80):
        words = draw(rng.randint(0, 400))
        for _ in range(rng.randint(0, 2)):
            _, q, a = rng.choice(its)
            own = (q + " " + a).split()
            if rng.random() < 0.5 and len(own) > 12:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append(" ".join(words))
    return its, texts


def test_search_finds_what_brute_force_finds():
    its, texts = _corpus()
    index = decontam.Index(its)
    got = [[(m[0], m[2], m[3]) for m in found] for found in index.search(texts)]
    want = brute(index, texts)
    assert sum(map(len, want)) > 40
    assert [{m[0] for m in g} for g in got] == [{m[0] for m in w} for w in want]


def test_block_max_wand_equals_full_scoring():
    its, texts = _corpus(seed=5)
    index = decontam.Index(its)
    for t in texts:
        terms = {index.vocab[w] for w in decontam.words_of(t) if w in index.vocab}
        full = {}
        for term in terms:
            for i, x in index.postings[term]:
                full[i] = full.get(i, 0) + x
        assert {i for i, s in index.wand(terms)} == {i for i, s in full.items() if s >= 1 - 1e-9}


def test_rows_and_defined_cases(spark, docs, monkeypatch):
    q, a = "what is the tallest tower ever built in this old town", "it is the red one near the river bank"
    items = decontam.item_parts(spark.createDataFrame(
        [(1, q, a), (2, q, a), (3, None, None), (None, "short", "yes"), (5, "", "")], "item_id long, q string, a string"),
        question_col="q", answer_col="a")
    filler = "some other words that do not matter at all " * 60
    rows = [(1, f"{filler}{q}? {a}. {filler}"), (2, f"{filler}{q}. {filler}"), (3, None), (4, ""), (5, f"{q.upper()} {a.upper()}"),
            (5, f"{q.upper()} {a.upper()}"), (None, f"{q} {a}"), (7, filler * 30)]
    for limit in (decontam.MAX_INDEX_CHARS, 40):  # one index, or several shards
        monkeypatch.setattr(decontam, "MAX_INDEX_CHARS", limit)
        got = decontam.matches(docs(rows), items).collect()
        assert len(got) == len(rows)
        by = sorted((str(r["doc_id"]), tuple(sorted(str(m["item_id"]) for m in r["matches"]))) for r in got)
        assert by == sorted([("1", ("1", "2")), ("2", ()), ("3", ()), ("4", ()), ("5", ("1", "2")), ("5", ("1", "2")),
                             ("None", ("1", "2")), ("7", ())])
    assert decontam.matches(docs([]), items).count() == 0
    assert {len(r["matches"]) for r in decontam.matches(docs(rows), items.where("false")).collect()} == {0}
    odd = spark.createDataFrame([(1, f"{q} {a}", 4, 5)], "row long, text string, found long, matches long")
    r = decontam.matches(odd, items).first()
    assert r["row"] == 1 and r["found"] == 4 and len(r["matches"]) == 2


def test_planted_items_on_the_tables(spark, sf):
    """Every document that holds an item word for word is reported."""
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op5_decontam(spark, sf).collect()}
    norm = lambda t: f" {' '.join(decontam.words_of(t))} "
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert want and want <= got
    sets = {d: decontam.shingle_set(t.split()) for d, t in docs}
    for d, i in got - want:
        mine = decontam.shingle_set(dict(items)[i].split())
        assert len(mine & sets[d]) / len(mine) > 0.6


def plain_edits(part, codes):
    """Edit distance to the nearest run of words, by the full table."""
    row = [0] * (len(codes) + 1)
    for i, c in enumerate(part, 1):
        new = [i]
        for j, d in enumerate(codes, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edits_equal_the_full_table():
    rng = random.Random(7)
    for _ in range(300):
        part, codes = (tuple(rng.randrange(4) for _ in range(rng.randint(low, 12))) for low in (1, 0))
        assert decontam.edits(part, list(codes)) == plain_edits(part, codes)


def test_every_item_edited_once_is_found(spark, sf):
    """Every word of every item changed, left out or doubled: found; documents without test items: not."""
    rng = random.Random(2)
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.Index([(i, *decontam.split_item(t), True) for i, t in rows])
    vocab = sorted(index.vocab)
    clean = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 400))) for _ in range(200)]
    assert not any(index.search(clean))
    around = [f"before {' '.join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))}" for _ in range(20)]
    cases = []
    for i, t in rows:
        w = decontam.words_of(t)
        for k in range(len(w)):
            for new in ([], ["changed"], [w[k], "added"]):
                cases.append((i, " ".join([rng.choice(around), *w[:k], *new, *w[k + 1:], rng.choice(around)])))
    found = index.search([t for _, t in cases])
    assert len(cases) > 1000
    assert not [c for c, f in zip(cases, found, strict=True) if c[0] not in {m[0] for m in f}]
    sample = rng.sample(range(len(cases)), 100)
    for k, want in zip(sample, brute(index, [cases[k][1] for k in sample]), strict=True):
        assert {m[0] for m in found[k]} == {m[0] for m in want}


def test_short_answers_and_other_answers():
    q, a = "what is the tallest tower ever built in this old town", "it is the red one near the river bank"
    index = decontam.Index([(1, q, a), (2, q, "yes")])
    hits = lambda t: [m[0] for m in index.search([t])[0]]
    assert hits(f"{q} {a.replace('river', 'harbour')}") == [1]
    assert hits(f"{q.replace('built', 'seen')} {a.replace('red ', '')}") == [1]
    assert hits(f"{q} no") == [] and hits(f"{q} yes") == [2]
    assert hits(f"{q} it was a blue thing by some lake") == []


def test_grown_copies_of_the_longest_item_anywhere():
    """A copy with the granted insertions is found wherever the windows fall."""
    q = [f"w{i}" for i in range(40)]
    for a in ([], [f"a{i}" for i in range(20)]):
        index = decontam.Index([(1, " ".join(q), " ".join(a))])
        grown = lambda part: [x for i, w in enumerate(part) for x in ((w, "new") if i % 10 == 4 else (w,))]
        copy = grown(q) + grown(a)
        assert len(copy) == index.longest + index.room
        texts = [" ".join(["x"] * before + copy + ["x"] * 300) for before in range(3 * index.longest)]
        assert [[m[0] for m in f] for f in index.search(texts)] == [[1]] * len(texts)
