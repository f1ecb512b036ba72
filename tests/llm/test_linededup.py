import duckdb

from oriel.llm import linededup


def brute(rows, sites):
    spread, first = {}, {}
    for i, t, _, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            k = line.strip(" ")
            if k:
                spread.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, t, _, s in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if not (x.strip(" ") and len(spread[x.strip(" ")]) >= sites and first[x.strip(" ")] != (i, p))]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


def test_against_brute_force(spark, docs):
    rows = [(i, f"head line\nown {i}\n\nshared by {i % 7}\n  head line ", "en", f"s{i % 6}") for i in range(40)]
    rows += [(90, None, "en", "s1"), (91, "", "en", None), (92, "head line", "en", None), (93, "x\n" * 3000 + "head line", "en", "s9")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linededup.remove_boilerplate(docs(rows)).collect())
    assert got == sorted(brute(rows, linededup.MIN_SITES))


def test_near_and_far_from_the_threshold(spark, docs):
    rows = [(i, f"wide {j}", "en", f"site{i}") for j, n in enumerate((3, 4, 5, 6, 7, 300)) for i in range(n)]
    rows = [(1000 * k + i, *r[1:]) for k, (i, r) in enumerate(zip(range(len(rows)), rows))]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.remove_boilerplate(docs(rows)).collect()}
    assert got == {i: n for i, _, n, _ in brute(rows, linededup.MIN_SITES)}


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(linededup.OP4_SQL).fetchall())
    got = linededup.op4_line_dedup(spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_empty_and_repeated_and_clashing(spark, docs):
    assert linededup.remove_boilerplate(docs([])).count() == 0
    rows = [(1, "a line", "en", "s1")] * 2 + [(i, "a line", "en", f"s{i}") for i in range(2, 7)]
    got = linededup.remove_boilerplate(docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0)] + [(i, 1) for i in range(2, 7)]
    odd = spark.createDataFrame([(1, "x", "s", 5, 6)], "did long, text string, source string, lines long, gone long")
    assert linededup.remove_boilerplate(odd, "did").first().asDict() == {
        "did": 1, "text": "x", "source": "s", "lines": 5, "gone": 6, "n_lines": 1, "n_removed": 0}
    null_id = docs([(None, "z line", "en", f"s{i}") for i in range(6)])
    assert sum(r["n_removed"] for r in linededup.remove_boilerplate(null_id).collect()) == 0
