import hashlib

import pyarrow as pa
import pytest
import tiktoken

from oriel.llm import bpe

RANKS, PATTERN = bpe.default_ranks()


def whole(text):
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return enc.encode_ordinary(text or "")


TEXTS = [None, "", " ", "the the the", "Ünïcödé çéà 日本語 🎉🎉  \n\n\t x", "don't I'll 's 12345 ___ !!",
         "a" * 5000, "\x1c\x1d\x85　 mixed space", "word " * 3000, "the the the"]


def test_equals_the_library_and_round_trips(spark, docs):
    df = docs(list(enumerate(TEXTS)))
    got = bpe.decode(bpe.encode(df, RANKS, PATTERN, parts=3, block_chars=40), RANKS)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(TEXTS) and "text" not in got.columns and "lang" in got.columns
    for i, t in enumerate(TEXTS):
        assert rows[i]["ids"] == whole(t)
        assert bytes(rows[i]["decoded"]) == (t or "").encode()


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x y", "b", 1.5), (1, "x y", "b", 1.5), (None, "z", None, None)],
                               "target long, text string, block string, carry double")
    got = bpe.encode(df, RANKS, PATTERN)
    assert sorted(map(str, got.columns)) == ["block", "carry", "ids", "target"]
    assert sorted((str(r["target"]), tuple(r["ids"])) for r in got.collect()) == sorted(
        [("1", tuple(whole("x y")))] * 2 + [("None", tuple(whole("z")))])


def test_unknown_id_and_empty_table(spark, docs):
    bad = spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>")
    assert bpe.decode(bad, RANKS).first()["decoded"] is None
    assert bpe.encode(docs([]), RANKS, PATTERN).count() == 0


def test_query(spark, docs, table_dir):
    d = table_dir(documents=docs([(1, "alpha beta"), (2, None)]))
    rows = {r["doc_id"]: r for r in bpe.op1_bpe(spark, d).collect()}
    ids = whole("alpha beta")
    assert rows[1]["n_tokens"] == len(ids)
    assert rows[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[1]["decoded_sha256"] == hashlib.sha256(b"alpha beta").hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_ranks_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "MAX_VOCAB", 10)
    with pytest.raises(ValueError):
        bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_decoding_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_IDS", 3)
    rows = [(1, whole("alpha beta gamma delta")), (2, None), (3, []), (4, [99_999_999]), (5, whole("x y")), (5, whole("x y")), (None, whole("é"))]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    got = [(r["doc_id"], r["ids"], None if r["decoded"] is None else bytes(r["decoded"])) for r in bpe.decode(df, RANKS).collect()]
    want = [b"alpha beta gamma delta", None, b"", None, b"x y", b"x y", "é".encode()]
    assert got == [(i, ids, w) for (i, ids), w in zip(rows, want, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([{"ids": i} for _, i in rows], pa.struct([("ids", pa.list_(pa.int32()))]))], names=["row"])
    parts = list(bpe.decoder({i: b for b, i in RANKS.items()}, 0)([batch]))
    assert len(parts) > 2 and [x for b in parts for x in b.column(1).to_pylist()] == want
