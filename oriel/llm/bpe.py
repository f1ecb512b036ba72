"""Byte-level BPE encoding and decoding over a distinct-word shuffle.

Encoding never runs the merges per occurrence:

1. Documents are cut into pre-tokens.  A block (consecutive documents of one
   task, bounded by ``block_chars``) numbers its distinct words; every
   document keeps the word number at each position.  One shuffle deals both:
   the positions by block, the block's distinct words by a hash of the word.
2. All copies of a word meet in one task, which runs the merges on it once and
   answers every block.
3. The ids go back to their block and every document is reassembled by
   position, in the tasks where the positions already are (the plan reuses the
   first shuffle).

A frequent word crosses the shuffle once per block, not once per occurrence,
so no key is hot.  Memory is bounded by a block, or by the distinct words of a
task.  A single document longer than ``block_chars`` is a block of its own.
The input has to yield the same rows in the same order when it is read again,
as a table scan does: a lost task is then redone with the same numbers.

Decoding joins the (bounded, checked) token-byte table on the map side.

Defined cases: a null text counts as empty (no ids, empty bytes); repeated
rows stay repeated; all other columns, whatever their names, pass through
inside one struct; an empty table gives an empty table; an id that the table
lacks makes the decoded value null.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import give_back, giving_back, shuffle_partitions

BLOCK_CHARS = 12_000_000
#: Ids that are decoded at once (a longer document alone).
CHUNK_IDS = 500_000
#: Vocabularies above this size are refused for the map-side join.
MAX_VOCAB = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 token, rank) of a public tokenizer."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
    if len(ranks) > MAX_VOCAB:
        raise ValueError(f"{len(ranks)} ranks are more than {MAX_VOCAB}")
    return ranks


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _planes(a: np.ndarray) -> bytes:
    """uint32 values as four byte planes, compressed."""
    b = np.ascontiguousarray(a, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(b.T).tobytes())


def _unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def _pretokenizer(pattern: str, parts: int, block_chars: int):
    """mapInArrow body of step 1."""

    def run(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task = TaskContext.get().partitionId()
        seq = itertools.count()

        def flush(rows, number):
            carry_type = rows[0][0].type
            block = f"{task}-{next(seq)}"
            words = list(number)
            codes = [c for _, c in rows]
            counts = np.zeros(len(words), np.int64)
            for c in codes:
                seen, n = np.unique(c, return_counts=True)
                counts[seen] += n
            # small numbers for frequent words: the byte planes compress better
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            by_part = defaultdict(list)
            for r, i in enumerate(order.tolist()):
                by_part[zlib.crc32(words[i].encode()) % parts].append(r)
            for lo in range(0, len(rows), 2000):
                some = rows[lo:lo + 2000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * n, pa.string()), pa.nulls(n, pa.string()), pa.concat_arrays([c for c, _ in some]),
                    pa.array([_planes(rank[c]) for _, c in some], pa.binary()), pa.nulls(n, pa.binary())], names=NAMES)
            zc = zstandard.ZstdCompressor(level=6)
            out = defaultdict(list)
            for part in sorted(by_part):
                own = sorted((words[order[r]].encode(), r) for r in by_part.pop(part))
                lens = np.array([len(w) for w, _ in own], dtype="<u4")
                out["target"].append(f"part {part}")
                out["codes"].append(_planes(np.array([r for _, r in own], dtype="<u4")))
                out["words"].append(zc.compress(len(own).to_bytes(4, "little") + lens.tobytes()
                                                + b"".join(w for w, _ in own)))
            if out:
                n = len(out["target"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["target"], pa.string()), pa.array([block] * n, pa.string()), pa.nulls(n, carry_type),
                    pa.array(out["codes"], pa.binary()), pa.array(out["words"], pa.binary())], names=NAMES)

        def fresh():
            return [], defaultdict(itertools.count().__next__), 0

        rows, number, chars = fresh()
        for batch in batches:
            carry = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if chars and chars + len(text) > block_chars:
                    yield from flush(rows, number)
                    rows, number, chars = fresh()
                code = np.fromiter(map(number.__getitem__, find(text)), dtype=np.uint32)
                rows.append((carry.slice(i, 1), code))
                chars += len(text)
        if rows:
            yield from flush(rows, number)

    return giving_back(run)


#: target: a block (positions) or a part (words, with the block they answer to)
NAMES = ["target", "block", "carry", "codes", "words"]


def _merger(ranks_b, pattern: str):
    """mapInArrow body of step 2: each distinct word of the task is encoded once."""

    def run(batches):
        encode = _encoding(ranks_b.value, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            ids_out, n_out = [], []
            batch = batch.filter(batch.column(4).is_valid())
            for blob in batch.column(4):
                raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
                n = int.from_bytes(raw[:4], "little")
                ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
                at, base, flat, counts = 0, 4 + 4 * n, [], []
                for end in ends:
                    w = raw[base + at:base + end]
                    at = end
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode(w)
                    flat.extend(ids)
                    counts.append(len(ids))
                ids_out.append(_planes(np.array(flat, dtype="<u4")))
                n_out.append(_planes(np.array(counts, dtype="<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(3), pa.array(n_out, pa.binary()), pa.array(ids_out, pa.binary())],
                names=["target", "codes", "counts", "ids"])

    return giving_back(run)


def _reassemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Cogroup body of step 3: one block's documents and the ids of its words
    (of a part, nothing)."""
    docs = docs.filter(docs["words"].is_null())
    number, counts, ids = ([np.zeros(0, np.uint32)] for _ in range(3))
    for c, n, i in zip(words["codes"], words["counts"], words["ids"], strict=True):
        number.append(_unplanes(c.as_py()))
        counts.append(_unplanes(n.as_py()))
        ids.append(_unplanes(i.as_py()))
    number, counts, ids = (np.concatenate(x).astype(np.int64) for x in (number, counts, ids))
    size = int(number.max()) + 1 if len(number) else 0
    length, start = np.zeros(size, np.int64), np.zeros(size, np.int64)
    length[number] = counts
    start[number] = np.cumsum(counts) - counts
    ids = ids.astype(np.int32)
    values, offsets = [], [0]
    for c in docs["codes"]:
        code = _unplanes(c.as_py())
        n = length[code]
        total = int(n.sum())
        first = np.repeat(start[code] - (np.cumsum(n) - n), n)
        values.append(ids[first + np.arange(total)])
        offsets.append(offsets[-1] + total)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    carry = docs["carry"].combine_chunks()
    if isinstance(carry, pa.ChunkedArray):
        carry = pa.concat_arrays(carry.chunks)
    return pa.Table.from_arrays([carry, lists], names=["carry", "ids"])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids",
           parts: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``df`` but the text, plus ``out`` (array<int>): the token
    ids of the whole text, each match of ``pattern`` encoded separately."""
    spark = df.sparkSession
    parts = parts or 4 * shuffle_partitions(spark)
    others = [c for c in df.columns if c != text_col]
    carry = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    src = df.select(carry.alias("carry"), F.col(f"`{text_col}`").alias("text"))
    carry_type = src.schema["carry"].dataType
    wide = T.StructType([T.StructField("target", T.StringType()), T.StructField("block", T.StringType()),
                         T.StructField("carry", carry_type), T.StructField("codes", T.BinaryType()),
                         T.StructField("words", T.BinaryType())])
    dealt = (src.mapInArrow(_pretokenizer(pattern, parts, block_chars), wide)
             .repartition(shuffle_partitions(spark), "target"))
    ranks_b = spark.sparkContext.broadcast(ranks)
    back = dealt.mapInArrow(_merger(ranks_b, pattern), "target string, codes binary, counts binary, ids binary")
    result = T.StructType([T.StructField("carry", carry_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        done = _reassemble(left, right)
        if len(done):  # a block
            give_back()
        return done

    joined = dealt.groupBy("target").cogroup(back.groupBy("target")).applyInArrow(whole, result)
    return joined.select(*[F.col("carry").getField(c).alias(c) for c in others], F.col("ids").alias(out))


def decoder(table: dict[int, bytes], at: int):
    """mapInArrow body: rows whose field ``at`` holds the ids, with their bytes."""

    def run(batches):
        for batch in batches:
            row, lo = batch.column(0), 0
            lists = row.field(at)
            while lo < len(batch):
                got, n = [], 0
                while lo + len(got) < len(batch) and (not got or n < CHUNK_IDS):
                    ids = lists[lo + len(got)]
                    try:
                        got.append(b"".join([table[i] for i in ids.values.to_numpy().tolist()]) if ids.is_valid else None)
                    except KeyError:
                        got.append(None)
                    n += len(ids.values) if ids.is_valid else 0
                yield pa.RecordBatch.from_arrays([row.slice(lo, len(got)), pa.array(got, pa.binary())], names=["row", "out"])
                lo += len(got)

    return run


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` plus ``out`` (binary): the token bytes of the ids,
    joined on the map side with the token-byte table."""
    spark = df.sparkSession
    token_bytes = spark.sparkContext.broadcast({i: b for b, i in ranks.items()})
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([src.schema["row"], T.StructField("out", T.BinaryType())])
    at = df.columns.index(ids_col)

    def run(batches):
        yield from decoder(token_bytes.value, at)(batches)

    decoded = src.mapInArrow(giving_back(run), schema)
    return decoded.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("out").alias(out))


def digest(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256, decoded_sha256."""
    return [F.size(ids_col).cast("long").alias("n_tokens"),
            F.sha2(F.concat_ws(",", F.col(ids_col).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col(bytes_col), 256).alias("decoded_sha256")]


def default_ranks(spark: SparkSession | None = None, file: str = "byte_bpe_multi_50k.tiktoken"):
    """Ranks and pattern of the installed public tokenizer files."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(file)), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from oriel.llm.common import read_table

    ranks, pattern = default_ranks()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, ranks, pattern)
    full = decode(ids, ranks)
    return full.select("doc_id", *digest(full))
