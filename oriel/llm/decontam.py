"""Benchmark decontamination: BM25 search with block-max WAND.

The index holds the test items: per term a posting list in item order, cut
into blocks of ``BLOCK`` items with the largest impact of each block.  Every
training passage is a query against it: a window every L words, L the longest
item, of 2L words and the most insertions granted to an item, so that every
copy lies wholly in a window, however it was edited within the rule below.

A part (question or answer) is in a passage if at least ``overlap`` of its
five-word shingles are, or if its words are there in order with at most
``granted`` words changed, left out or put in.  An item is confirmed if both
parts are.  Where the item has one text only, its cut into parts means nothing,
so it is also confirmed if the whole text passes as one part.

Impacts are scaled so that an item qualifies at a sum of 1.  An item's scale
is its BM25 score for itself, less what passing that check could lack: by
either rule at most a known number of words can be missing, and the largest
impacts of that many words are granted.  So the search loses nothing that the
check would confirm.

All passages of a batch are first bounded together: for every block of items
the block maxima of the passage's rare terms, plus the most that the common
terms can add to an item of the block.  Passages with a block that can reach 1
go through the block-max WAND loop, which returns every item with a sum of at
least 1.  The check then compares them with the passage.

The index is bounded (``MAX_INDEX_CHARS`` of item text).  More items are dealt
into shards by a hash of the item, each shard searched in the same way.

Defined cases: very long texts are searched whole, in overlapping windows; null
or empty texts contain nothing; items without words match
nothing; rows of equal items all match; a question or answer of fewer than five
words is one shingle and granted no edit, a missing answer is taken as contained; null ids pass
through; repeated documents match alike; other columns pass through, whatever
their names; empty tables give no match.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import giving_back, read_table

WORD = re.compile(r"\w+")
SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 8
RARE_SHARE = 0.6
MAX_INDEX_CHARS = 32_000_000
MAX_WORDS_AT_ONCE = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that has one text only: the first two
    thirds of its words and the rest."""
    spans = [m.start() for m in WORD.finditer(text or "")]
    if len(spans) < 3:
        return text or "", ""
    cut = spans[-(-2 * len(spans) // 3)]
    return text[:cut], text[cut:]


def shingle_set(words: list, size: int = SHINGLE) -> set:
    n = min(size, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def granted(n: int) -> int:
    """Words of n that may be changed, left out or put in: a tenth, and one
    from the length of a shingle on."""
    return max(1, n // 10) if n >= SHINGLE else 0


def edits(part: tuple, codes: list[int]) -> int:
    """Least number of words to change, leave out or put in to make the part a
    run of ``codes`` (bit-parallel, a column of the table per word)."""
    at: dict[int, int] = {}
    for i, c in enumerate(part):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(part)) - 1, 1 << len(part) - 1
    up, down, now = full, 0, len(part)
    best = now
    for c in codes:
        eq = at.get(c, 0)
        x = eq | down
        y = ((eq & up) + up ^ up) | eq
        p, m = down | ~(y | up) & full, up & y
        now += bool(p & top) - bool(m & top)
        p, m = p << 1 & full, m << 1 & full
        up, down = m | ~(x | p) & full, p & x
        best = min(best, now)
    return best


class Index:
    """Block-max inverted index of (item_id, question, answer) rows; a true
    fourth field marks the cut of one text."""

    def __init__(self, items, overlap: float = OVERLAP):
        rows = []
        for item_id, question, answer, *one_text in items:
            q, a = words_of(question), words_of(answer)
            if q or a:
                rows.append((item_id, q, a, any(one_text)))
        # neighbours in item order share blocks: like lengths give tight block maxima
        rows.sort(key=lambda x: (len(x[1]) + len(x[2]), x[1], x[2], str(x[0])))
        self.items = [x[:3] for x in rows]
        self.one_text = [x[3] for x in rows]
        self.overlap = overlap
        n = len(self.items)
        df = Counter(t for _, q, a in self.items for t in {*q, *a})
        self.vocab = {t: i for i, t in enumerate(sorted(df))}
        self.longest = max((len(q) + len(a) for _, q, a in self.items), default=1)
        # insertions granted to an item: of its parts, or of the whole if that is more
        self.room = max((max(granted(len(q)) + granted(len(a)), granted(len(q) + len(a))) for _, q, a in self.items), default=0)
        mean = sum(len(q) + len(a) for _, q, a in self.items) / max(1, n)
        postings = defaultdict(list)  # term -> [(item, impact)]
        self.common = np.zeros(n)  # most that an item's common terms add
        rare = defaultdict(list)
        self.parts = []
        for i, (_, q, a) in enumerate(self.items):
            tf = Counter(q + a)
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1)
                   / (c + K1 * (1 - B + B * (len(q) + len(a)) / mean)) for t, c in tf.items()}
            lack = self._lack(q) + self._lack(a)
            if self.one_text[i]:
                lack = max(lack, self._lack(q + a))
            need = sum(raw.values()) - sum(sorted(raw.values())[len(raw) - min(lack, len(raw)):])
            need = max(need * (1 - 1e-9), 1e-9)
            self.parts.append([tuple(self.vocab[t] for t in p) for p in (q, a)])
            took = 0.0
            for t in sorted(raw, key=lambda t: (-raw[t], t)):
                postings[self.vocab[t]].append((i, raw[t] / need))
                if took < RARE_SHARE * need:
                    rare[self.vocab[t]].append((i // BLOCK, raw[t] / need))
                else:
                    self.common[i] += raw[t] / need
                took += raw[t]
        self.postings = {t: sorted(p) for t, p in postings.items()}
        self.most = {t: max(x for _, x in p) for t, p in self.postings.items()}
        self.block_most = {}
        for t, p in self.postings.items():
            best: dict[int, float] = {}
            for i, x in p:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), x)
            self.block_most[t] = best
        self.blocks = (n - 1) // BLOCK + 1 if n else 0
        self.block_common = np.array([self.common[b * BLOCK:(b + 1) * BLOCK].max() for b in range(self.blocks)])
        # rare terms' block maxima as flat lists, for bounding many passages at once
        first, at, val = [0], [], []
        for t in range(len(self.vocab)):
            best = {}
            for b, x in rare.get(t, ()):
                best[b] = max(best.get(b, 0.0), x)
            at += list(best)
            val += list(best.values())
            first.append(len(at))
        self.rare_first, self.rare_block, self.rare_value = np.array(first), np.array(at, np.int64), np.array(val)

    def _lack(self, part: list) -> int:
        """Most distinct words that a passage holding the part can lack."""
        return max(int((1 - self.overlap) * len(shingle_set(part)) + 1e-9), granted(len(part)))

    def wand(self, terms) -> list[tuple[int, float]]:
        """Items whose impacts over ``terms`` sum to at least 1."""
        found = []
        cursors = [[p[0][0], 0, p, self.most[t], self.block_most[t]] for t in terms if (p := self.postings.get(t))]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for j, c in enumerate(cursors):
                bound += c[3]
                if bound >= 1 - 1e-9:
                    pivot = j
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(c[4].get(block, 0.0) for c in cursors[:pivot + 1]) < 1 - 1e-9:
                # no item of this block, up to the next cursor, can qualify
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
                move = cursors[:pivot + 1]
            elif cursors[0][0] == item:
                score = sum(c[2][c[1]][1] for c in cursors[:pivot + 1])
                if score >= 1 - 1e-9:
                    found.append((item, score))
                target, move = item + 1, cursors[:pivot + 1]
            else:
                target, move = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in move:
                if c[0] < target:
                    c[1] = bisect.bisect_left(c[2], (target,), c[1])
                    c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def check(self, item: int, codes: list[int]) -> tuple[float, float]:
        """Shares of the question and the answer in the passage: of shingles
        or, with no more edits than granted, of words.  The whole of one text
        counts for both if it passes.  Confirmed if both reach ``overlap``."""
        have: dict[int, set] = {}
        words = set(codes)

        def share(part: tuple) -> float:
            if not part:
                return 1.0
            n = min(SHINGLE, len(part))
            if n not in have:
                have[n] = shingle_set(codes, n) if len(codes) >= n else set()
            mine = shingle_set(part, n)
            got = len(mine & have[n]) / len(mine)
            if got < 1 and (most := granted(len(part))) and len({*part} - words) <= most and (e := edits(part, codes)) <= most:
                got = max(got, 1 - e / len(part))
            return got

        q, a = self.parts[item]
        shares = share(q), share(a)
        if self.one_text[item] and min(shares) < self.overlap and (whole := share(q + a)) >= self.overlap:
            shares = max(shares[0], whole), max(shares[1], whole)
        return shares

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text, confirmed matches (item_id, score, question share, answer share)."""
        span = max(1, self.longest)
        get = self.vocab.get
        codes = [np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for w in map(words_of, texts)]
        lens = np.array([len(c) for c in codes], np.int64)
        wins = np.maximum(1, -(-lens // span) - 1)
        base = np.cumsum(wins) - wins
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.blocks or not lens.sum():
            return out
        flat = np.concatenate(codes)
        doc = np.repeat(np.arange(len(codes)), lens)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        known = flat >= 0
        flat, doc, pos = flat[known], doc[known], pos[known]
        count = self.rare_first[flat + 1] - self.rare_first[flat]
        hit = count > 0
        flat, doc, pos, count = flat[hit], doc[hit], pos[hit], count[hit]
        at = np.repeat(self.rare_first[flat] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        block, value = self.rare_block[at], self.rare_value[at]
        doc, pos = np.repeat(doc, count), np.repeat(pos, count)
        keys, values = [], []
        for back in range(-(-(2 * span + self.room) // span)):  # a word lies in the window that begins in its step and in those before
            w = pos // span - back
            ok = (w >= 0) & (w < wins[doc]) & (pos < w * span + 2 * span + self.room)
            keys.append((base[doc[ok]] + w[ok]) * self.blocks + block[ok])
            values.append(value[ok])
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        bound = np.add.reduceat(value, start) if len(start) else np.zeros(0)
        key = key[start] if len(start) else key
        for w in np.unique(key[bound + self.block_common[key % self.blocks] >= 1 - 1e-6] // self.blocks).tolist():
            d = int(np.searchsorted(base, w, "right")) - 1
            lo = (w - int(base[d])) * span
            passage = codes[d][lo:lo + 2 * span + self.room].tolist()
            for item, score in self.wand({c for c in passage if c >= 0}):
                q, a = self.check(item, passage)
                if q >= self.overlap and a >= self.overlap:
                    out[d].append((self.items[item][0], score, q, a))
        for d, found in enumerate(out):
            best: dict = {}
            for m in found:
                if m[0] not in best or m[1:] > best[m[0]][1:]:
                    best[m[0]] = m
            out[d] = sorted(best.values(), key=lambda m: (m[0] is None, m[0] or 0))
        return out


MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
                                  T.StructField("question_share", T.DoubleType()), T.StructField("answer_share", T.DoubleType())]))


def item_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None,
               answer_col: str | None = None) -> DataFrame:
    """Rows (item_id, question, answer, text); text only where no question column is named."""
    col = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    return benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), col(question_col).alias("question"),
                            col(answer_col).alias("answer"), (F.lit(None).cast("string") if question_col else col(text_col)).alias("text"))


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str = "matches",
            overlap: float = OVERLAP) -> DataFrame:
    """All columns of ``docs`` plus ``out``: the confirmed test items, an array
    of (item_id, score, question_share, answer_share)."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.length(F.concat_ws(" ", "question", "answer", "text")))).first()[0] or 0
    shards = max(1, math.ceil(size / MAX_INDEX_CHARS))
    numbered = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "question", "answer", "text"), F.lit(shards)))
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.array().cast(MATCH).alias("found"))
    for s in range(shards):
        rows = numbered.where(F.col("shard") == s).collect()  # bounded by MAX_INDEX_CHARS
        index = spark.sparkContext.broadcast(Index(
            [(r["item_id"], *((r["question"], r["answer"]) if r["text"] is None else split_item(r["text"])), r["text"] is not None) for r in rows], overlap))
        src = row.select("row", "found", F.col("row").getField(text_col).alias("text"))
        row = src.mapInArrow(_searcher(index), T.StructType([row.schema["row"], T.StructField("found", MATCH)]))
    return row.select(*[F.col("row").getField(c).alias(c) for c in cols if c != out], F.col("found").alias(out))


def _searcher(index):
    def run(batches):
        for b in batches:
            lo = 0
            while lo < len(b):
                texts, n = [], 0
                while lo + len(texts) < len(b) and (not texts or n < MAX_WORDS_AT_ONCE):
                    texts.append(b.column(2)[lo + len(texts)].as_py())
                    n += len(texts[-1] or "") // 5
                part = b.slice(lo, len(texts))
                got = [before + [dict(zip(("item_id", "score", "question_share", "answer_share"), m, strict=True)) for m in new]
                       for before, new in zip(part.column(1).to_pylist(), index.value.search(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, b.schema.field(1).type)], names=["row", "found"])
                lo += len(texts)

    return giving_back(run)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, item_parts(read_table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
