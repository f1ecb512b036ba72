"""Toxicity: support vector machine on a gap-weighted subsequence kernel, with
Nystroem landmarks.

The kernel of two strings sums, over all subsequences of three and four
characters that both hold, the product of ``DECAY ** span`` of their places;
spans are at most five and six characters, so letters may be left out or put
in between at a price.  Characters are lower-case; of the others only the one
right before a letter counts, as a word boundary.  Landmarks are word
beginnings of the labelled texts: those that are most over-represented in
toxic texts, and the most frequent of clean ones.  With the landmarks' kernel
matrix K a string x has the coordinates ``K**-1/2 k(x, landmarks)``, on which a
linear SVM is fitted by dual coordinate descent.

A text is the bag of its windows of ``WINDOW`` characters.  A toxic text has at least one
toxic window, a clean one none: rounds alternate between choosing each toxic
text's best window and refitting; the windows on which clean texts score
highest are mined again after the first fit.  The margin of a text is the
largest margin of a window, a logistic curve over out-of-fold margins the score.

A fitted model is folded: sum_l a_l k(x, l) is a sum over subsequences of x
of fixed weights, so a text is scored in a few passes over its characters.

Fitting reads a bounded sample of the labelled texts: ``max_per_class`` of
either label, the smallest hashes of the id first, and of those beyond
``max_chars`` characters in all of a label the first ones that fit.  Scores cover every
whole text.

Defined cases: a null text counts as empty; an empty text has no window and
gets the score of the margin of an empty window; very long texts are scored
in blocks that overlap by a window and a span, with the same result; labels other than 0 and
1 are not used; of several labels for one id the largest counts; with no usable
label every score is 0.5, with one class only the score is that class;
repeated rows are scored alike; other columns pass through inside one struct
and ``out`` replaces a column of its name; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import crc_mod, hash_cut, id_hash, materialize, read_table

DECAY = 0.7
#: Offsets of a subsequence's later characters from its first one.
PATTERNS = [(0, *c) for n, far in ((2, 4), (3, 5)) for c in combinations(range(1, far + 1), n)]
SPAN = 6
WINDOW = 10
BOUNDARY = " "
SYMBOLS = 64
BLOCK = 1 << 18
MAX_PER_CLASS, MAX_CHARS = 1500, 24_000_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 96, 32
PREFIXES = (4, 5, 7, 9)
#: Rounds of mining and fitting.
ROUNDS = 4


@dataclass
class Alphabet:
    """Characters that count, as numbers 1..; all others are 0."""
    table: np.ndarray    # code point -> number

    @classmethod
    def of(cls, strings: list[str]) -> Alphabet:
        n = Counter(c for s in strings for c in s if c != BOUNDARY)
        chars = sorted(n, key=lambda c: (-n[c], c))[:SYMBOLS - 2]
        table = np.zeros(max([ord(BOUNDARY), *map(ord, chars)]) + 2, np.uint32)
        table[ord(BOUNDARY)] = 1
        for k, c in enumerate(chars):
            table[ord(c)] = k + 2
        return cls(table)

    def numbers(self, shown: np.ndarray) -> np.ndarray:
        return self.table[np.minimum(shown, len(self.table) - 1)]


def shown(text: str) -> np.ndarray:
    """Lower-case code points; other characters are 0, or the boundary if a letter follows."""
    low = " " + text.lower()
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    letter = is_letter(a)
    before = np.zeros(len(a), bool)
    before[:-1] = letter[1:]
    a[~letter] = np.where(before[~letter], ord(BOUNDARY), 0)
    return a


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)])


LETTERS = _letters()


def is_letter(a: np.ndarray) -> np.ndarray:
    """Letters below U+3000 by their Unicode class; all above count as letters
    but for punctuation blocks."""
    return np.where(a < 0x3000, LETTERS[np.minimum(a, 0x2FFF)], (a >= 0x3040) & ((a < 0xFE10) | (a > 0xFF0F)))


def subsequences(x: np.ndarray):
    """For each pattern its weight, its kind's offset and the code at each
    place (0: a character that does not count takes part)."""
    pad = np.concatenate([x.astype(np.int64), np.zeros(SPAN, np.int64)])
    n = len(x)
    for p in PATTERNS:
        code, real = np.zeros(n, np.int64), np.ones(n, bool)
        for o in p:
            c = pad[o:o + n]
            code = code * SYMBOLS + c
            real &= c > 0
        # four characters start with a number of at least 1, so codes of three are smaller
        yield DECAY ** (p[-1] + 1), np.where(real, code, 0)


def features(x: np.ndarray) -> dict[int, float]:
    """The subsequences of a short string of numbers, with their weights."""
    out: dict[int, float] = {}
    for weight, code in subsequences(x):
        for c in code[code > 0].tolist():
            out[c] = out.get(c, 0.0) + weight
    return out


class Kernel:
    """Kernel values between windows and normalised landmarks."""

    def __init__(self, landmarks: list[str]):
        self.alphabet = Alphabet.of(landmarks)
        rows = []
        for s in landmarks:
            f = features(self.alphabet.numbers(np.array([ord(c) for c in s], np.uint32)))
            norm = np.sqrt(sum(v * v for v in f.values()))
            rows.append({k: v / norm for k, v in f.items()} if norm else {})
        self.codes = np.array(sorted({c for r in rows for c in r}), np.int64)
        at = {c: i for i, c in enumerate(self.codes.tolist())}
        self.weights = np.zeros((len(self.codes) + 1, len(landmarks)))   # the last row: codes of no landmark
        for j, r in enumerate(rows):
            for c, v in r.items():
                self.weights[at[c], j] = v
        values, vectors = np.linalg.eigh(self.weights.T @ self.weights)
        keep = values > 1e-6 * max(values.max(initial=0.0), 1e-12)
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def index(self, code: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, code).clip(0, max(len(self.codes) - 1, 0))
        return np.where(self.codes[at] == code, at, len(self.codes)) if len(self.codes) else np.zeros(len(code), np.int64)

    def coordinates(self, x: np.ndarray, starts: list[int]) -> np.ndarray:
        """Nystroem coordinates of the windows of ``x`` that begin at ``starts``.
        Only the surroundings of each window are looked at."""
        step = WINDOW + SPAN
        cut = np.zeros((len(starts), step + SPAN), x.dtype)
        for k, s in enumerate(starts):
            part = x[s:s + step]
            cut[k, :len(part)] = part
        out = np.zeros((len(starts), self.weights.shape[1]))
        for weight, code in subsequences(cut.ravel()):
            at = self.index(code).reshape(len(starts), -1)[:, :WINDOW]
            out += weight * self.weights[at].sum(axis=1)
        return out @ self.root

    def folded(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and weights of the linear form w . coordinates."""
        return self.codes, (self.weights[:-1] @ (self.root @ w)).astype(np.float32)


class Folded:
    """A linear form over subsequences, as tables by code."""

    def __init__(self, alphabet: Alphabet, codes: np.ndarray, weights: np.ndarray):
        self.alphabet, self.sparse, self.dense = alphabet, (codes, weights), None

    def __getstate__(self):
        return self.alphabet, self.sparse

    def __setstate__(self, state):
        self.alphabet, self.sparse = state
        self.dense = None

    def tables(self) -> dict[int, np.ndarray]:
        """Weights by code for three and for four characters; codes with a 0
        in any place weigh nothing in both."""
        if self.dense is None:
            codes, weights = self.sparse
            self.dense = {n: np.zeros(SYMBOLS ** n, np.float32) for n in (3, 4)}
            for n, mine in ((3, codes < SYMBOLS ** 3), (4, codes >= SYMBOLS ** 3)):
                self.dense[n][codes[mine]] = weights[mine]
        return self.dense

    def windows(self, text: str) -> np.ndarray:
        """The form's value on each window: element i belongs to the places
        i .. i + WINDOW - 1.  Long texts are done in overlapping blocks."""
        a = shown(text)
        parts = [self._block(self.alphabet.numbers(a[s:s + BLOCK + WINDOW + SPAN]), min(BLOCK, len(a) - s))
                 for s in range(0, len(a), BLOCK)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _block(self, x: np.ndarray, n: int) -> np.ndarray:
        tables, m = self.tables(), len(x)
        pad = np.concatenate([x, np.zeros(SPAN, np.uint32)])
        high = [pad * np.uint32(SYMBOLS ** k) for k in range(4)]
        total = np.zeros(m, np.float64)
        for p in PATTERNS:
            code = high[len(p) - 1][:m].copy()
            for k, o in enumerate(p[1:]):
                code += high[len(p) - 2 - k][o:o + m]
            total += tables[len(p)][code] * np.float32(DECAY ** (p[-1] + 1))
        sums = np.concatenate([[0.0], np.cumsum(total)])
        end = np.minimum(np.arange(n) + WINDOW, m)
        return sums[end] - sums[:n]


@dataclass
class Model:
    form: Folded | None
    bias: float = 0.0
    a: float = 0.0
    b: float = 0.0
    constant: float | None = None

    def margin(self, text: str | None) -> float:
        return (float(self.form.windows(text).max()) if text else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(text) + self.b, -30, 30))))


def svm(x: np.ndarray, y: np.ndarray, c: float = 5.0, epochs: int = 200, tol: float = 1e-2) -> tuple[np.ndarray, float]:
    """L1 hinge loss by dual coordinate descent.  An epoch visits the examples that violate their optimality
    condition by more than ``tol``; when none does, the fit is done."""
    upper = np.full(len(y), c)
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    diag = np.square(x).sum(axis=1) + 1.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        g = y * (x @ w + bias) - 1.0
        off = np.where(alpha <= 0, np.minimum(g, 0), np.where(alpha >= upper, np.maximum(g, 0), g))
        active = np.flatnonzero(np.abs(off) > tol)
        if not len(active):
            break
        for i in rng.permutation(active):
            new = min(max(alpha[i] - (y[i] * (w @ x[i] + bias) - 1.0) / diag[i], 0.0), upper[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w += d * x[i]
                bias += d
                alpha[i] = new
    return w, bias


def bags_svm(bags: list[np.ndarray], y: np.ndarray, first: list[int], rounds: int = 4):
    """Bags of windows: a clean bag's windows are all negative, of a toxic bag
    the best window is positive.  ``first``: the windows to begin with."""
    chosen = list(first)
    clean = [b for b, v in zip(bags, y, strict=True) if v <= 0 and len(b)]
    for _ in range(rounds):
        pos = [b[k] for b, v, k in zip(bags, y, chosen, strict=True) if v > 0]
        if not pos or not clean:
            return np.zeros(bags[0].shape[1]), 0.0
        x = np.vstack([np.array(pos), *clean])
        w, bias = svm(x, np.concatenate([np.ones(len(pos)), -np.ones(len(x) - len(pos))]))
        again = [int((b @ w).argmax()) if v > 0 and len(b) else 0 for b, v in zip(bags, y, strict=True)]
        if again == chosen:
            break
        chosen = again
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve a*m+b by damped Newton steps, with smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        z = np.clip(a * margin + b, -30, 30)
        return (weight * (np.log1p(np.exp(z)) - t * z)).sum() + 5e-4 * a * a

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = weight * p * (1 - p)
        g = np.array([(weight * (p - t) * margin).sum() + 1e-3 * a, (weight * (p - t)).sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-4 and loss(a - scale * step[0], b - scale * step[1]) > loss(a, b):
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if abs(scale * step).max() < 1e-8:
            break
    return float(a), float(b)


def prefixes(text: str) -> set[str]:
    """Word beginnings of a text, with the boundary before them, and whole short words."""
    a = shown(text)
    begin = np.flatnonzero(a == ord(BOUNDARY))
    out = set()
    for s in begin:
        w = a[s:s + max(PREFIXES)]
        stop = np.flatnonzero((w[1:] == 0) | (w[1:] == ord(BOUNDARY)))
        w = "".join(map(chr, w[:stop[0] + 1 if len(stop) else len(w)]))
        out.update(w[:n] for n in PREFIXES if n <= len(w))
        if 3 < len(w):
            out.add(w)
    return out


def choose_landmarks(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, float]]:
    """(string, score) of the landmarks, the toxic ones first; clean ones have
    score 0.  ``counts``: (string, toxic texts with it, clean texts with it)."""
    def z(r):
        a, c = r[1] / max(n_toxic, 1), r[2] / max(n_clean, 1)
        p = (r[1] + r[2]) / max(n_toxic + n_clean, 1)
        return (a - c) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / max(n_toxic, 1) + 1 / max(n_clean, 1)))

    out: list[tuple[str, float]] = []
    for s, a, c in sorted(counts, key=lambda r: (-z(r), -len(r[0]), r[0])):
        if len(out) >= TOXIC_LANDMARKS or z((s, a, c)) <= 0:
            break
        if not any(s.startswith(t) or t.startswith(s) for t, _ in out):   # the stronger of a beginning and its extension
            out.append((s, float(z((s, a, c)))))
    taken = {s for s, _ in out}
    common = [(s, 0.0) for s, _, c in sorted(counts, key=lambda r: (-r[2], r[0])) if len(s) >= 5 and s not in taken]
    return out + common[:CLEAN_LANDMARKS]


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_per_class: int):
    """At most ``max_per_class`` ids of either label, and both counts."""
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    n = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}   # two rows
    cut = F.when(F.col("label") == 1, F.lit(hash_cut(max_per_class, n.get(1, 0)))).otherwise(F.lit(hash_cut(max_per_class, n.get(0, 0))))
    rank = Window.partitionBy("label").orderBy("h", "id")
    sample = (usable.withColumn("h", id_hash("id")).where(F.col("h") < cut)
              .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= max_per_class))
    return sample.select("id", "label"), (n.get(0, 0), n.get(1, 0))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_per_class: int, max_chars: int):
    """(fold, label, text) of the sample, materialised, and the labels' counts."""
    sample, share = labelled_sample(labels, id_col, label_col, max_per_class)
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    # ids that name several texts would let the sample grow: the bounds hold for texts
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    size = picked.withColumns({"rank": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order)})
    kept = size.where((F.col("rank") <= max_per_class) & ((F.col("chars") <= max_chars) | (F.col("rank") == 1)))
    return materialize(kept.select((F.col("rank") % 3).alias("fold"), "label", "text"), "toxicity-sample"), share


def known(text: str, value: dict[str, float]) -> np.ndarray:
    """At each word's beginning the largest value of a landmark that the word
    begins with, elsewhere 0."""
    a = shown(text)
    out = np.zeros(len(a))
    for s in np.flatnonzero(a == ord(BOUNDARY)).tolist():
        w = "".join(map(chr, a[s:s + max(PREFIXES)]))
        out[s] = max((value.get(w[:n], 0.0) for n in range(min(PREFIXES), len(w) + 1)), default=0.0)
    return out


def mined(texts: DataFrame, kernel: Kernel, value_of, per_toxic: int, per_clean: int, spread: int) -> list[tuple]:
    """(label, fold, text's digest, coordinates) of each text's windows: those
    of the largest positive or fitted values that do not overlap, and of clean
    texts ``spread`` others at regular places.  ``texts`` is a bounded sample."""
    width = kernel.root.shape[1]

    def run(batches):
        for b in batches:
            out, key = [], []
            for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                value = value_of(text)
                starts, rest = [], value.copy()
                for _ in range(per_toxic if label else per_clean):
                    k = int(rest.argmax())
                    if rest[k] == -np.inf:
                        break
                    starts.append(k)
                    rest[max(0, k - WINDOW + 1):k + WINDOW] = -np.inf
                if not label:
                    starts += [len(value) * k // spread for k in range(spread)]
                out.append(kernel.coordinates(kernel.alphabet.numbers(shown(text)), starts).astype("<f4").tobytes())
                key.append(hashlib.md5(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array(out, pa.binary())],
                                             names=["fold", "label", "key", "windows"])

    got = texts.mapInArrow(run, "fold int, label int, key string, windows binary")
    rows = sorted((r["label"], r["fold"], r["key"], bytes(r["windows"])) for r in got.collect())
    return [(v, f, k, np.frombuffer(w, "<f4").reshape(-1, width).astype(np.float64)) for v, f, k, w in rows]


def fit(texts: DataFrame, share: tuple[int, int] = (0, 0)) -> Model:
    """``texts`` (fold, label, text) is a bounded sample; ``share``: the whole
    table's clean and toxic texts, for the score's prior."""
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(None, constant=float(next(iter(n))) if n else 0.5)

    def count(batches):
        seen = [Counter(), Counter()]
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label].update(prefixes(text))
        rows = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(rows), 50_000):
            part = rows[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][s] for s in part]), pa.array([seen[0][s] for s in part])],
                                             names=["s", "toxic", "clean"])

    counts = (texts.select("label", "text").mapInArrow(count, "s string, toxic long, clean long")
              .groupBy("s").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean > 1"))
    p = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    z = (F.col("toxic") / n[1] - F.col("clean") / n[0]) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)))
    counts = materialize(counts.withColumn("z", z), "toxicity-strings")
    few = (counts.orderBy(F.desc("z"), "s").limit(40 * TOXIC_LANDMARKS)
           .unionByName(counts.orderBy(F.desc("clean"), "s").limit(8 * CLEAN_LANDMARKS))).distinct()
    landmarks = choose_landmarks([(r["s"], r["toxic"], r["clean"]) for r in few.collect()], n[1], n[0])
    if not landmarks:
        return Model(None, constant=n[1] / (n[0] + n[1]))
    kernel = Kernel([t for t, _ in landmarks])
    strong = {t: v for t, v in landmarks if v > 0}
    # the first witnesses are words that begin like a toxic landmark; later ones those that the fit finds worst
    value_of, bags = partial(known, value=strong), None
    for _ in range(ROUNDS):
        found = mined(texts, kernel, value_of, 4, 3, 3)
        new = [r[3] for r in found]
        bags = new if bags is None else [np.vstack(p) for p in zip(bags, new, strict=True)]
        y = np.array([1.0 if r[0] else -1.0 for r in found])
        fold = np.array([r[1] for r in found])
        w, bias = bags_svm(bags, y, [0] * len(bags))
        form = Folded(kernel.alphabet, *kernel.folded(w))
        value_of = form.windows
    out = np.zeros(len(y))
    for f in range(3):
        on = np.flatnonzero(fold != f)
        if len(set(y[on])) < 2:
            continue
        v, c = bags_svm([bags[i] for i in on], y[on], [0] * len(on))
        for i in np.flatnonzero(fold == f):
            out[i] = (bags[i] @ v).max(initial=0.0) + c
    n0, n1 = share if min(share) else ((y < 0).sum(), (y > 0).sum())
    weight = np.where(y > 0, n1 / (y > 0).sum(), n0 / (y < 0).sum())
    a, b = platt(out, y, weight * len(y) / weight.sum())
    return Model(form, bias, a, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    return fit(*labelled_texts(docs, labels, id_col, text_col, label_col, max_per_class, max_chars))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` plus ``out``, which replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col] or [F.lit(0).alias("none")]).alias("row"),
                      F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*src.schema.fields, T.StructField("out", T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())],
                                             names=["row", "text", "out"])

    got = src.mapInArrow(run, schema)
    return got.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept], F.col("out").alias(out))


def held_out() -> F.Column:
    return crc_mod(F.col("doc_id"), 3) == 1


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, out="score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
