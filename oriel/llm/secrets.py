"""Secret scan with column functions only.

Base rules find assignments, access keys and long hex strings.  Two character
Markov models add what the rules miss: one of random strings, one of ordinary
identifiers, both counted over all rows from labelled samples (random: the
values the base rules found; ordinary: all other long tokens).  A token is a
secret if the log of its likelihood ratio, random over ordinary, reaches
``threshold``.

Positions come without Python: the matches of a pattern and the pieces between
them alternate, so running sums of their lengths (a window over the row's own
matches) give every start and end.  One shuffle of the matches by row number
serves the windows and the regrouping; texts are never shuffled.

Defined cases: very long texts are scanned whole; a null or empty text has no
spans; repeated rows are scanned
alike and stay repeated; a found token that overlaps a base span is not
reported again; without any labelled sample both models are uniform and add
nothing; other columns are not touched; an empty table gives an empty table.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oriel.llm.common import read_table

# The base rules.  The last two fold in their least lengths,
# which selects the same spans because their runs are maximal.
KEYWORD = r"(?i)(password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ["assign", "access", "hex", "markov"]

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = 66
SMOOTH = 0.5
PRIOR = 5.0
THRESHOLD = 10.0


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)


def _found(kind: int, text: Column, pattern: str, guard: Column, keep) -> Column:
    """Array of (kind, i, gap, len, keep, value): the matches and the length of the piece before each."""
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    one = F.transform(F.arrays_zip(all_.alias("m"), F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("p"),
                                   *([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v")] if kind == 0 else [])),
                      lambda x, i: F.struct(
                          F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["p"]).alias("gap"),
                          F.char_length(x["m"]).alias("len"), keep(x["v"] if kind == 0 else x["m"]).alias("keep")))
    return F.when(guard, one).otherwise(F.array().cast(SPAN))


SPAN = "array<struct<kind:int,i:int,gap:int,len:int,keep:boolean>>"


def base_values(text: Column) -> Column:
    """Array of the strings the base rules take for secrets."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(text.rlike(KEYWORD), F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                                             lambda v: F.char_length(v) >= MIN_VALUE)).otherwise(none),
        F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(none),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))


def samples_from_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples (value, random) of all rows, one of each occurrence."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    two = docs.select(base_values(text).alias("hits"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"))
    both = F.array(F.struct(F.lit(True).alias("random"), F.col("hits").alias("vs")),
                   F.struct(F.lit(False).alias("random"),
                            F.filter("tokens", lambda t: ~F.array_contains("hits", t)).alias("vs")))
    return (two.select(F.explode(both).alias("x")).select("x.random", F.explode("x.vs").alias("value"))
            .select("value", "random"))


def train(samples: DataFrame, smooth: float = SMOOTH, prior: float = PRIOR) -> list[float]:
    """128 x 128 log-likelihood ratios of character steps.  A step's
    probability falls back on how common its second character is.  Only pair
    counts (at most 2 * 128 * 128 rows) come to the driver."""
    steps = (samples.where(F.col("value").isNotNull()).select("random", _codes(F.col("value")).alias("c"))
             .where(F.size("c") > 1)
             .select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1),
                                                     lambda i: F.get("c", i - 1) * 128 + F.get("c", i))).alias("step"))
             .where((F.col("step") >= 0) & (F.col("step") < 128 * 128))
             .groupBy("random", "step").count())
    n = {True: [0] * (128 * 128), False: [0] * (128 * 128)}
    for r in steps.collect():
        n[r["random"]][r["step"]] = r["count"]
    first = {k: [sum(v[a * 128:a * 128 + 128]) for a in range(128)] for k, v in n.items()}
    second = {k: [sum(v[b::128]) for b in range(128)] for k, v in n.items()}

    def p(k: bool, s: int) -> float:
        common = (second[k][s % 128] + smooth) / (sum(second[k]) + smooth * ALPHABET)
        return (n[k][s] + prior * common) / (first[k][s // 128] + prior)

    return [math.log(p(True, s) / p(False, s)) for s in range(128 * 128)]


def likelihood_ratio(token: Column, model: Column) -> Column:
    """Sum of the model's log ratios over the token's character steps, in one pass."""
    total = F.aggregate(
        _codes(token), F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("prev"), (acc["sum"] + F.when(acc["prev"] < 0, 0.0).otherwise(
            F.coalesce(F.get(model, acc["prev"] * 128 + c), F.lit(0.0)))).alias("sum")),
        lambda acc: acc["sum"])
    return total


def find(docs: DataFrame, model: list[float], text_col: str = "text", carry: str = "doc_id",
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` column and spans, an array of
    (start, kind_no, kind, end) by start, then kind."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    always = F.lit(True)
    found = F.concat(
        _found(0, F.col("t"), ASSIGN, F.col("t").rlike(KEYWORD), lambda v: F.char_length(v) >= MIN_VALUE),
        _found(1, F.col("t"), ACCESS, F.col("t").contains("AKIA"), lambda v: always),
        _found(2, F.col("t"), HEX, always, lambda v: always),
        _found(3, F.col("t"), TOKEN, always, lambda v: likelihood_ratio(v, table) >= threshold))
    rows = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{carry}`").alias("carry"), text.alias("t"))
            .select("rid", "carry", F.explode_outer(found).alias("x"))
            .select("rid", "carry", "x.*").repartition("rid"))
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    placed = (rows.withColumn("start", F.sum("gap").over(upto)
                              + F.coalesce(F.sum("len").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("end", F.col("start") + F.col("len"))
              .withColumn("keep", F.coalesce("keep", F.lit(False))))
    base = F.col("keep") & (F.col("kind") < 3)
    order = Window.partitionBy("rid").orderBy("start", "kind")
    ends = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    own = placed.withColumn("keep", F.col("keep") & ((F.col("kind") < 3) | ~(
        F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False)))))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct(F.col("start"), F.col("kind").alias("kind_no"), F.get(names, F.col("kind")).alias("kind"), F.col("end"))
    return (own.groupBy("rid").agg(F.first("carry").alias(carry), F.array_sort(F.collect_list(F.when(F.col("keep"), span))).alias("spans"))
            .drop("rid"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find(docs, train(samples_from_rules(docs)))
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    return got.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
                      F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
