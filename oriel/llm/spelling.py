"""Spelling variants: permuterm rotations, sorted, with the edited character skipped.

Every word gets the terminator ``$`` and is rotated at each position.  Two
kinds of rows enter one sort:

* ``skip``: the rotation that ends in character i, without that character
  (``w[i+1:] $ w[:i]``).  Words that share it differ at most in character i.
* ``full``: the whole rotation (``w[i:] $ w[:i]``).  A longer word whose skip
  row equals it has one more character, just there.

So a replacement is a group of skip rows and an indel a full row among skip
rows.  Where the inserted character repeats its neighbour the same two words
would meet at every place of that run; only the first place of a run counts as
an indel.  A group holds one row for each character of the alphabet and one
full row at most, and each row is sent out with its group's best other word
and their number only: no pairs are written.  A word of k characters gives
2k + 1 rows of k characters each.

Forms point to words at least ``factor`` times as frequent, so a chain of forms
has at most log(largest count) / log(factor) links; roots come from doubling.

Defined cases: a null text has no words, a null id counts as empty text in the
key that selects runs; repeated rows count as often as they stand there; very
long texts and words are taken whole; ties of the count go to the smaller word in code-point order; a word
without near words has form null, n_near 0 and itself as root; an empty table
gives an empty table; other columns are never read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.common import materialize, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters once A-Z is lower-cased.
RUN = "[a-zÀ-ÿ]+"
END = "$"


def drop_char(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                min_count: int = 5, damage_every: int = 199) -> DataFrame:
    """(word, n) of the letter runs of whole texts.  A run loses its code point
    h % length where ``damage_every`` divides h = crc32("id:run")."""
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    # outer: no second evaluation for a size filter
    r = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                    F.explode_outer(runs).alias("run")).where(F.length("run") >= min_length)
    r = r.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    word = F.when(F.col("h") % damage_every == 0,
                  drop_char(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = r.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, c, first, n): ``c`` is the skipped character, null in a full row;
    ``first``: it does not repeat the character before it."""
    w, i = F.col("word"), F.col("i")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length(w))).alias("i"))
    head = F.substring(w, F.lit(1), i)
    whole = F.concat(F.substring(w, i + 1, F.length(w)), F.lit(END), head)
    skip = F.concat(F.substring(w, i + 2, F.length(w)), F.lit(END), head)
    c, before = F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1))
    rows = F.array(
        F.struct(whole.alias("key"), F.lit(None).cast("string").alias("c"), F.lit(False).alias("first")),
        F.when(i < F.length(w), F.struct(skip.alias("key"), c.alias("c"), ((i == 0) | (c != before)).alias("first"))))
    return at.select("n", F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): near words (one inserted, deleted or
    replaced character), the most frequent first; words without any are left out."""
    g = rotations(words).groupBy("key").agg(F.collect_list(F.struct("n", "c", "first")).alias("rows")).where(F.size("rows") > 1)
    end = F.instr("key", END)
    tail, head = F.substring("key", F.lit(1), end - 1), F.substring("key", end + 1, F.length("key"))
    # a word again from its rotation; -n: the array's order is the order of preference
    full = F.transform("rows", lambda x: F.struct((-x["n"]).alias("neg"), F.concat(F.col("head"), F.coalesce(x["c"], F.lit("")), F.col("tail")).alias("word"),
                                                  x["c"].isNotNull().alias("skip"), x["first"].alias("first")))
    g = g.select(tail.alias("tail"), head.alias("head"), "rows").select(F.array_sort(full).alias("all"))
    g = g.select("all", F.filter("all", lambda x: x["skip"]).alias("skips"), F.filter("all", lambda x: x["first"]).alias("firsts"))
    m = g.select(F.explode("all").alias("me"), "all", "skips", "firsts")
    # who is near: a full row to the skip rows that start a run, a skip row to the other skip rows and, if it starts a run, to the full row
    others = F.when(~F.col("me.skip"), F.col("firsts")).when(F.col("me.first"), F.col("all")).otherwise(F.col("skips"))
    mine = F.col("me.skip").cast("int")
    m = m.select(F.col("me.word").alias("word"), (F.size(others) - mine).alias("near"),
                 F.when(F.get(others, F.lit(0))["word"] != F.col("me.word"), F.get(others, F.lit(0)))
                 .otherwise(F.get(others, F.lit(1))).alias("best")).where("near > 0")
    best = m.select("word", "near", F.struct("best.neg", "best.word").alias("best"))
    return best.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("b")).select(
        "word", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.word").alias("best"))


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n): one row
    per word.  ``words`` is read twice; give a table or a materialised frame."""
    linked = words.join(near_words(words), "word", "left")
    form = F.col("best_n") >= factor * F.col("n")
    linked = materialize(linked.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")), "spelling-forms")
    jumps = linked.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = linked.agg(F.max("n")).first()[0] or 1
    links = int(math.log(most) / math.log(factor)) + 1
    for k in range(max(1, math.ceil(math.log2(links + 1)))):
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = materialize(jumps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"spelling-roots{k}")
    return linked.join(jumps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near",
        F.col("form_n").cast("long").alias("form_n"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(materialize(word_counts(docs), "spelling-words"))


#: crc32 by bits: a byte is added by xor, then eight shifts (-1) follow it.
OP13_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(k, ''), lambda ch:
      CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
      ELSE [192 + (unicode(ch) >> 6)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(ch) & 63)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] END)),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS h FROM runs),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less, substr(word, 1, i) || chr(1) || substr(word, i + 2) AS other
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS x, b.n AS xn FROM cuts a JOIN cuts b ON a.other = b.other AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'neg': -xn, 'x': x}}) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN -b.b.neg >= 5 * w.n THEN b.b.x END AS form,
         CASE WHEN -b.b.neg >= 5 * w.n THEN (-b.b.neg)::BIGINT END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS here, 0 AS d FROM forms
  UNION ALL SELECT k.word, f.form, d + 1 FROM walk k JOIN forms f ON k.here = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(here, d) AS root FROM walk GROUP BY word) r ON f.word = r.word
"""
