"""Removal of boilerplate lines by their spread over distinct sites.

A line's spread is the number of distinct sites (sources) it occurs in.  Per
line hash, HyperLogLog sketches of the sites merge by aggregation, map side
first.  A line whose estimate is clearly above the threshold is boilerplate,
one clearly below is not; lines near the threshold, within four standard
errors of the estimate, get an exact distinct count.  Every occurrence of a
boilerplate line goes but the first (smallest id, then position), so content
that was copied over many sites stays in the corpus once.

Defined cases: very long texts and lines are taken whole; lines are compared
without surrounding spaces; blank lines are
never removed; a null site is one site of its own; a null text has no lines
and stays null; rows with the same id and text count as one document and are
treated alike; other columns are not touched; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.common import read_table

MIN_SITES = 5
LG_K = 12


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per non-blank line: line hash (h1, h2), document (did, t), pos, site."""
    text = F.col(f"`{text_col}`")
    line = F.trim(F.col("line"))
    return (docs.select(F.col(f"`{id_col}`").alias("did"), F.xxhash64(text).alias("t"),
                        F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\u0000")).alias("site"),
                        F.posexplode_outer(F.split(text, "\n")).alias("pos", "line"))
            .where(line != "")
            .select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"), "did", "t", "pos", "site"))


def spread_lines(occ: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Lines (h1, h2, first) that occur in at least ``min_sites`` distinct sites."""
    band = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sketched = (occ.groupBy("h1", "h2")
                .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("did", "t", "pos")).alias("first"))
                .withColumn("spread", F.hll_sketch_estimate("sketch")).drop("sketch")
                .where(F.col("spread") >= min_sites - band))
    above = sketched.where(F.col("spread") > min_sites + band).drop("spread")
    near = sketched.where(F.col("spread") <= min_sites + band).drop("spread")
    counted = (occ.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
               .select("h1", "h2", "site").distinct().groupBy("h1", "h2").count()
               .where(F.col("count") >= min_sites).select("h1", "h2"))
    return above.unionByName(near.join(counted, ["h1", "h2"]))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, lines_out: str = "n_lines", removed_out: str = "n_removed") -> DataFrame:
    """``docs`` with the text cut and the numbers of lines and of removed ones
    (long) added under the given names, which replace columns of these names."""
    from oriel.llm.common import materialize

    occ = line_occurrences(docs, id_col, text_col, site_col)
    spread = materialize(spread_lines(occ, min_sites), "spread-lines")
    first = F.struct("did", "t", "pos")
    gone = (occ.join(spread, ["h1", "h2"]).where(~(F.col("first") == first) | F.col("did").isNull() &
                                                 ~(F.col("first.t").eqNullSafe(F.col("t")) & (F.col("first.pos") == F.col("pos"))))
            .groupBy("did", "t").agg(F.collect_set("pos").alias("gone")))
    lines = F.split(F.col("text"), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(rest, lambda i: F.get("lines", i)), "\n")
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = src.join(gone, F.col("id").eqNullSafe(F.col("did")) & (F.xxhash64("text") == F.col("t")), "left")
    out = joined.withColumn("lines", lines).select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(c) if c == text_col
          else F.col("row").getField(c).alias(c) for c in docs.columns if c not in (lines_out, removed_out)],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(lines_out),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed_out))
    # size(null) is -1 in legacy settings
    return out.withColumns({c: F.greatest(F.col(c), F.lit(0).cast("long")) for c in (lines_out, removed_out)})


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT trim(line) AS line, count(DISTINCT coalesce(source, chr(1))) AS spread, min({{'d': doc_id, 'p': pos}}) AS first
  FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
m AS (
  SELECT l.doc_id, l.pos, l.line,
         s.line IS NOT NULL AND NOT (s.first.d = l.doc_id AND s.first.p = l.pos) AS gone
  FROM l LEFT JOIN s ON trim(l.line) = s.line)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM m GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""
