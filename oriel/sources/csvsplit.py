"""CSV with line breaks inside quotes, read in parallel.

A line break ends a record only outside quotes, and whether a place is inside
depends on all quotes before it; a reader that honours this takes a file whole.
Here the file is read as lines in the byte ranges of Spark's text source:

1. each range counts its quotes, and the records that begin in it if it starts
   outside and if it starts inside quotes (one small row per range);
2. running sums over a file's ranges tell how each range starts and the number
   of its first record;
3. each line gets its record's number.  A line that is a whole record is parsed
   where it is; the lines of longer records, and only they, meet by number.

Doubled quotes are two quotes, so the parity holds.  A quote that is never
closed makes the rest of its file one record, as it does for any reader.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINES = "file string, block long, rec long, at long, whole boolean, line string"


def _ranges(batch: pa.RecordBatch):
    """(file, block, lines, quotes) for each stretch of lines of one range."""
    files, blocks, lines = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
    if not len(batch):
        return
    names = files.to_pylist()
    change = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1] or blocks[i] != blocks[i - 1]] + [len(names)]
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
    for a, b in zip(change, change[1:], strict=False):
        yield names[a], int(blocks[a]), lines.slice(a, b - a), quotes[a:b]


def _count(batches):
    found: dict = {}
    for batch in batches:
        for file, block, lines, quotes in _ranges(batch):
            q, outside, inside = found.get((file, block), (0, 0, 0))
            before = (q + np.cumsum(quotes) - quotes) % 2
            found[file, block] = (q + int(quotes.sum()), outside + int((before == 0).sum()), inside + int((before == 1).sum()))
    if found:
        yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "quotes": q, "outside": o, "inside": i} for (f, b), (q, o, i) in found.items()])


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Rows of CSV files with a quote character of \", doubled inside quotes.
    Ranges have the size of the session's ``spark.sql.files.maxPartitionBytes``."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    per = lines.mapInArrow(_count, "file string, block long, quotes long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)     # a row per range
    per = per.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    per = per.withColumn("begun", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    starts = per.select("file", "block", "odd", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("begun")).collect()
    shared = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["odd"], r["begun"]) for r in starts})   # a row per range

    def number(batches):
        state: dict = {}
        for batch in batches:
            for file, block, part, quotes in _ranges(batch):
                odd, begun, at = state.get((file, block)) or (*shared.value[file, block], 0)
                total = odd + np.cumsum(quotes)
                begins = (total - quotes) % 2 == 0
                rec = begun + np.cumsum(begins) - 1
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(rec, pa.int64()), pa.array(np.arange(at, at + n)),
                     pa.array(begins & (total % 2 == 0)), part], names=["file", "block", "rec", "at", "whole", "line"])
                state[file, block] = (int(total[-1]), begun + int(begins.sum()), at + n)

    numbered = lines.mapInArrow(number, LINES)
    first = F.lit(0 if header else -1)
    longer = (numbered.where("NOT whole").groupBy("file", "rec")
              .agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
              .select("rec", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line")))
    records = numbered.where("whole").select("rec", "line").unionByName(longer).where(F.col("rec") > first)
    text = F.regexp_replace(F.regexp_replace("line", "\r\n", "\n"), "\r$", "")
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    # one row of nulls for a blank line is no record
    return records.select(text.alias("line")).where("line <> ''").select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
