"""Daily counts and mean score per topic and priority, batch and stream.

The batch form is a plain ``groupBy(window(ts, '1 day'), ...)``.  The stream
form keeps one state row per (day, topic, priority) until the watermark has
passed the day, in update mode: a micro-batch writes the groups it changed, and
nothing else, under its own number.  Rows up to ``late`` behind the latest
change their group; later ones are dropped with the day's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_trend(scored: DataFrame, ts_col: str = "ts") -> DataFrame:
    # scores have 4 decimals: an exact decimal sum divided once gives the same
    # double in any engine (rounding a computed mean can split ties)
    g = scored.groupBy(F.window(ts_col, "1 day").alias("w"), "detected_topic", "priority").agg(
        F.count("*").alias("n"), F.sum(F.col("sentiment_score").cast("decimal(18,4)")).alias("s"))
    return g.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "detected_topic", "priority",
                    F.col("n").cast("bigint").alias("n"), (F.col("s").cast("double") / F.col("n")).alias("mean_score"))


def start_trend_stream(spark, log_path: str, out_path: str, checkpoint: str, schema, ts_col: str = "ts",
                       late: str = "1 day", available_now: bool = True, files_per_trigger: int = 1000):
    """Stream form of X3 over the prediction log files.  Each micro-batch
    overwrites its own ``batch`` partition of changed groups, so a replay writes
    the same rows; ``read_trend`` gives the table."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(log_path)
           .withWatermark(ts_col, late))
    agg = daily_trend(src, ts_col)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


TREND = "day string, detected_topic string, priority string, n bigint, mean_score double, batch long"


def read_trend(spark, out_path: str) -> DataFrame:
    """The trend table: each group as its last batch wrote it."""
    changes = spark.read.schema(TREND).parquet(out_path)
    last = changes.groupBy("day", "detected_topic", "priority").agg(F.max_by(F.struct("n", "mean_score"), "batch").alias("v"))
    return last.select("day", "detected_topic", "priority", "v.n", "v.mean_score")

