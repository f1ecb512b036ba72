"""X1–X3 as streams: each review once over many batches and runs; late rows and closed days."""
from datetime import datetime

from pyspark.sql import functions as F

from oriel.operators.score import Scoring
from oriel.sources import predlog
from oriel.streaming.score_stream import start_scoring_stream
from oriel.streaming.trend import daily_trend, read_trend, start_trend_stream

REVIEW = "review_id long, text string"


def test_each_review_is_logged_once_without_reading_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(predlog, "_logged", lambda *a: 1 / 0)      # the log is never read
    incoming, log = f"{tmp_path}/in", f"{tmp_path}/log"
    want = set()
    for wave in range(3):
        for file in range(4):
            rows = [(i, f"review {i} is good") for i in range(file * 5 + wave, file * 5 + wave + 12)]
            want |= {i for i, _ in rows}
            spark.createDataFrame(rows, REVIEW).coalesce(1).write.mode("append").parquet(incoming)
        # a restart from the checkpoint goes on with the same ids
        q = start_scoring_stream(spark, incoming, log, f"{tmp_path}/ckpt", Scoring(spark), files_per_trigger=1)
        q.awaitTermination()
    got = spark.read.parquet(log)
    assert got.select("batch_id").distinct().count() >= 3
    assert got.count() == got.select("prediction_id").distinct().count() == len(want)


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    from oriel.operators.score import score_reviews
    df = spark.createDataFrame([(1, "good food"), (2, "bad delay")], REVIEW)
    rows = predlog.log_rows(score_reviews(df, "review_id", "text", Scoring(spark)))
    for _ in range(2):
        predlog.write_batch(rows, f"{tmp_path}/log", 7)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


LOG = "ts timestamp, detected_topic string, priority string, sentiment_score double"


def test_late_rows_and_closed_days(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame([(datetime(2024, 1, d, h), t, "High", s) for d, h, t, s in rows], LOG).coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/log")
        q = start_trend_stream(spark, f"{tmp_path}/log", f"{tmp_path}/trend", f"{tmp_path}/ckpt",
                               spark.createDataFrame([], LOG).schema)
        q.awaitTermination()
        return {(r["day"], r["detected_topic"]): (r["n"], r["mean_score"]) for r in read_trend(spark, f"{tmp_path}/trend").collect()}

    def batch():
        return {(r["day"], r["detected_topic"]): (r["n"], r["mean_score"]) for r in daily_trend(spark.read.parquet(f"{tmp_path}/log")).collect()}

    first = arrive([(1, 10, "a", 0.5), (1, 11, "b", 0.1), (2, 9, "a", -0.5)])
    assert first == batch()
    late = arrive([(1, 23, "a", 0.7), (3, 1, "a", 0.2)])          # within a day of the latest
    assert late == batch() and late["2024-01-01", "a"] == (2, 0.6)
    arrive([(5, 12, "a", 0.3)])
    closed = arrive([(1, 12, "a", 0.9), (5, 13, "a", 0.5)])       # the first day is closed
    assert closed["2024-01-01", "a"] == (2, 0.6) and closed["2024-01-05", "a"] == (2, 0.4)
    # a batch wrote the groups it changed and no others
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/trend").groupBy("batch").count().collect()}
    assert max(sizes.values()) <= 3 and sum(sizes.values()) <= 8
