import json
import os
import tempfile

from pyspark.sql import functions as F

from oriel.operators.score import Scoring, score_reviews
from oriel.sources import predlog, requests


def test_request_parse_and_respond(spark):
    payloads = [
        (1, json.dumps({"body": json.dumps({"review": "Staff kept us in a queue and dinner was late."})})),
        (2, json.dumps({"review": "  Sunny deck, good soup.  ", "include_genai": False})),
        (3, json.dumps({"review": "   "})),
        (4, json.dumps({})),
        (5, json.dumps({"body": "{bad"})),
        (6, "not json"),
        (7, json.dumps({"body": {"review": "inside an object"}})),
        (8, json.dumps({"review": 123})),
        (9, json.dumps({"body": "[1]"})),
        (10, json.dumps({"body": None, "review": "body is null"})),
        (11, json.dumps({"review": None})),
        (12, None),
    ]
    df = spark.createDataFrame(payloads, "id long, payload string")
    out = {r["id"]: r for r in requests.respond(df, "id", "payload", Scoring(spark)).collect()}
    assert out[3]["status_code"] == 400 and json.loads(out[3]["body"]) == {"error": requests.MISSING_REVIEW}
    codes = {i: r["status_code"] for i, r in out.items()}
    assert codes == {1: 200, 2: 200, 3: 400, 4: 400, 5: 500, 6: 500, 7: 400, 8: 500, 9: 500, 10: 200, 11: 400, 12: 500}
    b1 = json.loads(out[1]["body"])
    assert out[1]["status_code"] == 200 and b1["detected_topic"] == "Flight Delays & Punctuality"
    assert b1["genai_source"] == "fallback" and set(b1["recommendation"]) == {"action", "priority", "owner", "kpi"}
    b2 = json.loads(out[2]["body"])
    assert "ai_recommendation" not in b2 and b2["sentiment_label"] == "Positive"


def test_log_replay_is_idempotent(spark):
    df = spark.createDataFrame([(1, "good food"), (2, "terrible delay")], "review_id long, text string")
    rows = predlog.log_rows(score_reviews(df, "review_id", "text", Scoring(spark)))
    path = os.path.join(tempfile.mkdtemp(prefix="oriel-log-"), "log")
    predlog.append_log(rows, path, batch_id=0)
    predlog.append_log(rows, path, batch_id=0)          # replay of the same batch
    predlog.append_log(rows, path, batch_id=1)          # same reviews again in a later batch
    log = spark.read.parquet(path)
    assert log.count() == 2
    assert log.select(F.countDistinct("prediction_id")).first()[0] == 2


def test_log_append_and_unreadable_log(spark):
    import pytest
    df = spark.createDataFrame([(1, "good food"), (1, "good food"), (2, "late")], "review_id long, text string")
    rows = predlog.log_rows(score_reviews(df, "review_id", "text", Scoring(spark)))
    path = os.path.join(tempfile.mkdtemp(prefix="oriel-log-"), "log")
    predlog.append_log(rows, path)
    predlog.append_log(rows, path)
    assert spark.read.parquet(path).count() == 2
    broken = os.path.join(tempfile.mkdtemp(prefix="oriel-log-"), "log")
    os.makedirs(broken)
    with open(os.path.join(broken, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        predlog.append_log(rows, broken)


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    import pytest
    from oriel import session

    class Other:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Other())


def test_trend_stream_equals_batch(spark, sf):
    from oriel.plans.catalog import _query_scoring
    from oriel.sources.tables import table
    from oriel.streaming.trend import daily_trend, read_trend, start_trend_stream
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    ev = table(spark, sf, "events").select(F.col("event_id").alias("review_id"), "ts")
    scored = score_reviews(d, "review_id", "text", _query_scoring(spark)).join(ev, "review_id")
    rows = predlog.log_rows(scored, ts=F.col("ts").cast("timestamp"))
    base = tempfile.mkdtemp(prefix="oriel-trend-")
    # log files arrive in time order, one file per day range
    rows.repartitionByRange(4, "ts").write.parquet(os.path.join(base, "log"))
    logged = spark.read.parquet(os.path.join(base, "log"))
    q = start_trend_stream(spark, os.path.join(base, "log"), os.path.join(base, "trend"),
                           os.path.join(base, "ckpt"), logged.schema)
    q.awaitTermination()
    got = sorted(tuple(r) for r in read_trend(spark, os.path.join(base, "trend")).collect())
    want = sorted(tuple(r) for r in daily_trend(logged, "ts").collect())
    assert got == want and len(got) > 0


def test_score_with_fitted_model(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression

    from oriel.operators.train import feature_pipeline
    from oriel.plans.catalog import MODEL_NUMERIC
    good = ["great crew and good food", "lovely seat, friendly staff", "excellent service, on time"]
    bad = ["terrible delay and rude staff", "lost bag, awful service", "cancelled flight, no refund"]
    rows = [(i, t, 1) for i, t in enumerate(good * 4)] + [(100 + i, t, 0) for i, t in enumerate(bad * 4)]
    df = spark.createDataFrame(rows, "review_id long, text string, label int")
    cfg = Scoring(spark)
    s = score_reviews(df.select("review_id", "text"), "review_id", "text", cfg)
    from oriel.operators.score import model_features
    train = model_features(s.withColumn("compound", F.col("sentiment_score")).join(df, "review_id"), "review_id", "text") \
        .withColumn("label", F.col("label").cast("double"))
    fm = feature_pipeline("text_processed", MODEL_NUMERIC, vocab_size=100, min_df=1.0, max_df=1.0).fit(train)
    lr = LogisticRegression(maxIter=20).fit(fm.transform(train))
    path = os.path.join(tempfile.mkdtemp(prefix="oriel-model-"), "best")
    PipelineModel(stages=fm.stages + [lr]).write().overwrite().save(path)
    from oriel.operators.score import load_model
    cfg.model = load_model(path)
    out = score_reviews(df.select("review_id", "text"), "review_id", "text", cfg).collect()
    assert len(out) == len(rows)
    assert all(r["confidence"] >= 0.5 for r in out)
    acc = sum((r["predicted_satisfaction"] == "Satisfied") == (r["review_id"] < 100) for r in out) / len(out)
    assert acc >= 0.9
