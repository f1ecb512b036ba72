"""Request parsing and JSON responses as column expressions.

A request is JSON text: either a gateway envelope whose ``body`` is JSON
text, or the request object itself.  Blank or missing reviews become 400
rows, malformed requests 500 rows (kept in the output, never failing the
batch); everything else is scored by ``score_reviews`` and answered with a
nested JSON body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import recommend as rc
from ..operators.score import Scoring, score_reviews

# Fixed value: the message of the request contract.
MISSING_REVIEW = "Missing required field: review"
MALFORMED = "Malformed request"


def parse_requests(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, review, include_genai, status_code): 200 to be scored, 400 without a
    review, 500 malformed.

    A ``body`` that is text holds the request as JSON; any other is ignored.
    Malformed are payloads or bodies that are not JSON objects, and reviews
    that are neither text nor empty."""
    payload = F.try_parse_json(F.col(payload_col))
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    body_kind = kind(payload, "$.body")
    body = F.try_parse_json(F.try_variant_get(payload, "$.body", "string"))
    in_body = F.coalesce(body_kind == "STRING", F.lit(False))
    d = df.select(id_col, is_object(payload).alias("__object"), in_body.alias("__in_body"),
                  F.when(in_body, body).otherwise(payload).alias("__src"))
    review_kind = F.coalesce(kind(F.col("__src"), "$.review"), F.lit("VOID"))
    falsy = F.coalesce(F.try_variant_get("__src", "$.review", "string").isin("0", "false", "[]", "{}"), F.lit(False))
    wrong = (~F.col("__object") | (F.col("__in_body") & ~is_object(F.col("__src")))
             | (~review_kind.isin("STRING", "VOID") & ~falsy))
    review = F.when(review_kind == "STRING", tx.strip_ws(F.try_variant_get("__src", "$.review", "string"))).otherwise("")
    status = F.when(wrong, 500).when(review == "", 400).otherwise(200)
    return d.select(id_col, F.coalesce(review, F.lit("")).alias("review"),
                    F.coalesce(F.try_variant_get("__src", "$.include_genai", "boolean"), F.lit(True)).alias("include_genai"),
                    status.alias("status_code"))


def respond(df: DataFrame, id_col: str, payload_col: str, cfg: Scoring) -> DataFrame:
    """(id, status_code, body) for every request."""
    req = parse_requests(df, id_col, payload_col)
    ok = req.where(F.col("status_code") == 200)
    bad = req.where(F.col("status_code") != 200)
    scored = score_reviews(ok, id_col, "review", cfg, keep=["include_genai"])
    dec = "decimal(6,4)"
    rec = F.struct("action", "priority", "owner", "kpi").alias("recommendation")
    core = [F.col("sentiment_label"), F.col("sentiment_score").cast(dec).alias("sentiment_score"),
            F.col("predicted_satisfaction"), F.col("confidence").cast(dec).alias("confidence"),
            F.col("detected_topic"), rec]
    with_ai = F.to_json(F.struct(*core, rc.fallback_text("action").alias("ai_recommendation"),
                                 F.lit("fallback").alias("genai_source")))
    without_ai = F.to_json(F.struct(*core))
    good = scored.select(id_col, F.lit(200).alias("status_code"),
                         F.when(F.col("include_genai"), with_ai).otherwise(without_ai).alias("body"))
    message = F.when(F.col("status_code") == 400, MISSING_REVIEW).otherwise(MALFORMED)
    err = bad.select(id_col, "status_code", F.to_json(F.struct(message.alias("error"))).alias("body"))
    return good.unionByName(err)


def build_requests(df: DataFrame, id_col: str, text_col: str, shape_col: str) -> DataFrame:
    """Test/replay helper: wrap texts as requests.  shape: 'gateway' (body is
    JSON text), 'direct' (include_genai false), 'blank' (empty review), or the
    malformed 'object' (body is an object), 'broken' (body is not JSON),
    'text' (payload is not JSON), 'number' (review is a number)."""
    text = F.col(text_col)
    direct = F.to_json(F.struct(text.alias("review"), F.lit(False).alias("include_genai")))
    gateway = F.to_json(F.struct(F.to_json(F.struct(text.alias("review"))).alias("body")))
    blank = F.to_json(F.struct(F.lit("   ").alias("review")))
    as_object = F.to_json(F.struct(F.struct(text.alias("review")).alias("body")))
    broken = F.to_json(F.struct(F.concat(F.lit("{bad "), text).alias("body")))
    number = F.to_json(F.struct(F.length(text).alias("review")))
    s = F.col(shape_col)
    return df.select(id_col, F.when(s == "gateway", gateway).when(s == "direct", direct).when(s == "object", as_object)
                     .when(s == "broken", broken).when(s == "text", text).when(s == "number", number)
                     .otherwise(blank).alias("payload"))
