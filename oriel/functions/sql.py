"""SQL-callable forms of the rule expressions (Spark 4 SQL functions).

``register_sql_functions(spark)`` creates temporary SQL functions whose
bodies are plain SQL expressions, so Catalyst inlines them like any other
expression (JVM-side, code-generated); no Python is involved at run time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import dims


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _topic_case(variant: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {_s(k)})" for k in kws) + f" THEN {_s(t)}"
        for t, kws in dims.TOPIC_KEYWORDS[variant])
    return f"CASE {whens} ELSE {_s(dims.DEFAULT_TOPIC)} END"


def _lemma_case() -> str:
    parts = ["CASE WHEN char_length(w) <= 4 THEN w"]
    for suf, rep in dims.LEMMA_RULES:
        parts.append(f"WHEN endswith(w, {_s(suf)}) AND char_length(w) - {len(suf)} + {len(rep)} >= 3 "
                     f"THEN concat(substr(w, 1, char_length(w) - {len(suf)}), {_s(rep)})")
    parts.append("ELSE w END")
    return " ".join(parts)


def definitions() -> dict[str, str]:
    pos, neg = dims.POSITIVE_GATE, dims.NEGATIVE_GATE
    hi, cr = dims.ESCALATE_TO_HIGH_BELOW, dims.ESCALATE_TO_CRITICAL_BELOW
    rank = " ".join(f"WHEN {_s(p)} THEN {r}" for p, r in dims.PRIORITY_RANK)
    return {
        "oriel_satisfied": f"(score DOUBLE) RETURNS INT RETURN CAST(score >= {pos} AS INT)",
        "oriel_three_class": (f"(score DOUBLE) RETURNS STRING RETURN CASE WHEN score >= {pos} THEN 'Positive' "
                              f"WHEN score <= {neg} THEN 'Negative' ELSE 'Neutral' END"),
        "oriel_satisfaction_text": "(s INT) RETURNS STRING RETURN CASE WHEN s = 1 THEN 'Satisfied' ELSE 'Not Satisfied' END",
        "oriel_label_to_binary": ("(label STRING) RETURNS INT RETURN CASE label WHEN 'Positive' THEN 1 "
                                  "WHEN 'Negative' THEN 0 ELSE -1 END"),
        "oriel_score_to_percent": "(score DOUBLE) RETURNS DOUBLE RETURN (score + 1.0) / 2.0 * 100.0",
        "oriel_word_count": "(text STRING) RETURNS INT RETURN size(regexp_extract_all(text, '(?U)\\\\S+', 0))",
        "oriel_count_char": "(text STRING, c STRING) RETURNS INT RETURN char_length(text) - char_length(replace(text, c, ''))",
        "oriel_escalate": (f"(priority STRING, score DOUBLE) RETURNS STRING RETURN "
                           f"CASE WHEN score < {cr} AND (CASE WHEN score < {hi} AND priority = 'MEDIUM' THEN 'HIGH' "
                           f"ELSE priority END) = 'HIGH' THEN 'CRITICAL' "
                           f"ELSE (CASE WHEN score < {hi} AND priority = 'MEDIUM' THEN 'HIGH' ELSE priority END) END"),
        "oriel_priority_rank": f"(priority STRING) RETURNS INT RETURN CASE priority {rank} ELSE {dims.UNKNOWN_PRIORITY_RANK} END",
        "oriel_detect_topic": f"(text STRING) RETURNS STRING RETURN {_topic_case('lambda')}",
        "oriel_detect_topic_app": f"(text STRING) RETURNS STRING RETURN {_topic_case('app')}",
        "oriel_suffix_lemma": f"(w STRING) RETURNS STRING RETURN {_lemma_case()}",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    names = []
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
        names.append(name)
    return names
