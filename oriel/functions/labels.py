"""Label and score rules P6–P14 as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P6
def satisfied_from_compound(c, gate: float = dims.POSITIVE_GATE) -> Column:
    return (_c(c) >= gate).cast("int")


# P7
def three_class(c, pos: float = dims.POSITIVE_GATE, neg: float = dims.NEGATIVE_GATE) -> Column:
    x = _c(c)
    return F.when(x >= pos, "Positive").when(x <= neg, "Negative").otherwise("Neutral")


# P8
def classifier_signed_score(raw_label, confidence) -> Column:
    """POSITIVE -> +confidence, NEGATIVE -> -confidence."""
    return F.when(F.upper(_c(raw_label)) == "NEGATIVE", -_c(confidence)).otherwise(_c(confidence))


def classifier_label(raw_label, confidence, gate: float = dims.CLASSIFIER_CONFIDENCE_GATE) -> Column:
    """3-class label; below the confidence gate the label is Neutral."""
    up = F.upper(_c(raw_label))
    return (F.when(_c(confidence) < gate, "Neutral")
            .when(up == "POSITIVE", "Positive")
            .when(up == "NEGATIVE", "Negative")
            .otherwise("Neutral"))


# P9
def label_to_binary(c, conservative: bool = False) -> Column:
    """Positive 1, Negative 0, Neutral -1 (excluded) or 0 in the conservative form."""
    x = _c(c)
    return F.when(x == "Positive", 1).when(x == "Negative", 0).otherwise(0 if conservative else -1)


# P10
def agrees(a, b) -> Column:
    return _c(a) == _c(b)


# P11
def correct_or_null(pred_bin, truth) -> Column:
    return F.when(_c(pred_bin) != -1, _c(pred_bin) == _c(truth))


# P14
def satisfaction_text(c) -> Column:
    return F.when(_c(c) == 1, "Satisfied").otherwise("Not Satisfied")
