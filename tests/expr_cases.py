"""Helpers of the unit tests (kept out of conftest.py: no test imports a
module of that name)."""


def one(spark, expr, value, schema="x string"):
    """Evaluate a Column expression on a one-row DataFrame with column x."""
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]
