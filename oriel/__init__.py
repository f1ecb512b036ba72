"""oriel — review analytics on Spark: text cleaning, lexicon sentiment,
profiling, features, models, topics and service recommendations as
DataFrame -> DataFrame functions."""

__version__ = "0.1.0"
