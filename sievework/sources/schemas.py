"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns every source is brought to.
CORPUS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

ONE_LINERS = T.StructType(
    [T.StructField("ID", T.LongType()), T.StructField("Joke", T.StringType())]
)

TRAINING_RECORD = T.StructType(
    [
        T.StructField("context", T.StringType()),
        T.StructField("joke", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
