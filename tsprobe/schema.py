"""Canonical table schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

MATRIX = T.ArrayType(T.ArrayType(T.FloatType()))

SERIES_WINDOWS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("x", MATRIX),
])

PREDICTIONS = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("correct", T.IntegerType()),
    T.StructField("gt", T.IntegerType()),
    T.StructField("pred", T.IntegerType()),
    T.StructField("letter", T.StringType()),
    T.StructField("model_output", T.StringType()),
])

QA_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("Q", "A", "type", "smry_table")])
QA_ROW = T.StructType([
    T.StructField("index", T.StringType()),
    T.StructField("summaries", T.MapType(T.StringType(), QA_ITEM)),
    T.StructField("qa_pairs", T.MapType(T.StringType(), T.ArrayType(QA_ITEM))),
])
QA_DOCUMENT = T.StructType([T.StructField("dataset", T.ArrayType(QA_ROW))])
