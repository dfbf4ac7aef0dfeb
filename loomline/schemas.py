"""Explicit schemas of the files that jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("text", T.StringType())])
CHAPTER = T.StructType([T.StructField("title", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT))])
EPISODE = T.StructType([T.StructField("episode", T.IntegerType()), T.StructField("guest", T.StringType()), T.StructField("chapters", T.ArrayType(CHAPTER))])

QA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("source_timestamps", T.ArrayType(T.StringType())),
        T.StructField("boundary", T.StringType()),
        T.StructField("est_tokens", T.IntegerType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("guest", T.StringType()),
        T.StructField("episode", T.IntegerType()),
    ]
)
QA_FILE = T.StructType(
    [
        T.StructField("episode", T.IntegerType()),
        T.StructField("guest", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("faqs", T.ArrayType(QA)),
    ]
)
FEEDBACK = T.StructType(
    [
        T.StructField("rating", T.IntegerType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("doc_ids", T.ArrayType(T.StringType())),
        T.StructField("ts", T.StringType()),
        T.StructField("retrieval_ms", T.LongType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
