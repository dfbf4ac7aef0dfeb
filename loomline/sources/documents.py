"""JSON documents of many files, each file judged by itself: a document a line, indented documents, both, and what is broken."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.scratch import stored

#: A file with lines that are no documents is read whole, as one string in a task, up to this size; of a larger one such lines are rejects.
WHOLE_BYTES = 256 << 20

_SPACE = re.compile(r"\s*")
_AT_MARGIN = re.compile(r"^(?=[{\[])", re.M)
_DECODER = json.JSONDecoder()


def split_documents(text: str) -> Iterator[tuple[str | None, str | None]]:
    """(document, None) or (None, reject) of a file in order: JSON objects and arrays one after another, on lines or indented.

    Where no document begins or one is broken, all up to the next line that begins with a brace or bracket at its margin is one reject.
    """
    text = text.removeprefix("﻿")
    at = _SPACE.match(text).end()
    while at < len(text):
        end = at
        if text[at] in "{[":
            try:
                end = _DECODER.raw_decode(text, at)[1]
            except (ValueError, RecursionError):
                end = at
        if end > at:
            yield text[at:end], None
        else:
            found = _AT_MARGIN.search(text, at + 1)
            end = found.start() if found else len(text)
            yield None, text[at:end].rstrip()
        at = _SPACE.match(text, end).end()


def _split_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, text in zip(batch.column(0), batch.column(1), strict=True):
            found = list(split_documents(text.as_py() or ""))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(found), pa.string()), pa.array([d for d, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=["path", "doc", "reject"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, doc, reject: a row a document (its JSON text) or, with doc null, what is no document. Blank lines are skipped.

    Files are read by lines, in as many parts as their size asks for. Where all lines of a file are whole documents, they are the rows. A file with other lines is read once more, whole, and split at its documents,
    so neither a broken line nor an indented neighbour changes what is read of the rest.
    """
    size = F.col("_metadata.file_size")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), size.alias("size"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("line")).filter("line <> ''")
    whole = F.col("line").rlike(r"(?s)^(\{.*\}|\[.*\])$") & ~F.col("line").rlike(r"[}\]]\s*[{\[]") & F.try_parse_json("line").isNotNull()
    judged = stored(lines.groupBy("path", "size").agg(F.count_if(~whole).alias("other")), "judged")
    odd = judged.filter((F.col("other") > 0) & (F.col("size") <= WHOLE_BYTES))
    names = [r["path"] for r in odd.select("path").collect()]  # file names, as many as the listing that Spark holds has at most
    by_line = lines.join(F.broadcast(odd.select("path")), "path", "left_anti").select("path", F.when(whole, F.col("line")).alias("doc"), F.when(~whole, F.col("line")).alias("reject"))
    if not names:
        return by_line
    files = spark.read.text(names, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return by_line.unionByName(files.mapInArrow(_split_whole, "path string, doc string, reject string"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The documents of a path in a schema; the elements of an array are documents each. read_documents() has what is none."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    docs = read_documents(spark, path).filter("doc is not null")
    listed = F.from_json("doc", T.ArrayType(schema))
    one = F.array(F.from_json("doc", schema))
    return docs.select(F.explode(F.when(F.col("doc").startswith("["), listed).otherwise(one)).alias("d")).select("d.*")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """path, reject: broken lines and broken documents."""
    return read_documents(spark, path).filter("doc is null").select("path", "reject")
