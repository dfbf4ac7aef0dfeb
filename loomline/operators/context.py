"""Contexts and citations of answers, and rewritten questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed value: the form of a source, by episode, guest, chapter, start and end.
SOURCE = 'Episode %s · %s · chapter "%s" · %s-%s'


def source(doc: Column) -> Column:
    """What a chunk struct cites, after SOURCE; a missing guest is `Unknown`, other missing parts are empty."""
    known = lambda c, other="": F.coalesce(c.cast("string"), F.lit(other))
    return F.format_string(SOURCE, known(doc["episode"]), known(doc["guest"], "Unknown"), known(doc["chapter"]), known(doc["start_ts"]), known(doc["end_ts"]))


def source_line(n: Column, doc: Column) -> Column:
    """`[n]` and the source of a chunk struct."""
    return F.concat(F.format_string("[%d] ", n), source(doc))


def build_context(retrieved: DataFrame) -> DataFrame:
    """query_id, context: numbered blocks of a query's chunks by rank, each a source line and the text."""
    doc = F.struct("episode", "guest", "chapter", "start_ts", "end_ts")
    block = F.concat(F.format_string("[%d] (", F.col("rank")), source(doc), F.lit(")\n"), F.coalesce("text", F.lit("")))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda r: r["block"]), "\n\n").alias("context"))


def cite_sources(answers: DataFrame) -> DataFrame:
    """answers (raw, docs) with sources and answer: lines of the cited numbers in order, of all documents if none is valid; appended unless the answer says `source`. A null answer is an empty one."""
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(r"\[(\d+)\]")), lambda x: x.try_cast("int"))))
    valid = F.filter(numbers, lambda n: (n > 0) & (n <= F.size("docs")))
    used = F.when(F.size(valid) > 0, valid).when(F.size("docs") > 0, F.sequence(F.lit(1), F.size("docs"))).otherwise(F.array().cast("array<int>"))
    lines = F.transform(used, lambda n: source_line(n, F.element_at("docs", n)))
    raw = F.coalesce("raw", F.lit(""))
    return answers.withColumn("sources", lines).withColumn("answer", F.when(raw.rlike("(?i)source"), raw).otherwise(F.concat(raw, F.lit("\n\nSources:\n"), F.array_join("sources", "\n"))))


def questions_to_rewrite(questions: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """q_hash, question: distinct questions that the model has not rewritten yet."""
    asked = questions.select(F.sha1("question").alias("q_hash"), "question").dropDuplicates(["q_hash"])
    return asked.join(cache.filter(F.col("rewrite_model") == model).select("q_hash").distinct(), "q_hash", "left_anti")


def rewrite_lookup(questions: DataFrame, cache: DataFrame, model: str, within: tuple[str, ...] = ()) -> DataFrame:
    """questions with retrieve_query: the cached rewrite, else the question. within: columns of both tables, where a cache is kept for each of their values (each episode, say) and holds for that alone."""
    known = cache.filter(F.col("rewrite_model") == model).groupBy("q_hash", *within).agg(F.min("rewritten").alias("rewritten"))
    asked = questions.withColumn("q_hash", F.sha1("question")).join(known, ["q_hash", *within], "left")
    return asked.withColumn("retrieve_query", F.coalesce("rewritten", "question")).drop("rewritten", "q_hash")
