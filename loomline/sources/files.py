"""Readers and writers of the jobs' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import schemas
from loomline.sources.documents import read_json


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html: one row per file of a pattern, or of a folder and all folders in it; Spark gives none for an empty file.

    Each file costs some calls to the store, whatever its size; many pages are best packed once.
    """
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def pack_pages(pages: DataFrame, path: str) -> None:
    """Pages (path, html), say those of read_pages(), in as few files as tasks write them: each is a row under its own path, so files grow with bytes and not with pages."""
    pages.select("path", "html").write.mode("append").parquet(path)


def read_packed_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, html: the pages that pack_pages() wrote, in parts of files."""
    return spark.read.schema("path string, html string").parquet(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.EPISODE)


def write_episodes(episodes: DataFrame, path: str, kind: str = "json") -> None:
    """One nested document per episode."""
    episodes.write.mode("overwrite").format(kind).save(path)


def flatten_episodes(episodes: DataFrame) -> DataFrame:
    """Nested episodes as segment rows: episode, chapter_index (from 1), chapter, pos (from 0), speaker, timestamp, text."""
    chapters = episodes.select("episode", F.posexplode("chapters").alias("at", "c"))
    rows = chapters.select("episode", (F.col("at") + 1).alias("chapter_index"), F.col("c.title").alias("chapter"), F.posexplode("c.segments").alias("pos", "s"))
    return rows.select("episode", "chapter_index", "chapter", "pos", "s.speaker", "s.timestamp", "s.text")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return flatten_qa(read_json(spark, path, schemas.QA_FILE))


def flatten_qa(files: DataFrame) -> DataFrame:
    """One row per pair; a pair without an id gets {episode}-q{place from 1}."""
    rows = files.select(F.col("episode").alias("file_episode"), F.posexplode("faqs").alias("at", "q"))
    name = F.coalesce("q.id", F.concat(F.col("file_episode").cast("string"), F.lit("-q"), (F.col("at") + 1).cast("string")))
    return rows.select(name.alias("faq_id"), "q.question", "q.answer", F.coalesce("q.episode", "file_episode").alias("episode"), F.col("q.source_timestamps").alias("timestamps"))


def write_index(index: DataFrame, path: str) -> None:
    """Indexed chunks under their configuration; only the configurations written are replaced."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("embedding_model", "max_words").parquet(path)


def read_index(spark: SparkSession, path: str, model: str, cap: int) -> DataFrame:
    """The index of one configuration: a partition filter."""
    return spark.read.parquet(path).filter((F.col("embedding_model") == model) & (F.col("max_words") == cap))


def append_feedback(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; a missing time is now (UTC)."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows.withColumn("ts", F.coalesce("ts", now)).write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The log; blank lines are skipped, broken ones kept with their text in _corrupt_record."""
    return spark.read.schema(schemas.FEEDBACK).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_results(rows: DataFrame, path: str, config: dict[str, object]) -> None:
    """Results in a folder per configuration, so that configurations never overwrite each other."""
    for name, value in config.items():
        rows = rows.withColumn(name, F.lit(value))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*config).parquet(path)
