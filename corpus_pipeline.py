"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.scratch import scratch
from loomline.llm.common import fresh, small, table, written
from loomline.llm.decontaminate import contained_items
from loomline.llm.mixing import mixed_rows
from loomline.llm.neardup import near_duplicates
from loomline.llm.sharding import with_shard
from loomline.llm.toxicity import REJECT, score_texts, train

#: Similarity in percent from which texts count as near-duplicates, and the share of a benchmark item that a document may not hold.
NEAR_PERCENT, CONTAINED = 80, 0.8
SHARDS = 24
#: Ids of dropped documents that may be broadcast, so that texts are not shuffled; more shuffle.
BROADCAST_IDS = 500_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is REJECT or more. Null and empty texts score 0 and stay; so do all if no labels can be learned from."""
    names = fresh(docs, "score", "toxic_spans")
    field = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, field, names=tuple(names)).filter(F.col(names[0]) < REJECT).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates: that with the least id, a null id last.

    Rows are compared under numbers of their own, so repeated rows and rows with a null id are grouped like any other. Rows without words are
    no copies of each other and stay.
    """
    (row,) = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), NEAR_PERCENT).select(F.col("doc_id").alias("row"), F.col("component_id").alias("class"))
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    several = written(classes.filter(F.col("row") != F.col("class")), "several")
    heads = several.select(F.col("class").alias("row")).distinct().select("row", F.col("row").alias("class"))
    members = written(several.union(heads).join(ids, "row"), "members")
    best = members.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).select("class", F.col("best.row").alias("best"))
    gone = members.join(small(written(best, "best"), BROADCAST_IDS), "class").filter(F.col("row") != F.col("best")).select(F.col("row").alias(row))
    return rows.join(small(written(gone, "gone"), BROADCAST_IDS), row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. A row's key is a digest of its id and text, so that each row is judged by its own text, with a null or repeated id too."""
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rows = keyed.select(F.col(key).alias("doc_id"), "text")
    leaks = contained_items(rows, table(spark, sf_dir, "benchmark"), CONTAINED).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(small(written(leaks, "leaks"), BROADCAST_IDS), key, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every row as often as the mix takes it; drops those it does not take. Null sources mix as a source of their own."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's shard as `shard` (with underscores, where that name is taken). Repeats of a document share a shard, as do all rows without an id."""
    return with_shard(docs, SHARDS, name=fresh(docs, "shard")[0])


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicate),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`: the documents that stay, as often as the mix takes them, with their shard."""
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "corpus-pipeline")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{base}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The first stage scores with a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
