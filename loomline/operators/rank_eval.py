"""Ranking quality against ground truth from source times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import clock_to_seconds

#: Chunks and times meet by episode and by time buckets of so many seconds.
BUCKET_SECONDS = 600


def map_ground_truth(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, doc_id: for each of a query's times the first chunk (by chapter, then id) of its episode that covers it, ends included.

    Malformed and null clocks match nothing. A chunk is listed under every time bucket that it covers, so the interval join is a
    hash join even in very long episodes.
    """
    bucket = lambda s: F.floor(s / BUCKET_SECONDS).cast("int")
    spans = chunks.select("episode", F.col("id").alias("doc_id"), "chapter_index", clock_to_seconds(F.col("start_ts")).alias("lo"), clock_to_seconds(F.col("end_ts")).alias("hi"))
    spans = spans.filter("lo <= hi").withColumn("bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    times = queries.select("query_id", "episode", F.explode("timestamps").alias("clock")).withColumn("t", clock_to_seconds(F.col("clock"))).filter("t is not null").select("query_id", "episode", "t", bucket(F.col("t")).alias("bucket")).distinct()
    met = times.join(spans, ["episode", "bucket"]).filter("t between lo and hi")
    first = met.groupBy("query_id", "episode", "t").agg(F.min(F.struct("chapter_index", "doc_id")).alias("c"))
    return first.select("query_id", F.col("c.doc_id").alias("doc_id")).distinct()


def query_hits(ranked: DataFrame, gold: DataFrame, methods: list[str]) -> DataFrame:
    """method, query_id, first_hit (rank or null), found, n_gold for every query with gold under every method."""
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.join(gold, ["query_id", "doc_id"]).groupBy("method", "query_id").agg(F.min("rank").alias("first_hit"), F.count("*").alias("found"))
    every = wanted.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return every.join(hits, ["method", "query_id"], "left").select("method", "query_id", "first_hit", F.coalesce("found", F.lit(0)).alias("found"), "n_gold")


def hit_rate_at_k(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """method, k, hit_rate: share of queries with gold among the first k."""
    rate = [F.struct(F.lit(k).alias("k"), F.avg(F.coalesce((F.col("first_hit") <= k).cast("double"), F.lit(0.0))).alias("hit_rate")) for k in ks]
    return hits.groupBy("method").agg(F.array(*rate).alias("r")).select("method", F.inline("r"))


def mrr(hits: DataFrame) -> DataFrame:
    """method, mrr: mean of 1 / rank of the first gold document, 0 where there is none."""
    return hits.groupBy("method").agg(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def recall_at_depth(hits: DataFrame) -> DataFrame:
    """method, recall: gold documents found over all gold documents."""
    return hits.groupBy("method").agg(F.coalesce(F.try_divide(F.sum("found").cast("double"), F.sum("n_gold").cast("double")), F.lit(0.0)).alias("recall"))


def compare_methods(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """A row per method with all metrics."""
    return hits.groupBy("method").agg(
        F.count("*").alias("n_queries"),
        *[F.avg(F.coalesce((F.col("first_hit") <= k).cast("double"), F.lit(0.0))).alias(f"hit_{k}") for k in ks],
        F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        F.coalesce(F.try_divide(F.sum("found").cast("double"), F.sum("n_gold").cast("double")), F.lit(0.0)).alias("recall"),
    )


def eval_coverage(queries: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """total, evaluated, with_gold, without_gold, failed: one row. results: query_id, status."""
    rows = queries.select("query_id").join(results.select("query_id", "status"), "query_id", "left").join(gold.select("query_id").distinct().withColumn("has_gold", F.lit(True)), "query_id", "left")
    done = F.col("status") == "ok"
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("evaluated"),
        F.count_if(done & F.col("has_gold").isNotNull()).alias("with_gold"),
        F.count_if(done & F.col("has_gold").isNull()).alias("without_gold"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def resume_queries(queries: DataFrame, results: DataFrame, config: dict[str, object], limit: int | None = None, order: str = "query_id") -> DataFrame:
    """Queries without a result of status ok under an equal configuration. With `limit`, of the first so many queries by the column `order` (the place in the file, say), so a rerun with one limit does no more than the first run."""
    same = results
    for name, value in config.items():
        same = same.filter(F.col(name).eqNullSafe(F.lit(value)))
    asked = queries.orderBy(*dict.fromkeys([order, "query_id"])).limit(limit) if limit else queries
    return asked.join(same.filter("status = 'ok'").select("query_id").distinct(), "query_id", "left_anti")
