"""Judged answers: samples, work lists, summaries per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.sizing import broadcast_if_small

#: Models up to this many are broadcast to the records.
BROADCAST_MODELS = 10_000


def md5_order(col: Column, seed: int) -> Column:
    """A seeded order that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}|"), col.cast("string")))


def stratified_sample(rows: DataFrame, n: int, seed: int, key: str = "id", stratum: str = "episode") -> DataFrame:
    """n rows spread over strata by share (half-even rounding); the remainder goes to the largest stratum (ties: the first). The draw is by seeded hash."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("all"))
    quotas = sizes.crossJoin(F.broadcast(total)).withColumn("quota", F.bround(F.col("c") / F.col("all") * n, 0).cast("long"))  # one row
    short = quotas.agg((F.lit(n) - F.sum("quota")).alias("short"), F.min(F.struct((-F.col("c")).alias("c"), F.col(stratum).alias("s"))).alias("big"))
    quotas = quotas.crossJoin(F.broadcast(short)).withColumn("quota", F.col("quota") + F.when(F.col(stratum).eqNullSafe(F.col("big.s")), F.col("short")).otherwise(0))
    draw = F.row_number().over(Window.partitionBy(stratum).orderBy(md5_order(F.col(key), seed), key))
    drawn = rows.withColumn("_draw", draw).filter(F.col("_draw") <= n)  # lets every task drop all but its first n of a stratum
    return drawn.join(quotas.select(stratum, "quota"), stratum).filter(F.col("_draw") <= F.col("quota")).drop("_draw", "quota")


def eval_worklist(records: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """Records by models less the pairs already scored good or bad. Models are a short list, broadcast if it is. What is scored is the hashed side, so the pairs stream by and none is sorted or held."""
    asked = broadcast_if_small(models.select("answer_model").distinct(), BROADCAST_MODELS)
    done = results.filter(F.col("score").isin("good", "bad")).select("faq_id", "answer_model").distinct()
    return records.crossJoin(asked).join(done.hint("shuffle_hash"), ["faq_id", "answer_model"], "left_anti")


def drop_stale_results(results: DataFrame, worklist: DataFrame) -> DataFrame:
    """Results that will not be made again. The work list, which may be many times longer, streams by the pairs that have a result, and only those of it are gathered."""
    pair = ["faq_id", "answer_model"]
    again = worklist.select(*pair).join(results.select(*pair).distinct().hint("shuffle_hash"), pair, "left_semi").distinct()
    return results.join(again, pair, "left_anti")


def results_compatible(results: DataFrame, config: dict[str, object]) -> DataFrame:
    """Results of an equal configuration; null equals null."""
    for name, value in config.items():
        results = results.filter(F.col(name).eqNullSafe(F.lit(value)))
    return results


def token_usage(results: DataFrame) -> DataFrame:
    """answer_model and sums of prompt, completion and total tokens over answer and judge calls; null counts as 0."""
    part = lambda c, f: F.coalesce(F.col(c)[f], F.lit(0))
    sums = [F.sum(part("tokens", f) + part("judge_tokens", f)).alias(f) for f in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return results.groupBy("answer_model").agg(*sums)


def judge_summary(results: DataFrame, models: DataFrame) -> DataFrame:
    """answer_model, total, good, bad, failed (rows with an error), good_rate over all rows (null without rows)."""
    counts = results.groupBy("answer_model").agg(
        F.count("*").alias("total"), F.count_if(F.col("score") == "good").alias("good"), F.count_if(F.col("score") == "bad").alias("bad"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("failed"),
    )
    every = models.select("answer_model").distinct().join(counts, "answer_model", "left")
    filled = every.select("answer_model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "good", "bad", "failed")])
    return filled.withColumn("good_rate", F.try_divide(F.col("good").cast("double"), F.col("total").cast("double")))


def best_model(summary: DataFrame) -> DataFrame:
    """The model with the best rate; of equals the later name."""
    return summary.filter("total > 0").agg(F.max(F.struct("good_rate", "answer_model")).alias("b")).select(F.col("b.answer_model").alias("answer_model"), F.col("b.good_rate").alias("good_rate"))


def bad_cases(results: DataFrame, n: int = 10, width: int = 90) -> DataFrame:
    """The first n bad rows by faq_id with the question cut to `width` characters."""
    return results.filter("score = 'bad'").orderBy("faq_id", "answer_model").limit(n).select("faq_id", "answer_model", F.substring("question", 1, width).alias("question"), "reasoning")


def compare_runs(results: DataFrame) -> DataFrame:
    """answer_model, rate_plain, rate_rewritten, delta: good rates with and without rewriting."""
    rate = F.avg((F.col("score") == "good").cast("double"))
    wide = results.groupBy("answer_model").pivot("rewrite_mode", ["plain", "rewritten"]).agg(rate)
    return wide.select("answer_model", F.col("plain").alias("rate_plain"), F.col("rewritten").alias("rate_rewritten"), (F.col("rewritten") - F.col("plain")).alias("delta"))
