"""Question/answer extraction: the data work around a model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.membership import absent

#: Names under which a response may list its pairs, and boundaries of a pair.
LIST_KEYS = ("qa_pairs", "faqs", "pairs", "results")
BOUNDARIES = ("ok", "merge", "long_split")
#: Fixed value: a fenced block of a response.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
CHAPTER_KEYS = ["episode", "chapter_index"]


def render_requests(batched: DataFrame, guests: DataFrame) -> DataFrame:
    """episode, chapter_index, batch, body: a header line, then `speaker | clock | text` lines in order."""
    line = F.concat_ws(" | ", F.coalesce("speaker", F.lit("Unknown")), F.coalesce("timestamp", F.lit("")), F.col("text"))
    grouped = batched.groupBy(*CHAPTER_KEYS, "batch").agg(F.first("chapter").alias("chapter"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    named = grouped.join(guests.select("episode", "guest"), "episode", "left")
    head = F.format_string("Episode %s, guest %s, chapter %s", F.col("episode").cast("string"), F.coalesce("guest", F.lit("Unknown")), F.col("chapter"))
    return named.select(*CHAPTER_KEYS, "batch", F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("body"))


def _outer(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    begin, back = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    end = F.length(text) - back + 1
    return F.when((begin > 0) & (back > 0) & (end > begin), F.substring(text, begin, end - begin + 1))


def _whole_json(text: Column) -> Column:
    """The text as a variant, null if it is not JSON from end to end."""
    trimmed = F.trim(text)
    closed = F.regexp_extract(trimmed, r"(?s)^([\[{]).*([\]}])$", 0) != ""
    return F.when(closed, F.try_parse_json(trimmed))


def parse_responses(responses: DataFrame) -> DataFrame:
    """episode, chapter_index, batch, failed, item_pos, item (variant): a row per listed pair, one with a null item for a batch without any.

    A response is JSON as a whole, else what a fenced block holds, else what stands from the first to the last brace; anything else is a failed
    batch. A bare list is the list of pairs.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    fenced = F.regexp_extract(content, FENCED, 1)
    data = F.coalesce(_whole_json(content), _whole_json(fenced), _whole_json(_outer(content)))
    parsed = responses.select(*CHAPTER_KEYS, "batch", data.alias("data"))
    lists = F.coalesce(F.try_variant_get("data", "$", "array<variant>"), *[F.try_variant_get("data", f"$.{k}", "array<variant>") for k in LIST_KEYS])
    rows = parsed.select(*CHAPTER_KEYS, "batch", F.col("data").isNull().alias("failed"), F.posexplode_outer(lists).alias("item_pos", "item"))
    return rows


def validate_qa(items: DataFrame) -> DataFrame:
    """Parsed items with their fields and `outcome`: a boundary, or `skipped`.

    Trimmed; skipped if marked so, or with a question under 8 or an answer under 20 characters. A single timestamp becomes a list; six at most stay.
    """
    text = lambda name: F.trim(F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit("")))
    listed = F.coalesce(
        F.try_variant_get("item", "$.source_timestamps", "array<string>"),
        F.when(F.try_variant_get("item", "$.source_timestamps", "string").isNotNull(), F.array(F.try_variant_get("item", "$.source_timestamps", "string"))),
        F.array().cast("array<string>"),
    )
    rows = items.filter(F.col("item").isNotNull()).select(
        *CHAPTER_KEYS, "batch", "item_pos", text("question").alias("question"), text("answer").alias("answer"),
        F.slice(listed, 1, 6).alias("source_timestamps"), text("boundary").alias("given"),
        F.coalesce(F.try_variant_get("item", "$.skipped", "boolean"), F.lit(False)).alias("skip"),
    )
    short = F.col("skip") | (F.length("question") < 8) | (F.length("answer") < 20)
    boundary = F.when(F.col("given").isin("merge", "long_split"), F.col("given")).otherwise("ok")
    tokens = F.floor((F.length("question") + F.length("answer") + 3) / 4).cast("int")
    return rows.select(*CHAPTER_KEYS, "batch", "item_pos", "question", "answer", "source_timestamps", F.when(short, "skipped").otherwise(boundary).alias("outcome"), tokens.alias("est_tokens"))


def assign_qa_ids(valid: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Kept pairs with id {episode}-{chapter:02d}-{n:03d}; n runs in batch order through a chapter and goes on after its existing pairs."""
    kept = valid.filter("outcome <> 'skipped'")
    n = F.row_number().over(Window.partitionBy(*CHAPTER_KEYS).orderBy("batch", "item_pos"))
    numbered = kept.withColumn("n", n)
    if existing is not None:
        have = existing.groupBy(*CHAPTER_KEYS).agg(F.count("*").alias("have"))
        numbered = numbered.join(have, CHAPTER_KEYS, "left").withColumn("n", F.col("n") + F.coalesce("have", F.lit(0))).drop("have")
    return numbered.withColumn("id", F.format_string("%s-%02d-%03d", F.col("episode").cast("string"), "chapter_index", "n")).withColumnRenamed("outcome", "boundary").drop("n")


def qa_stats(valid: DataFrame) -> DataFrame:
    """By episode: counts of outcomes, and of est_tokens of kept pairs the upper median, the largest and how many exceed 500."""
    counts = valid.groupBy("episode").agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in (*BOUNDARIES, "skipped")])
    kept = valid.filter("outcome <> 'skipped'")
    spread = kept.groupBy("episode", "est_tokens").agg(F.count("*").alias("c"))
    so_far = Window.partitionBy("episode").orderBy("est_tokens").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("upto", F.sum("c").over(so_far)).withColumn("n", F.sum("c").over(Window.partitionBy("episode")))
    tokens = spread.groupBy("episode").agg(
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("est_tokens"))).alias("est_tokens_median"),
        F.max("est_tokens").alias("est_tokens_max"),
        F.sum(F.when(F.col("est_tokens") > 500, F.col("c")).otherwise(0)).alias("est_over_500"),
    )
    return counts.join(tokens, "episode", "left")


def pending_batches(batches: DataFrame, status: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Batches that no run has finished. known: a key_filter of the finished ones."""
    return absent(batches, status.filter("ok"), [*CHAPTER_KEYS, "batch"], known)


def keep_known_chapters(pairs: DataFrame, status: DataFrame) -> DataFrame:
    """Pairs of chapters that have a state; others would be extracted anew."""
    return pairs.join(status.select(*CHAPTER_KEYS).distinct(), CHAPTER_KEYS, "left_semi")


def merge_batch_status(status: DataFrame) -> DataFrame:
    """By chapter: done and failed batches over all runs (a later success clears a failure), and whether all are done."""
    by_batch = status.groupBy(*CHAPTER_KEYS, "batch").agg(F.bool_or("ok").alias("ok"))
    return by_batch.groupBy(*CHAPTER_KEYS).agg(
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("batch")))).alias("done_batches"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("batch")))).alias("failed_batches"),
        F.bool_and("ok").alias("complete"),
    )


def order_qa(pairs: DataFrame, chapters: DataFrame) -> DataFrame:
    """pairs with `place` in their episode: by chapter order (unknown chapters last; of chapters of one title the first counts), then id."""
    order = chapters.groupBy("episode", "chapter").agg(F.min("chapter_index").alias("ord"))
    placed = pairs.join(order, ["episode", "chapter"], "left")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("episode").orderBy(F.coalesce("ord", F.lit(999)), "id"))).drop("ord")
