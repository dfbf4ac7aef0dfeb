"""Aggregates of the feedback log."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.scratch import stored
from loomline.functions.sizing import broadcast_if_small
from loomline.functions.text import tokenize, word_count

#: Labels of ratings, and the right-open bins of answer lengths.
LABELS = {1: "helpful", -1: "not helpful"}
#: Size of a quantile sketch: larger is nearer. Units of time by quantiles that may be broadcast to the log.
SKETCH, BROADCAST_BANDS = 4096, 100_000
BINS = (0, 50, 100, 150, 200, 300, 500, 1000)


def rating_label(with_none: bool = False):
    label = F.when(F.col("rating") == 1, LABELS[1]).when(F.col("rating") == -1, LABELS[-1])
    return label.when(F.col("rating") == 0, "no rating") if with_none else label


def feedback_parse(log: DataFrame) -> DataFrame:
    """log with ts as a UTC timestamp (null if malformed) and label (null for other ratings)."""
    ts = F.col("ts") if dict(log.dtypes)["ts"].startswith("timestamp") else F.try_to_timestamp("ts")
    return log.withColumn("ts", ts.cast("timestamp")).withColumn("label", rating_label())


def feedback_totals(log: DataFrame) -> DataFrame:
    """total, good, bad (all others), positive_rate."""
    counts = log.agg(F.count("*").alias("total"), F.count_if(F.col("rating") == 1).alias("good"))
    return counts.select("total", "good", (F.col("total") - F.col("good")).alias("bad"), F.try_divide(F.col("good").cast("double"), F.col("total").cast("double")).alias("positive_rate"))


def recent_questions(parsed: DataFrame, n: int = 5, width: int = 120) -> DataFrame:
    """The n latest rows with a time: time, question cut to `width`, model ('' if null), rating label."""
    rows = parsed.filter("ts is not null").orderBy(F.desc("ts"), "feedback_id").limit(n)
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.substring("question", 1, width).alias("question"), F.coalesce("model", F.lit("")).alias("model"), rating_label(True).alias("rating"))


def label_counts(parsed: DataFrame) -> DataFrame:
    return parsed.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def daily_counts(parsed: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """day, n by local calendar day from the first to the last; days without rows count 0."""
    days = parsed.filter("ts is not null").groupBy(F.to_date(F.from_utc_timestamp("ts", zone)).alias("day")).agg(F.count("*").alias("n"))
    calendar = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def citations_by_episode(log: DataFrame) -> DataFrame:
    """episode, n: cited chunk ids by what stands before their first dash."""
    cited = log.select(F.explode("doc_ids").alias("id")).select(F.element_at(F.split("id", "-"), 1).alias("episode"))
    return cited.filter("episode <> ''").groupBy("episode").agg(F.count("*").alias("n"))


def top_words(log: DataFrame, stop_words: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent terms of questions that are no stop words (column word); ties by word."""
    words = log.filter("question is not null").select(F.explode_outer(tokenize(F.col("question"))).alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return words.join(stop_words.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(n)


def answer_length_histogram(log: DataFrame) -> DataFrame:
    """bin_start, bin_end, n by words of answers; bins are right-open and empty ones stay; answers beyond the last are the bin without an end."""
    edges = [(lo, hi) for lo, hi in zip(BINS, BINS[1:], strict=False)] + [(BINS[-1], None)]
    bins = log.sparkSession.createDataFrame(edges, "bin_start int, bin_end int")
    place = F.lit(BINS[0])
    for lo in BINS[1:]:
        place = F.when(F.col("words") >= lo, lo).otherwise(place)
    counts = log.filter("answer is not null").select(word_count(F.col("answer")).alias("words")).groupBy(place.alias("bin_start")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin_start", "left").select("bin_start", "bin_end", F.coalesce("n", F.lit(0)).alias("n"))


def latency_series(parsed: DataFrame) -> DataFrame:
    """ts, retrieval_ms where it is known."""
    return parsed.filter("retrieval_ms is not null and ts is not null").select("ts", "retrieval_ms")


def latency_sketches(parsed: DataFrame, k: int = SKETCH) -> DataFrame:
    """day, n, longest, sketch: a mergeable quantile sketch a day, to be stored."""
    known = latency_series(parsed).groupBy(F.to_date("ts").alias("day"))
    return known.agg(F.count("*").alias("n"), F.max("retrieval_ms").alias("longest"), F.kll_sketch_agg_double(F.col("retrieval_ms").cast("double"), F.lit(k)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, unit: str = "day", quantiles: dict[str, float] | None = None, k: int = SKETCH) -> DataFrame:
    """unit, n, a column a quantile (p50, p95), longest by `unit` of time (day, week, month): from stored sketches alone, the log is not read.

    A quantile is the least value whose rank reaches it. Up to about k rows a unit it is exact; beyond, its rank is off by some 2 / k of the rows (0.05 % at k = 4096) with 99 % confidence.
    """
    merged = sketches.groupBy(F.to_date(F.date_trunc(unit, "day")).alias(unit)).agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    wanted = quantiles or {"p50": 0.5, "p95": 0.95}
    return merged.select(unit, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in wanted.items()], "longest")


def exact_quantiles(parsed: DataFrame, sketches: DataFrame, unit: str = "day", quantiles: dict[str, float] | None = None, k: int = SKETCH) -> DataFrame:
    """As latency_quantiles(), exact for any number of rows: the sketches say between which values a quantile lies, and the log is read for those alone.

    What lies below such a band is only counted and its values are grouped, so a unit's values are not sorted as a whole. Should a sketch be so far off that a rank lies outside its band, bands are widened.
    """
    wanted = quantiles or {"p50": 0.5, "p95": 0.95}
    at = lambda c: F.to_date(F.date_trunc(unit, c)).alias(unit)
    log = latency_series(parsed).select(at("ts"), F.col("retrieval_ms").cast("double").alias("v"))
    merged = stored(sketches.groupBy(at("day")).agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")), "merged")
    share, units = 8 / k, merged.count()
    while True:
        edge = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(min(max(q, 0), 1)))) if share < 1 else F.lit(None).cast("double")
        rank = lambda q: F.greatest(F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(str(q)))).cast("long"), F.lit(1))
        bands = merged.select(unit, F.inline(F.array(*[F.struct(F.lit(name).alias("name"), rank(q).alias("rank"), edge(q - share).alias("lo"), edge(q + share).alias("hi")) for name, q in wanted.items()])))
        met = log.join(broadcast_if_small(bands, BROADCAST_BANDS), unit).filter("hi is null or v <= hi")
        counts = met.groupBy(unit, "name", "rank", F.when(F.col("lo").isNull() | (F.col("v") >= F.col("lo")), F.col("v")).alias("v")).agg(F.count("*").alias("rows"))
        so_far = F.sum("rows").over(Window.partitionBy(unit, "name").orderBy(F.col("v").asc_nulls_first()))
        found = counts.withColumn("upto", so_far).filter("v is not null and upto >= rank and upto - rows < rank")
        found = stored(found.select(unit, "name", "v"), "found")
        if share >= 1 or found.count() == units * len(wanted):
            break
        share *= 8
    values = found.groupBy(unit).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted])
    return merged.join(values, unit).select(unit, "n", *wanted, "longest")


def latency_by_day(parsed: DataFrame) -> DataFrame:
    """day, n, p50, p95, longest; exact, see exact_quantiles()."""
    return exact_quantiles(parsed, stored(latency_sketches(parsed), "sketches"))
