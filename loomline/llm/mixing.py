"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import WORD, fresh, numbered, small, stable_key, table, written

#: stable_key() has 60 bits: LEVELS histograms of BITS bits each.
BITS, LEVELS = 12, 5
#: Sources up to this many rows of totals may be broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 20_000


def word_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: `weights` repeat over the sources by code point, null last.

    Together the targets are `share` of all sizes; none exceeds `most` times its source's size, and the
    excess is shared again by weight until none does: a target is the lesser of its limit and weight times one common level. With the
    sources in order of limit / weight, filling the first k gives (share - their limits) / (weights of the rest); the level is the
    greatest of these, so one pass of running sums finds it.
    """
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "place")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", cycle.alias("w"), (F.lit(most) * F.col("source_size")).alias("full"))
    weighed = written(weighed.withColumn("turn", F.col("full") / F.col("w")), "targets")
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    filled = numbered(weighed, [F.col("turn"), F.col("source").asc_nulls_last()], "at", {"full_to": "full", "w_to": "w"})
    left = F.lit(float(all_weights or 0)) - F.col("w_to")
    levels = (F.lit(share * (total or 0)) - F.col("full_to")) / F.when(left > 1e-9, left)
    level = max(share * (total or 0) / (all_weights or 1), filled.agg(F.max(levels)).first()[0] or 0.0)
    target = F.round(F.least("full", F.col("w") * F.lit(level)), 6)
    return weighed.select("source", "source_size", target.alias("target"))


def thresholds(base: DataFrame, quotas: DataFrame) -> DataFrame:
    """src, edge, whole, part, n: rows of a source with h under `edge` come once more; of the n rows at the edge, `part`, so
    that the sum comes nearest to the source's `rest` (ties: the smaller sum). whole: part is all of them or none.

    A histogram of sizes by leading hash bits finds the bucket in which the budget ends; only that
    bucket's rows are counted again by the next bits, until a bucket is a single hash value. No rows are sorted. Rows of one hash are
    copies of one row, so only their number matters.
    """
    edges = written(quotas.filter("rest > 0").select("src", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), "edges")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        held = base.join(small(edges, BROADCAST_SOURCES), "src").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = held.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("after", F.col("before") + F.sum("size").over(run)).filter("after >= rest")
        first = sums.groupBy("src").agg(F.min(F.struct("bucket", "after", "size", "rest", "n")).alias("b"))
        edges = first.select("src", "b.rest", F.col("b.bucket").alias("prefix"), (F.col("b.after") - F.col("b.size")).alias("before"), "b.size", "b.n")
        edges = written(edges if level == LEVELS else edges.drop("size", "n"), "edges")
    part = F.ceil((F.col("rest") - F.col("before")) * F.col("n") / F.col("size") - 0.5).cast("long")
    part = F.greatest(F.lit(0), F.least(part, F.col("n")))
    return edges.select("src", F.col("prefix").alias("edge"), ((part == 0) | (part == F.col("n"))).alias("whole"), part.alias("part"), "n")


def _source_key(source: Column) -> Column:
    """The source as a join key that null has too."""
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source.cast("string")))


def _hash(seed: str) -> Column:
    """Of the id and the text, so that only copies of a row share it, with a null id too."""
    return stable_key(F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(seed))


def mix_plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """src, source_size, target, passes, edge, whole, part by source, from rows of source, size, src and h (a written table)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    quotas = targets.withColumn("passes", passes.cast("int")).withColumn("src", _source_key(F.col("source")))
    quotas = written(quotas.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "quotas")
    cut = thresholds(sized.select("src", "h", "size"), quotas)
    known = [F.coalesce("edge", F.lit(-1).cast("long")).alias("edge"), F.coalesce("whole", F.lit(True)).alias("whole"), F.coalesce("part", F.lit(0).cast("long")).alias("part")]
    return written(quotas.join(cut, "src", "left").select("src", "source_size", "target", "passes", *known), "plan")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_size(F.col("text")).alias("size"), _hash(seed).alias("h"))
    return written(rows.withColumn("src", _source_key(F.col("source"))), "mix")


def _with_repeats(rows: DataFrame, plan: DataFrame, h: str, src: str, name: str) -> DataFrame:
    """rows with the columns of the plan and how often each row is taken.

    A row's hash decides, but for copies of one row of which the budget takes a part: those are numbered (by task, then by the
    numbers of the tasks before, so that no task holds them all) and the first of them taken.
    """
    joined = rows.join(small(plan, BROADCAST_SOURCES), F.col(src) == F.col("src") if src != "src" else "src")
    extra = (F.col(h) < F.col("edge")) | ((F.col(h) == F.col("edge")) & F.col("whole") & (F.col("part") > 0))
    if plan.filter("not whole").isEmpty():
        return joined.withColumn(name, F.col("passes") + extra.cast("int"))
    split = ~F.col("whole") & (F.col(h) == F.col("edge"))
    task, rank, offset = fresh(joined, "task", "rank", "offset")
    copies = written(joined.filter(split).withColumn(task, F.spark_partition_id()), "copies")
    held = copies.groupBy(src, task).agg(F.count("*").alias(rank))
    before = F.sum(rank).over(Window.partitionBy(src).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(src, task, F.coalesce(before, F.lit(0)).alias(offset))
    placed = copies.withColumn(rank, F.row_number().over(Window.partitionBy(src, task).orderBy(F.lit(0)))).join(offsets, [src, task])
    placed = placed.withColumn(name, F.col("passes") + (F.col(rank) + F.col(offset) <= F.col("part")).cast("int"))
    return joined.filter(~split).withColumn(name, F.col("passes") + extra.cast("int")).unionByName(placed.drop(task, rank, offset))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats, source for every row of docs.

    A source whose target is k times its size and a rest takes every row k times and rows up to a hash
    threshold once more, whole, so its sum is off its target by half a row at most. The hash is of doc_id, text
    and seed, so reruns agree, and a larger budget keeps what a smaller one took. Copies of a row (or rows of null id and one text) share a hash; where the
    budget ends among them a part of them is taken. A null text has size 0, a null source is a source of its own; of empty sources
    nothing is taken. Very long texts count whole. An empty table gives an empty result. Other columns are ignored.
    """
    sized = _sized(docs, seed)
    joined = _with_repeats(sized, mix_plan(sized, weights, share, most), "h", "src", "repeats")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"), "repeats", "source")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs themselves, each row as often as mix() takes it, with all columns as they are, whatever their names. Only the plan, a row per source, is joined; texts are not shuffled."""
    plan = mix_plan(_sized(docs, seed), weights, share, most)
    names = fresh(docs, *[f"c{i}" for i in range(len(docs.columns))])
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], _hash(seed).alias("h"), _source_key(F.col("source")).alias("key"))
    taken = _with_repeats(renamed, plan, "h", "key", "times").filter("times > 0")
    copied = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copied.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')), 'mix')), 1, 15))::BIGINT AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM totals
), rounds AS (
  SELECT 0 AS step, 0.0::DOUBLE AS level
  UNION ALL
  SELECT step + 1, coalesce((SELECT (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size <= w * level), 0))
                    / sum(w) FILTER (2.0 * source_size > w * level) FROM weighed), level)
  FROM rounds WHERE step < 60
), targets AS (
  SELECT source, source_size, round(least(2.0 * source_size, w * (SELECT max(level) FROM rounds)), 6)::DOUBLE AS target FROM weighed
), quotas AS (
  SELECT *, target - passes * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 0 END AS passes FROM targets)
), runs AS (
  SELECT b.doc_id, b.size, b.h, q.*, sum(b.size) OVER (PARTITION BY q.source ORDER BY b.h) AS after, sum(b.size) OVER (PARTITION BY q.source, b.h) AS together,
         count(*) OVER (PARTITION BY q.source, b.h) AS n, row_number() OVER (PARTITION BY q.source, b.h) AS k
  FROM base b JOIN quotas q ON b.source IS NOT DISTINCT FROM q.source
), picked AS (
  SELECT *, passes + CASE WHEN rest > 0 AND (after < rest OR (after - together < rest AND k <= ceil((rest - (after - together)) * n / together - 0.5))) THEN 1 ELSE 0 END AS repeats
  FROM runs
)
SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, repeats::INTEGER AS repeats, source FROM picked
"""
