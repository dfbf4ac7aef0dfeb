"""Benchmark decontamination: MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, lower_ascii, small, table, written

WIDTH = 5
#: Least average length of a signature, and the seed of its hash.
SKETCH, SEED = 32, 41
#: Signatures, ids of suspects and item shingles are broadcast up to so many rows (about 100 bytes each); beyond that the joins shuffle.
BROADCAST_ROWS = 200_000


def word_array(text):
    """Words of a text, A to Z lower-cased; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SPACE)
    return F.array_remove(parts, "")


def shingle_rows(rows: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """key, w0..w4: a row for each place of a shingle; a text of fewer words is one shingle padded with nulls.

    The word array is zipped with its own shifts and inlined, so shingles are made inside the compiled
    stage, without a window or a join.
    """
    words = rows.select(key, word_array(F.col("text")).alias("w"))
    names = [f"w{i}" for i in range(width)]
    count = F.greatest(F.size("w") - (width - 1), F.least(F.size("w"), F.lit(1)))
    zipped = words.select(key, F.arrays_zip(*[F.slice("w", F.lit(i + 1), count).alias(names[i]) for i in range(width)]).alias("z"))
    # inline_outer: for the inner form the optimizer filters on the whole expression, which would split every text many times over
    return zipped.select(key, F.inline_outer("z").alias(*names)).filter("w0 is not null")


def mark(width: int = WIDTH):
    return F.xxhash64(*[f"w{i}" for i in range(width)])


def fraction(col: Column) -> Column:
    """A hash of the column as a number from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), col), 11).cast("double") / float(1 << 53)


def rate_of(size: Column) -> Column:
    """Share of its shingles that an item's signature keeps: by size partition (powers of two), so that each keeps SKETCH or more on average; all of a smaller item's."""
    return F.least(F.lit(1.0), F.lit(float(SKETCH)) / F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double")))))


def sketch_items(items: DataFrame, threshold: float, miss: float) -> DataFrame:
    """item_id, mark, need: the MinHash signature of every item, and how many of its values a text's signature must share.

    A signature keeps the shingles whose hash is under the partition's rate (MinHash of a fixed rate, made for containment between
    sets of very different sizes: the shared part of an item's signature estimates its containment however long the text is). The
    estimate of an item contained to `threshold` falls under `need` with a chance of at most `miss` (Hoeffding's
    bound); a signature that keeps the whole item is exact.
    """
    rated = items.withColumn("rate", rate_of(F.col("n_item"))).select("item_id", "mark", "rate").distinct()
    kept = rated.filter(fraction(F.col("mark")) < F.col("rate"))
    sizes = kept.groupBy("item_id").agg(F.count("*").cast("double").alias("s"))
    slack = F.when(F.col("rate") < 1.0, F.sqrt(F.col("s") * F.lit(math.log(1 / miss) / 2))).otherwise(0.0)
    need = F.greatest(F.lit(1.0), F.ceil(F.lit(threshold) * F.col("s") - slack - 1e-9))
    return kept.join(sizes, "item_id").select("item_id", "mark", "rate", need.cast("long").alias("need"))


def sketch_texts(texts: DataFrame, rate: float) -> DataFrame:
    """doc_id, mark: the signatures of texts for all partitions at once, as signatures of lower rates are parts of those of higher ones."""
    marks = shingle_rows(texts, "doc_id").select("doc_id", mark().alias("mark"))
    return marks.filter(fraction(F.col("mark")) < rate) if rate < 1.0 else marks


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, miss: float = 1e-7) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: items of which at least `threshold` of the distinct 5-word shingles are in a document.

    Size-partitioned MinHash: items are partitioned by size, which fixes the rate of their signatures; texts and items are signed by the
    same hash; (document, item) pairs whose signatures share enough are candidates, verified by exact containment on the shingles' words.

    Words are runs of non-space, A to Z lower-cased. An item or document of one to four words is a single shingle
    (it matches only an equal whole); without words it matches nothing, as null does. Very long texts are shingled inside
    the compiled stage, row by row, and need memory in proportion to the longest text. `miss` bounds the chance to overlook an item at
    the threshold. Repeated rows of an id count as one text (the shingles of rows with one doc_id are joined);
    rows with a null doc_id or item_id are left out. An empty side gives an empty result; other columns are ignored, whatever their names.
    """
    item_words = shingle_rows(items.filter("item_id is not null").select("item_id", "text"), "item_id").distinct()
    sizes = item_words.groupBy("item_id").agg(F.count("*").alias("n_item"))
    shingled = written(item_words.join(sizes, "item_id").withColumn("mark", mark()), "items")
    sketches = written(sketch_items(shingled.select("item_id", "n_item", "mark"), threshold, miss), "sketches")
    rate = sketches.agg(F.max("rate")).first()[0] or 0.0

    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    shared = sketch_texts(texts, rate).join(small(sketches.drop("rate"), BROADCAST_ROWS), "mark").distinct()
    estimated = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    candidates = written(estimated.filter("n >= need").select("doc_id", "item_id"), "candidates")

    suspects = texts.join(small(written(candidates.select("doc_id").distinct(), "suspects"), BROADCAST_ROWS), "doc_id", "left_semi")
    names = [f"w{i}" for i in range(WIDTH)]
    there = shingle_rows(suspects, "doc_id")
    asked = shingled.join(small(written(candidates.select("item_id").distinct(), "asked"), BROADCAST_ROWS), "item_id", "left_semi")
    parts = there.withColumn("mark", mark()).join(small(asked, BROADCAST_ROWS).withColumnsRenamed({n: f"i_{n}" for n in names}), "mark")
    same = parts.filter(" and ".join(f"{n} <=> i_{n}" for n in names))
    pairs = same.select("doc_id", "item_id", "n_item", "mark", *names).distinct().groupBy("doc_id", "item_id").agg(F.first("n_item").alias("n_item"), F.count("*").alias("n_shared"))
    kept = pairs.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))
    return kept.join(candidates, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_item", "n_shared")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark WHERE item_id IS NOT NULL
), shingles AS (
  SELECT DISTINCT side, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS s, len(w) < 5 AS whole
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0)
), items AS (
  SELECT id AS item_id, s, whole, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE side = 'i'
)
SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared
FROM shingles d JOIN items i ON d.s = i.s AND d.whole = i.whole WHERE side = 'd'
GROUP BY 1, 2, 3 HAVING count(*) >= 0.8 * n_item
"""
