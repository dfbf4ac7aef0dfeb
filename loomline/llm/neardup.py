"""Near-duplicates by circulant MinHash, with exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import small, table, written
from loomline.llm.components import components
from loomline.llm.shingles import BAND_ROWS, band_count, band_keys, digest, distinct, shingle_marks, signature
from loomline.llm.textscan import Words, as_bytes, row_slices

#: Ids of candidates up to this many rows may be broadcast to the texts; more shuffle.
BROADCAST_IDS = 500_000
#: Shingles of the sets that leave a task together.
SET_MARKS = 1 << 22


def _row_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle marks of each text."""
    data, offsets = as_bytes(column)
    for lo, hi in row_slices(offsets):
        marks, first = shingle_marks(Words(data, offsets, lo, hi))
        for row in range(hi - lo):
            yield distinct(marks[first[row] : first[row + 1]])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.array([len(x) for x in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int64()))


def signatures(texts: DataFrame, percent: int) -> DataFrame:
    """doc_id, n (distinct shingles), d0, d1 (digest of the set), bands (keys; none for an empty set)."""
    bands = band_count(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, digests, keys = [], [], []
            for marks in _row_sets(batch.column(1)):
                sets.append(len(marks))
                digests.append(digest(marks))
                keys.append(band_keys(signature(marks, bands * BAND_ROWS)) if len(marks) else np.zeros(0, np.int64))
            d = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(keys)], names=["doc_id", "n", "d0", "d1", "bands"])

    return texts.mapInArrow(run, "doc_id long, n long, d0 long, d1 long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """rep, n, sh (sorted marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, begin, held = [], 0, 0
            for place, marks in enumerate(_row_sets(batch.column(1)), 1):
                sets.append(marks.view(np.int64))
                held += len(marks)
                if held > SET_MARKS or place == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(sets)), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["rep", "n", "sh"])
                    sets, begin, held = [], place, 0

    return texts.mapInArrow(run, "rep long, n long, sh array<long>")


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, u of sets that may have a link. u: shingles of no other set.

    A link needs percent% of the union in common, so a set of whose shingles more than the rest are its own has none.
    """
    lone = sets.select("rep", F.explode("sh").alias("s")).groupBy("s").agg(F.min("rep").alias("rep"), F.count("*").alias("df")).filter("df = 1")
    counts = lone.groupBy("rep").agg(F.count("*").alias("u"))
    known = sets.select("rep", "n").join(counts, "rep", "left").select("rep", "n", F.coalesce("u", F.lit(0)).alias("u"))
    return written(known.filter((100 - percent) * F.col("n") >= 100 * F.col("u")), "linkable")


def _can_link(percent: int, n_a: Column, n_b: Column, apart: Column, u_a: Column, u_b: Column) -> Column:
    """Whether sets that differ in `apart` shingles at least, u_a and u_b of them on either side, can be linked."""
    both, need = n_a + n_b, F.lit(100 + percent)
    return (need * (both - apart) >= 2 * percent * both) & (need * F.least(n_a - u_a, n_b - u_b) >= percent * both)


def _room(percent: int, n: Column, u: Column) -> Column:
    """What a set leaves for a link: two sets can be linked only if their rooms add up to 0 or more (_can_link with nothing known but sizes and own shingles)."""
    return (100 - percent) * n - (100 + percent) * u


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, both (shingles in common), linked; exact, on full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sh").alias("sh_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sh").alias("sh_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("sh_a", "sh_b"))
    rows = joined.select("a", "b", "n_a", "n_b", both.cast("long").alias("both"))
    return rows.select("a", "b", "both", ((100 + percent) * F.col("both") >= percent * (F.col("n_a") + F.col("n_b"))).alias("linked"))


def _met(members: DataFrame, percent: int) -> DataFrame:
    """Members outside their pivot's class (columns o_*) beside all other members of their bucket, but for pairs that _room rules out.

    Two members without room for a link are never linked, so they do not meet: sides are joined by bucket and whether there is room. A bucket of m
    texts of one template, each with too much of its own, gives no pairs, not m squared.
    """
    room = _room(percent, F.col("n"), F.col("u"))
    most = members.groupBy("bucket").agg(F.max(room).alias("most"))
    live = members.join(most, "bucket").filter(room + F.col("most") >= 0).select(*members.columns, (room >= 0).alias("room"))
    sides = F.when(F.col("room"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    out = live.filter(F.col("class") != F.col("class_p")).select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("rep", "n", "u", "class", "with_p", "buckets")], F.explode(sides).alias("room"))
    return out.join(live, ["bucket", "room"])


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: classes of texts linked by a Jaccard similarity of percent% or more.

    Shingles are 5 words (runs of non-space, A to Z lower-cased), a shorter text is one shingle; a null text or one without words has none and links
    with nothing. Texts of equal sets are one node (their least doc_id). Nodes that share a band of the signature are candidates:

    1. Sets that share too little with any other candidate to be linked go (exact bounds by the shingles that occur once).
    2. In each band bucket the set with the least of its own is the pivot; the others are verified against it, and classes formed.
    3. Members outside their bucket's pivot's class are verified against all other members that are not of
       their class and that the bounds (sizes, own shingles, what each shares with the pivot) do not rule out. A
       pair is looked at in the first bucket that both share; as their classes differ, one is outside the pivot's there too.

    So no link between different texts that share a bucket is lost, and buckets of copies cost one
    comparison a member. The chance that a linked pair shares no bucket is at most 1e-5. Rows of a null doc_id link
    with nothing (component_id null, kept true); a repeated row has its first one's class. doc_id is the identity of
    a text: rows of one doc_id with different texts count as linked. Very long texts are compared whole and need memory for the set of one
    text at a time. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(signatures(texts, percent), "signatures")
    reps = written(sig.filter("n > 0 and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("rep")), "reps")
    banded = sig.select(F.col("doc_id").alias("rep"), "d0", "d1", "bands").join(reps, ["rep", "d0", "d1"], "left_semi").select("rep", F.explode("bands").alias("bucket"))
    live = banded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("bucket")
    members = written(banded.join(live, "bucket", "left_semi"), "members")
    ids = written(members.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    near = texts.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi")
    sets = written(shingle_sets(near), "sets")
    first = _linkable(sets, percent)
    nodes = _linkable(sets.join(first.select("rep"), "rep", "left_semi"), percent)

    own = written(members.join(nodes, "rep"), "own")
    best = F.struct((F.col("u") / F.col("n")).alias("share"), (-F.col("n")).alias("size"), F.col("rep").alias("p"), F.col("n").alias("n_p"), F.col("u").alias("u_p"))
    pivots = own.groupBy("bucket").agg(F.min(best).alias("x"), F.max("rep").alias("hi"), F.min("rep").alias("lo")).filter("lo < hi").select("bucket", "x.p", "x.n_p", "x.u_p")
    own = written(own.join(pivots, "bucket"), "placed")
    star = own.filter(F.col("rep") != F.col("p")).filter(_can_link(percent, F.col("n"), F.col("n_p"), F.col("u") + F.col("u_p"), F.col("u"), F.col("u_p")))
    star = written(_verified(star.select(F.col("rep").alias("a"), F.col("p").alias("b")).distinct(), sets, percent), "star")
    classes = written(components(star.filter("linked")), "classes")

    seen = star.select(F.col("a").alias("rep"), F.col("b").alias("p"), F.col("both").alias("with_p"))
    of = classes.select(F.col("node").alias("rep"), "component")
    of_pivot = classes.select(F.col("node").alias("p"), F.col("component").alias("component_p"))
    known = own.join(of, "rep", "left").join(of_pivot, "p", "left").join(seen, ["rep", "p"], "left")
    known = known.select("bucket", "rep", "n", "u", F.coalesce("component", "rep").alias("class"), F.coalesce("component_p", "p").alias("class_p"), F.when(F.col("rep") == F.col("p"), F.col("n_p")).otherwise(F.col("with_p")).alias("with_p"))
    known = written(known, "known")
    mixed = known.join(known.filter(F.col("class") != F.col("class_p")).select("bucket").distinct(), "bucket", "left_semi")
    lists = mixed.groupBy("rep").agg(F.collect_set("bucket").alias("buckets"))
    mixed = written(mixed.join(lists, "rep"), "mixed")
    apart = F.col("u") + F.col("o_u") + F.coalesce(F.abs(F.col("with_p") - F.col("o_with_p")), F.lit(0))
    rest = _met(mixed, percent).filter(
        (F.col("class") != F.col("o_class"))
        & _can_link(percent, F.col("n"), F.col("o_n"), apart, F.col("u"), F.col("o_u"))
        & (F.array_min(F.array_intersect("buckets", "o_buckets")) == F.col("bucket"))
    )
    rest = rest.select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct()
    more = written(_verified(rest, sets, percent).filter("linked"), "more")
    if not more.isEmpty():
        classes = written(components(star.filter("linked").select("a", "b").union(more.select("a", "b"))), "classes")

    of_set = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("d0", "d1", F.coalesce("component", "rep").alias("component"))
    found = sig.select("doc_id", "n", "d0", "d1").join(of_set, ["d0", "d1"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


#: Exact classes by pairwise comparison: shingle pairs counted, then labels spread to a fixed point.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, len(w) < 5 AS whole, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.whole = y.whole AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * common >= 85 * (m.n + k.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.y FROM reach r JOIN (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links) l ON r.seen = l.x
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
