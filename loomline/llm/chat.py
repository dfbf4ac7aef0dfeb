"""Chat formatting: logged snapshots of one growing conversation collapse to the longest, then each is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import table, written


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """conv_id of maximal conversations, with their number of turns.

    Every turn gets the rolling hash of its prefix: a running sum of two 64-bit hashes of (place, role,
    text), so a prefix costs one step whatever its length. A conversation whose whole hash is a proper
    prefix of another one goes; of conversations that are equal the least conv_id stays. Role and text
    compare by value, null equal to null only; turns order by turn, then role, then text (nulls first), so repeated
    turn numbers have a defined order. Rows with a null conv_id belong to no conversation and are left out.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    marks = [F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)") for seed in (11, 29)]
    hashed = placed.select("conv_id", "place", *[m.alias(f"m{i}") for i, m in enumerate(marks)])
    run = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy("place")
    rolled = hashed.select("conv_id", "place", F.sum("m0").over(run).alias("h0"), F.sum("m1").over(run).alias("h1"), F.lead("place").over(after).isNull().alias("last"))
    rolled = written(rolled, "prefixes")
    whole = rolled.filter("last").groupBy("place", "h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    shorter = rolled.filter("not last").select("place", "h0", "h1").distinct()
    kept = whole.join(shorter, ["place", "h0", "h1"], "left_anti")
    return kept.select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, open_mark: str = "<|{}|>\n", close_mark: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, chat: the turns of the kept conversations as one text with role marks.

    A null role renders as `unknown`, a null text as nothing.
    """
    before, behind = open_mark.split("{}")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(behind), F.coalesce("text", F.lit("")), F.lit("\n" + close_mark))
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id")
    rows = rows.withColumn("line", line)
    grouped = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct(*[F.struct(F.col(c).isNotNull().alias("there"), F.col(c)).alias(c) for c in ("turn", "role", "text")], "line"))).alias("lines"))
    return grouped.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered. One conversation is the unit of work, as its result is one text.

    Very long texts are carried whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return render(turns, collapse_snapshots(turns))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY place) AS turns, count(*) AS n_turns,
         string_agg('<|' || coalesce(role, 'unknown') || E'|>\n' || coalesce(text, '') || E'\n<|end|>\n', '' ORDER BY place) AS chat
  FROM placed GROUP BY conv_id
)
SELECT a.conv_id, a.n_turns, a.chat FROM whole a
WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE (b.n_turns > a.n_turns AND b.turns[:a.n_turns] = a.turns)
                                           OR (b.turns = a.turns AND b.conv_id < a.conv_id))
"""
