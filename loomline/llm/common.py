"""Helpers shared by the operators: written intermediate tables, numbering, stable keys, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.scratch import stored
from loomline.functions.sizing import broadcast_if_small

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read again after executors are lost, never computed twice."""
    return stored(df, tag)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df (a written table) with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffled join."""
    return broadcast_if_small(df, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_key(*cols: Column) -> Column:
    """60 bits of an md5 over the columns' text; the same in any SQL engine. Null counts as the word null."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def crc_part(col: Column) -> Column:
    """crc32 of the column's text modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % 4


def lower_ascii(col: Column) -> Column:
    """Lower-cases A to Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def numbered(df: DataFrame, order: list[Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Rows numbered from 0 in the given order, and running sums (new name to column, the row itself included), without a
    single-task sort: range partitions, then offsets.

    Only one count and sum per range partition are gathered (in a window over those), never rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    totals = {"_n": F.lit(1), **{f"_of_{k}": F.col(c) for k, c in (sums or {}).items()}}
    held = parts.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before{k}") for k in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumns({f"_to{k}": F.sum(c).over(within) for k, c in totals.items()}).join(F.broadcast(offsets), "_part")  # one row per partition
    upto = {k: F.col(f"_before{k}") + F.col(f"_to{k}") for k in totals}
    return ranked.select(*df.columns, (upto["_n"] - 1).cast("long").alias(name), *[upto[f"_of_{k}"].alias(k) for k in sums or {}])
