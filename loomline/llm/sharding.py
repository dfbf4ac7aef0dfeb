"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import stable_key, table, written

#: Fixed values of the published jump hash: the multiplier of its generator.
JUMP_MULTIPLIER = 2862933555777941757

#: Equal rows that one task may give their slots.
EQUAL_ROWS = 1 << 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. Growing `shards` by one moves only keys that go to the new shard."""
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = np.floor((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def jump_shard(key, shards: int):
    """Column: the shard of a long key."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return place(key)


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row placed by the law `key`.

    The id alone (and the number of shards) decides; rows with one id share a shard, a null id counts as the
    word null, a null text has size 8 and the crc32 of no bytes (0). Slots number a shard's rows without gaps: rows fall
    into `slot_buckets` hash buckets per shard, each numbered on its own and shifted by the counts of the
    buckets before it, so that no shard is sorted in one task. Equal rows are one row with a number until they get their slots, so that many of
    them are no load for a task; more than EQUAL_ROWS are dealt to several. Very long texts are measured in place and never shuffled. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        stable_key(F.col(id_col)).alias("key"),
    )
    placed = base.select(
        "doc_id", "size", "text_crc32",
        F.pmod(stable_key(F.col("doc_id"), F.col("size"), F.col("text_crc32")), F.lit(slot_buckets)).alias("bucket"),
        jump_shard(F.col("key"), shards).alias("shard"),
        jump_shard(F.col("key"), shards + 1).alias("grown_shard"),
    )
    keys = ["shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard"]
    groups = written(placed.groupBy(*keys).agg(F.count("*").alias("n")), "shards")
    counts = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = groups.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(offsets), ["shard", "bucket"])  # at most shards * slot_buckets rows
    first = ranked.select(*keys, "n", (F.col("before") + F.col("upto") - F.col("n")).alias("first"))
    block = first.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL_ROWS))))
    block = block.withColumn("last", F.least(F.col("n"), (F.col("block") + 1) * EQUAL_ROWS) - 1)
    few, many = block.filter(F.col("n") <= EQUAL_ROWS), block.filter(F.col("n") > EQUAL_ROWS).repartition("block", "doc_id", "text_crc32")
    rows = few.union(many).withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("block") * EQUAL_ROWS, F.col("first") + F.col("last"))))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def with_shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with each row's shard, without a shuffle; a column of that name is replaced."""
    return docs.withColumn(name, jump_shard(stable_key(F.col(id_col)), shards))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


_MD5_KEY = "('0x' || substr(md5({}), 1, 15))::BIGINT"

OP2_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
), base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         strlen(coalesce(text, '')) + 8 AS size,
         {_MD5_KEY.format("coalesce(doc_id::VARCHAR, 'null')")} AS key
  FROM documents
), sums AS (
  SELECT rid, doc_id, size, key,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]))) AS text_crc32
  FROM base, crc_table
), walk AS (
  SELECT rid, n, key::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM base, (VALUES (24), (25)) v(n)
  UNION ALL
  SELECT rid, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < n)
), ends AS (
  SELECT rid, max(b) FILTER (WHERE n = 24) AS shard, max(b) FILTER (WHERE n = 25) AS grown_shard FROM walk GROUP BY rid
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY {_MD5_KEY.format("concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), size, text_crc32)")} % 1024, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM sums JOIN ends USING (rid)
"""
