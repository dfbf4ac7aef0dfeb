"""Vectors of texts, encoded once and kept: a run that stops goes on where it was, and later runs encode only what is new."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.scratch import stored
from loomline.functions.sizing import broadcast_if_small
from loomline.operators.index import Encoder, embed_texts, hashing_encoder
from loomline.sources import snapshots

#: Characters of texts of a wave, after which what is encoded counts as finished; digests that may be broadcast.
WAVE_CHARS, BROADCAST_DIGESTS = 2_000_000_000, 1_000_000


def text_digest(text="text"):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def dealt_by_length(rows: DataFrame, parts: int) -> DataFrame:
    """rows (with chars) in `parts` partitions of about as many characters: every partition deals its rows out in order of length."""
    in_order = rows.sortWithinPartitions(F.desc("chars")).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.shiftright("_at", 33)
    return in_order.withColumn("_part", (place % parts).cast("int")).drop("_at").repartitionByRange(parts, "_part").drop("_part")


def encode_into(rows: DataFrame, path: str, make_encoder: Callable[[], Encoder] = hashing_encoder, model: str = "hashing-64", batch: int = 32, wave_chars: int = WAVE_CHARS, parts: int | None = None) -> int:
    """Encodes every text of `rows` that the store at `path` has no vector of under `model`, and returns how many those were.

    Equal texts are one text, known by its digest. What is missing is dealt into waves by digest; a wave is encoded in partitions of about equal length, written to a folder of its own and then named in the
    store's manifest with its number of texts. A run that stops loses the wave at hand alone; the next one encodes what no finished wave has. A null text counts as the empty one.
    """
    spark = rows.sparkSession
    digest = text_digest()
    texts = rows.select(digest.alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    done = snapshots.read_snapshot(spark, path, model=model)
    if done is not None:
        texts = texts.join(broadcast_if_small(done.select("digest"), BROADCAST_DIGESTS), "digest", "left_anti")
    missing = stored(texts.groupBy("digest").agg(F.first("text").alias("text")).withColumn("chars", F.length("text")), "missing")
    n, chars = missing.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    waves = max(1, -(-chars // wave_chars))
    parts = parts or spark.sparkContext.defaultParallelism
    for wave in range(waves if n else 0):
        mine = missing.filter(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
        folder = f"data/{uuid.uuid4().hex}"
        embed_texts(dealt_by_length(mine, parts), make_encoder, batch).select("digest", "vector").write.parquet(f"{path}/{folder}")
        version = snapshots.last_version(spark, path)
        snapshots.commit(spark, path, [*snapshots.entries(spark, path, version), {"model": model, "folder": folder}], version)
    return n


def with_vectors(rows: DataFrame, path: str, model: str = "hashing-64") -> DataFrame:
    """rows with vector, from the store; rows whose text it lacks go."""
    known = snapshots.read_snapshot(rows.sparkSession, path, model=model)
    if known is None:
        return rows.withColumn("vector", F.lit(None).cast("array<float>")).limit(0)
    return rows.withColumn("_digest", text_digest()).join(known.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest")


def update_index(chunks: DataFrame, path: str, make_encoder: Callable[[], Encoder] = hashing_encoder, model: str = "hashing-64", max_words: int = 500, buckets: int = 64) -> int:
    """Brings the vector index at `path` up to date with `chunks` (id, text, ...): encodes the texts it has no vector of, puts new and changed chunks over the old ones, and returns the version that readers see.

    Vectors are kept under path/vectors by text, chunks under path/chunks in buckets by id, each with a filter of its ids and texts that spares most new chunks the lookup; chunks of another model or size stay beside these.
    """
    from loomline.operators.index import CHUNK_KEYS, changed_chunks

    spark = chunks.sparkSession
    held = read_vector_index(spark, path, model, max_words)
    known, parts = snapshots.read_filter(spark, f"{path}/chunks", model=model, max_words=max_words)
    fresh = stored(chunks if held is None else changed_chunks(chunks, held, known, snapshots.bucket_of("id", parts) if parts else None), "fresh")
    encode_into(fresh, f"{path}/vectors", make_encoder, model)
    return snapshots.upsert(with_vectors(fresh, f"{path}/vectors", model), f"{path}/chunks", "id", buckets, CHUNK_KEYS, model=model, max_words=max_words)


def read_vector_index(spark, path: str, model: str, max_words: int, version: int | None = None) -> DataFrame | None:
    """The chunks of one configuration with their vectors, as of a version; None where there are none."""
    return snapshots.read_snapshot(spark, f"{path}/chunks", version, model=model, max_words=max_words)
