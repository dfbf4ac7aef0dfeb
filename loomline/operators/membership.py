"""A stored Bloom filter of known keys: what it rules out is new without a join; only possible hits meet the exact one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.scratch import stored
from loomline.functions.sizing import broadcast_if_small, is_small

#: Bits of a block (what bitmap_construct_agg holds), bits a key, bits that a key sets: 0.7 % of unknown keys pass a full filter.
BLOCK_BITS, BITS_A_KEY, HASHES, SEED = 1 << 15, 12, 4, 17
#: A filter up to this size is broadcast (44 million keys); without one that fits, the exact join sees all rows. Keys that may be broadcast.
FILTER_BYTES, BROADCAST_KEYS = 64 << 20, 1_000_000


def _block(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.col("blocks")).cast("int")


def _places(keys: list[str]) -> list[Column]:
    """The bits of a key in its block: 15 bits each of one hash."""
    mark = F.xxhash64(F.lit(SEED + 1), *keys)
    return [F.shiftrightunsigned(mark, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(HASHES)]


def _keyed(rows: DataFrame, keys: list[str]) -> Column:
    """Whether no key column is null; a null equals nothing, so such rows are never known."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def key_filter(held: DataFrame, keys: list[str], part: Column | None = None) -> DataFrame:
    """part, block, blocks, bits: a Bloom filter of the distinct keys of `held`, apart for each part (all are part 0 by default).

    A part has as many blocks of BLOCK_BITS bits as its keys need. Keys are dealt out by block before bits are set, so a key moves once
    and no half-filled block does. Keys with a null are left out. No keys give no rows.
    """
    known = stored(held.filter(_keyed(held, keys)).select((F.lit(0) if part is None else part).cast("int").alias("part"), *keys).distinct(), "keys")
    sizes = known.groupBy("part").agg(F.ceil(F.count("*") * BITS_A_KEY / BLOCK_BITS).cast("int").alias("blocks"))
    placed = known.join(F.broadcast(sizes), "part").select("part", "blocks", _block(keys).alias("block"), F.array(*_places(keys)).alias("at"))  # one row a part
    return placed.repartition("part", "block").select("part", "block", "blocks", F.explode("at").alias("at")).groupBy("part", "block", "blocks").agg(F.bitmap_construct_agg("at").alias("bits"))


def fits(known: DataFrame | None) -> bool:
    """Whether there is a filter and it may be broadcast."""
    return known is not None and is_small(known.select("block"), FILTER_BYTES * 8 // BLOCK_BITS)


def possibly_known(rows: DataFrame, keys: list[str], known: DataFrame, name: str, part: Column | None = None) -> DataFrame:
    """rows with a boolean column `name`: false where the filter holds no such key, for sure; true where it may. No exchange of the rows; `known` must pass fits()."""
    sizes = known.select(F.col("part").alias("_part"), "blocks").distinct()
    found = rows.withColumn("_part", (F.lit(0) if part is None else part).cast("int")).join(F.broadcast(sizes), "_part", "left").withColumn("_block", _block(keys))  # fewer rows than the filter
    blocks = known.select(F.col("part").alias("_part"), F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    byte = lambda at: F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = _keyed(rows, keys)
    for at in _places(keys):
        hit = hit & (F.getbit(byte(at), at.bitwiseAND(7).cast("int")) == 1)
    return found.join(F.broadcast(blocks), ["_part", "_block"], "left").withColumn(name, F.coalesce(hit, F.lit(False))).select(*rows.columns, name)


def absent(rows: DataFrame, held: DataFrame, keys: list[str], known: DataFrame | None = None, part: Column | None = None) -> DataFrame:
    """The rows whose keys `held` lacks; exactly rows left-anti held.

    With a filter of held's keys (key_filter, made over the same parts) rows it rules out pass at once. The distinct keys of the others are looked up in `held`, whose rows do not move
    where those keys are few enough to be broadcast; rows move only if more than BROADCAST_KEYS of them are found, and then possible hits alone. Without a filter that fits: a plain anti-join.
    Rows with a null key are absent. The filter works on hashes, so it is used only where both sides' keys have the same type, and none that has several forms of one value (floats).
    """
    ours, theirs = dict(rows.dtypes), dict(held.dtypes)
    if any(ours[k] != theirs[k] or ours[k] in ("float", "double") for k in keys) or not fits(known):
        return rows.join(held.select(*keys), keys, "left_anti")
    marked = possibly_known(rows, keys, known, "_maybe", part)
    hits = stored(marked.filter("_maybe").select(*keys).distinct(), "hits")
    found = stored(held.select(*keys).join(broadcast_if_small(hits, BROADCAST_KEYS), keys, "left_semi").distinct(), "found")
    if is_small(found, BROADCAST_KEYS):
        return rows.join(F.broadcast(found), keys, "left_anti")
    return marked.filter("not _maybe").unionByName(marked.filter("_maybe").join(found, keys, "left_anti")).drop("_maybe")
