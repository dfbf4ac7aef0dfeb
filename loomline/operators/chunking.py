"""Greedy packing of segments into word-capped batches and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import word_count


def _folded(batches: Iterator[pa.RecordBatch], keys: list[str], cap: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of rows in order of keys and pos, with the pack of each row."""
    group, pack, total, empty = None, 1, 0, True
    for batch in batches:
        packs = []
        for key, w in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column("words").to_pylist(), strict=True):
            if key != group:
                group, pack, total, empty = key, 1, 0, True
            if not empty and total + w > cap:
                pack, total = pack + 1, 0
            packs.append(pack)
            total, empty = total + w, False
        yield batch, packs


def greedy_pack(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """rows (with pos and words) with pack, from 1: a pack ends before the row that would take it over `cap`; a larger row stands alone.

    Rows stream through one fold in order of keys and pos; the state is the running sum of the group at hand, so no group is held in memory.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("pack", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, packs in _folded(batches, keys, cap):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int32())], names=[*batch.schema.names, "pack"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "pos", "words").mapInArrow(fold, schema)


def batch_segments(segments: DataFrame, cap: int = 2500) -> DataFrame:
    """segments with words and batch (from 0) inside their chapter."""
    packed = greedy_pack(segments.withColumn("words", word_count(F.col("text"))), ["episode", "chapter_index"], cap)
    return packed.withColumn("batch", F.col("pack") - 1).drop("pack")


def _joined(packs: pa.Table) -> pa.RecordBatch:
    """A row for each pack of a table of whole packs: lines (by pos, timestamp and line) joined, the first and last line's time."""
    packs = packs.take(pc.sort_indices(packs, sort_keys=[("_run", "ascending"), ("pos", "ascending"), ("timestamp", "ascending"), ("line", "ascending")], null_placement="at_start"))
    run = packs.column("_run").to_numpy()
    first = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    last = np.append(first[1:], len(run)) - 1
    lines = pa.ListArray.from_arrays(pa.array(np.append(first, len(run)).astype(np.int32)), packs.column("line").combine_chunks())
    heads, times = packs.take(pa.array(first)), packs.column("timestamp")
    made = {c: heads.column(c) for c in ("episode", "chapter_index", "chapter")} | {"pack": heads.column("_pack")}
    made |= {"start_ts": heads.column("timestamp"), "end_ts": times.take(pa.array(last)), "text": pc.binary_join(lines, "\n"), "before": heads.column("_before"), "guest": heads.column("_guest")}
    return pa.table(made).combine_chunks().to_batches()[0]


def _chunks_of(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of rows in order of chapter and pos, a chapter's head first; only the pack at hand is held."""
    keys, heads = ["episode", "chapter_index"], {}
    held, run, last, before, guest = [], 0, None, 0, None

    def texts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.filter(batch.column("head"))
            for key, n, name in zip(zip(*[head.column(k).to_pylist() for k in keys], strict=True), head.column("words").to_pylist(), head.column("line").to_pylist(), strict=True):
                heads[key] = n, name
            yield batch.filter(pc.invert(batch.column("head")))

    for batch, packs in _folded(texts(), keys, cap):
        runs, befores, guests = [], [], []
        for here in zip(*[batch.column(k).to_pylist() for k in keys], packs, strict=True):
            if here != last:
                if last is None or here[:2] != last[:2]:
                    before, guest = heads.pop(here[:2], (0, None))
                run, last = run + 1, here
            runs.append(run)
            befores.append(before)
            guests.append(guest)
        made = {c: batch.column(c) for c in ("episode", "chapter_index", "chapter", "pos", "timestamp", "line")}
        made |= {"_pack": pa.array(packs, pa.int32()), "_run": pa.array(runs, pa.int64()), "_before": pa.array(befores, pa.int64()), "_guest": pa.array(guests, pa.string())}
        held.append(pa.table(made))
        whole = pa.concat_tables(held)
        open_from = int(np.searchsorted(whole.column("_run").to_numpy(), run))
        held = [whole.slice(open_from)]
        if open_from:
            yield _joined(whole.slice(0, open_from))
    if held and held[0].num_rows:
        yield _joined(pa.concat_tables(held))


def chunk_segments(segments: DataFrame, guests: DataFrame, cap: int = 500) -> DataFrame:
    """Chunks: id, episode, guest, chapter, chapter_index, start_ts, end_ts (the last segment's start), text.

    Packs of a chapter are chunks; their number runs through the episode in order of chapter and pack. A line without a speaker is Unknown's, one without text is empty.
    Segments without an episode or chapter belong to no chunk; keyless_segments() has them.

    Rows without their text are packed first and tell how many chunks an episode has before each chapter. That and the guest go into a head row that is sorted before the chapter's own rows, so a text moves once, and chunks come out of the fold that packs.
    """
    rows = segments.filter("episode is not null and chapter_index is not null").withColumn("words", word_count(F.col("text")))
    keys = ["episode", "chapter_index"]
    sizes = greedy_pack(rows.select(*keys, "pos", "words"), keys, cap).groupBy(*keys).agg(F.max("pack").alias("packs"))
    earlier = Window.partitionBy("episode").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.withColumn("before", F.coalesce(F.sum("packs").over(earlier), F.lit(0))).join(guests.select("episode", "guest"), "episode", "left")

    kinds = dict(rows.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    line = F.concat(F.coalesce("speaker", F.lit("Unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    heads = heads.select(*keys, null("chapter"), null("pos"), null("timestamp"), F.col("before").cast("long").alias("words"), F.col("guest").cast("string").alias("line"), F.lit(True).alias("head"))
    both = rows.select(*keys, "chapter", "pos", "timestamp", "words", line.alias("line"), F.lit(False).alias("head")).unionByName(heads)
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, F.desc("head"), "pos", "words")
    schema = f"episode {kinds['episode']}, chapter_index {kinds['chapter_index']}, chapter {kinds['chapter']}, pack int, start_ts {kinds['timestamp']}, end_ts {kinds['timestamp']}, text string, before long, guest string"
    packed = dealt.mapInArrow(lambda batches: _chunks_of(batches, cap), schema)
    name = F.format_string("%s-%02d-%03d", F.col("episode").cast("string"), "chapter_index", F.col("before") + F.col("pack"))
    return packed.select(name.alias("id"), "episode", "guest", "chapter", "chapter_index", "start_ts", "end_ts", "text")


def keyless_segments(segments: DataFrame) -> DataFrame:
    """The segments that no chunk can hold, for want of an episode or chapter."""
    return segments.filter("episode is null or chapter_index is null")
