"""Phrase collocation mining by SON partitioning: shards mined at proportionally lowered support, then exact counts of the union."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import small, table, written
from loomline.llm.textscan import LOWER, as_bytes, mix64, row_slices

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: A phrase goes where a longer one holds it in so many percent of its occurrences.
INSIDE = 100
NO_LANG = "und"
#: Shards that are mined apart: a power of two, whose number takes the low bits of a key.
SHARD_BITS = 3
SHARDS = 1 << SHARD_BITS
#: Bits a frequent phrase has in a filter, and least and largest filter (as powers of two; 128 MB at most). A fuller filter lets more through, which the exact counts then drop.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 20, 30
#: Bytes of text worked on at once, keys a task counts at once, phrases a task adds up before they leave it, rows of a batch that leaves.
SLICE, KEYS, PHRASES, ROWS = 1 << 20, 1 << 22, 1 << 20, 1 << 18
BROADCAST_LANGS = 50_000

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"]] = True
_CUT[0x0A:0x0E] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_PLACES = 64
_MARKS = [mix64(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(seed << 32)) for seed in (1, 2)]
_NEXT = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)]
_LOW = np.uint64(SHARDS - 1)


@dataclass
class Words:
    """Words of a part of the texts: row, first and last byte, whether the next word follows in the same piece, 64-bit marks (two kinds on demand), and how many words were in the part before."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    follows: np.ndarray
    marks: list[np.ndarray]
    seen: int = 0


def _scan(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, kinds: int) -> Words:
    """Words of bytes lo to hi, which neither cut a word nor (but for the rows' ends in offsets) join two."""
    part = data[lo:hi]
    word = ~_GAP[part]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    heads = offsets[(offsets > lo) & (offsets < hi)] - lo
    begins[heads] |= word[heads]
    ends[heads - 1] |= word[heads - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start + lo, "right") - 1
    piece = np.cumsum(_CUT[part])[start] if len(start) else start
    follows = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False) if len(start) else np.zeros(0, bool)
    marks = []
    if len(start):
        lengths = end - start
        first = np.cumsum(lengths) - lengths
        raw = LOWER[part[word]].astype(np.int64)
        place = np.arange(len(raw)) - np.repeat(first, lengths)
        far = np.flatnonzero(place >= _PLACES)
        index = np.minimum(place, _PLACES - 1) * 256 + raw
        for kind in range(kinds):
            terms = _MARKS[kind][index]
            terms[far] = mix64((place[far] * 256 + raw[far]).astype(np.uint64) * _NEXT[kind])
            marks.append(mix64(np.add.reduceat(terms, first)))
    else:
        marks = [np.zeros(0, np.uint64)] * kinds
    return Words(row, start + lo, end + lo, follows, marks)


def parts(data: np.ndarray, offsets: np.ndarray, kinds: int = 1, most: int = SLICE, longest: int = LONGEST) -> Iterator[Words]:
    """Words of all rows in parts of about `most` bytes. A longer row comes in parts that end at a gap and begin with the last words of the part before, so that no phrase is lost."""
    for lo, hi in row_slices(offsets, most):
        begin, end = int(offsets[lo]), int(offsets[hi])
        at, seen = begin, 0
        while at < end:
            cut = min(max(at, begin) + most, end)
            while cut < end:
                gaps = _GAP[data[cut : cut + 4096]]
                if gaps.any():
                    cut += int(gaps.argmax())
                    break
                cut = min(cut + 4096, end)
            words = _scan(data, offsets[lo : hi + 1], at, cut, kinds)
            words.row += lo
            words.seen = seen
            yield words
            if cut >= end:
                break
            kept = min(longest - 1, len(words.start))
            begin, at, seen = cut, int(words.start[-kept]) if kept else cut, kept


class Filter:
    """A bitmap of hashed phrases: says no only of what is not in it."""

    def __init__(self, bits: np.ndarray, power: int):
        self.bits, self.shift = bits, np.uint64(64 - power)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def phrases(words: Words, langs: np.ndarray, filters: list[Filter], longest: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each length up to `longest`: the first words of phrases both of whose parts (without the first, without the last word) pass the filter of their length, and their hashes (a kind each), the language in them."""
    own = langs[words.row]
    at = np.arange(len(own))
    held = [mix64(m ^ own) for m in words.marks]
    hashes = held
    for n in range(1, longest + 1):
        if n > 1:
            alive = np.zeros(len(own) + 1, bool)
            alive[at[filters[n - 2](hashes[0])]] = True
            starts = np.flatnonzero(alive[:-1] & alive[1:] & (words.follows if n == 2 else True))
            place = np.searchsorted(at, starts)
            hashes = [mix64(h[place] + m[starts + n - 1] * k) for h, m, k in zip(hashes, words.marks, _NEXT, strict=False)]
            at = starts
        yield n, at, hashes


def _prepared(docs: DataFrame) -> DataFrame:
    """text, lang, the language's hash and the shard, which the text decides."""
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.pmod(F.xxhash64(text), F.lit(SHARDS)).cast("int").alias("shard"))


def _batches(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, Words]]:
    for batch in batches:
        data, offsets = as_bytes(batch.column(0))
        langs = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        for words in parts(data, offsets, kinds):
            if len(words.start):
                yield batch, data, langs, batch.column(3).to_numpy(zero_copy_only=False), words


def count_in_shards(rows: DataFrame, length: int, filters: list[Filter]) -> DataFrame:
    """key (hash of language and phrase, the shard in its low bits), n: phrases of a length counted in each shard. The keys 0 to SHARDS - 1 have the shards' words, with length 1.

    Tasks count their own texts first; only distinct keys leave them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)  # bitmaps of at most 2**MOST_BITS bits

    def counted(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        for lo in range(0, len(key), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + ROWS].view(np.int64)), pa.array(n[lo : lo + ROWS])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, np.zeros(SHARDS, np.int64)
        for _, _, langs, shards, words in _batches(batches, 1):
            for n, at, hashes in phrases(words, langs, shared.value, length):
                if n < length:
                    continue
                new = at + n > words.seen
                own = shards[words.row[at[new]]]
                held.append(((hashes[0][new] | np.uint64(SHARDS)) & ~_LOW) | own.astype(np.uint64))
                size += len(own)
                if n == 1:
                    total += np.bincount(own, minlength=SHARDS)
            if size >= KEYS:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)
        if length == 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARDS)), pa.array(total)], names=["key", "n"])

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _filter_of(frequent: DataFrame) -> Filter:
    """The bitmap of a written table of keys, whatever their shard. It is put together on the executors; pieces of 4 KB, as many as the filter's fixed size has, reach the driver."""
    n = frequent.count()
    power = min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH - 1).bit_length()))
    place = F.shiftrightunsigned("key", 64 - power)
    pieces = frequent.groupBy(F.shiftright(place, 15).alias("piece")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).toArrow()
    bits = np.zeros((1 << power - 15, 4096), np.uint8)
    for piece, own in zip(pieces.column("piece").to_pylist(), pieces.column("bits").to_pylist(), strict=True):
        bits[piece] = np.frombuffer(own, np.uint8)
    return Filter(bits.ravel(), power)


def mine_shards(rows: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> list[Filter]:
    """The union of what is frequent in some shard, by length, as filters.

    A shard's support is the share of all words that it holds, of `support`, rounded up: a phrase with `support` occurrences in all reaches it in one shard at least.
    Each shard is mined whole, length by length; a phrase is counted only where both its parts are frequent.
    """
    filters: list[Filter] = []
    shard = F.col("key").bitwiseAND(SHARDS - 1)
    first = written(count_in_shards(rows, 1, filters), "shard_words")
    words = {r["key"]: r["n"] for r in first.filter(F.col("key").between(0, SHARDS - 1)).collect()}  # one row a shard
    total = max(1, sum(words.values()))
    least = F.array(*[F.lit(max(1, -(-support * words.get(s, 0) // total))) for s in range(SHARDS)])
    for length in range(1, longest + 1):
        counted = first.filter(~F.col("key").between(0, SHARDS - 1)) if length == 1 else count_in_shards(rows, length, filters)
        frequent = counted.filter(F.col("n") >= F.element_at(least, (shard + 1).cast("int"))).select("key")
        filters.append(_filter_of(written(frequent, f"frequent_{length}")))
    return filters


def _texts(data: np.ndarray, words: Words, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """Phrases of `length` words from word `first` on: lower-cased, one space between words."""
    which = np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
    begin, size = words.start[which], words.end[which] - words.start[which] + 1
    to = np.cumsum(size)
    source = np.repeat(begin - to + size, size) + np.arange(int(to[-1]) if len(to) else 0)
    out = LOWER[data[np.minimum(source, len(data) - 1)]]
    out[to - 1] = 0x20
    ends = to[np.cumsum(length) - 1]
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    offsets = np.append(0, ends - np.arange(1, len(ends) + 1))
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep]))


_COUNTS = pa.schema([("a", pa.uint64()), ("b", pa.uint64()), ("n", pa.int64()), ("lang", pa.large_string()), ("phrase", pa.large_string())])


def _added(counts: pa.Table) -> pa.Table:
    """One row a phrase, which a and b (128 bits of hash) tell apart, in order of a."""
    if not counts.num_rows:
        return counts
    a, b = counts.column("a").to_numpy(), counts.column("b").to_numpy()
    order = np.lexsort((b, a))
    first = np.flatnonzero(np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    n = np.add.reduceat(counts.column("n").to_numpy()[order], first)
    out = counts.take(pa.array(order[first]))
    return out.set_column(2, "n", pa.array(n))


def _packed(counts: pa.Table, power: int) -> Iterator[pa.RecordBatch]:
    """Counts in a binary value a bucket of hashes, so that they move and are added up as columns, not row by row."""
    counts = _added(counts)
    bucket = (counts.column("a").to_numpy() >> np.uint64(64 - power)).astype(np.int32)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
    for lo in range(0, len(cuts) - 1, 256):
        blobs = []
        for x, y in zip(cuts[lo : lo + 256], cuts[lo + 1 : lo + 257], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _COUNTS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(counts.slice(x, y - x).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[lo : lo + len(blobs)]]), pa.array(blobs, pa.binary())], names=["bucket", "counts"])


def count_exactly(rows: DataFrame, filters: list[Filter], support: int = SUPPORT) -> DataFrame:
    """lang, phrase, n: words and phrases with `support` occurrences or more, and each language's number of words under the empty phrase.

    Tasks add up what they find by 128-bit hash and send it packed in buckets of hashes, of which there are some for each task, so that a bucket stays small however large the corpus is.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    power = min(20, max(6, (4 * rows.rdd.getNumPartitions()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, totals = [], 0, {}
        for batch, data, langs, _, words in _batches(batches, 2):
            found = []
            for n, at, hashes in phrases(words, langs, shared.value, len(shared.value)):
                new = at + n > words.seen
                if n == 1:
                    for row, k in zip(*np.unique(words.row[at[new]], return_counts=True), strict=True):
                        own = (batch.column(1)[int(row)].as_py(), int(langs[row]))
                        totals[own] = totals.get(own, 0) + int(k)
                new &= shared.value[n - 1](hashes[0])
                order = np.argsort(hashes[0][new], kind="stable")
                at, a, b = at[new][order], hashes[0][new][order], hashes[1][new][order]
                if len(at):
                    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                    found.append((at[first], np.full(len(first), n), a[first], b[first], np.diff(np.append(first, len(at)))))
            if found:
                at, length, a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
                held.append(pa.table([pa.array(a), pa.array(b), pa.array(n), batch.column(1).take(pa.array(words.row[at])).cast(pa.large_string()), _texts(data, words, at, length)], schema=_COUNTS))
                size += len(at)
            if size >= PHRASES:  # what is alike in the parts so far is one row from here on; what is still as much leaves the task
                held = [_added(pa.concat_tables(held))]
                size = held[0].num_rows
                if size >= PHRASES // 2:
                    yield from _packed(held[0], power)
                    held, size = [], 0
        names, keys = [x for x, _ in totals], np.array([k for _, k in totals], np.uint64)
        held.append(pa.table([pa.array(keys, pa.uint64()), pa.array(np.zeros(len(names), np.uint64)), pa.array(list(totals.values()), pa.int64()), pa.array(names, pa.large_string()), pa.array([""] * len(names), pa.large_string())], schema=_COUNTS))
        yield from _packed(pa.concat_tables(held), power)

    def add(counts: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in counts.column("counts")]
        whole = _added(pa.concat_tables(parts))
        n, phrase = whole.column("n").to_numpy(), whole.column("phrase")
        often = whole.filter(pa.array((n >= support) | pc.equal(phrase, "").to_numpy()))
        return pa.table([often.column("lang").cast(pa.string()), often.column("phrase").cast(pa.string()), often.column("n")], names=["lang", "phrase", "n"])

    packed = rows.mapInArrow(run, "bucket int, counts binary")
    return packed.groupBy("bucket").applyInArrow(add, "lang string, phrase string, n long")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words with `support` occurrences; of all without `top`.

    Texts are lower-cased (A to Z) and cut into pieces and words as in the module's fixed bytes; phrases lie within a piece. A null text is empty, a null language is NO_LANG. a, l, r are the occurrences
    of the phrase and of its two parts at the lowest-scoring cut (ties: the earliest), n the words of the language. Phrases inside a longer one that has `inside` percent of
    their occurrences go. Ties in rank go by a, then by the phrase's bytes. Very long texts are read in overlapping parts and count whole; repeated rows count each; an empty table gives an
    empty result. Other columns are ignored. No cap but `top`: work in shards, filters and parts changes cost alone.
    """
    rows = _prepared(docs)
    counts = written(count_exactly(rows, mine_shards(rows, support, longest), support), "phrases")
    totals = small(counts.filter("phrase = ''").select("lang", F.col("n").alias("n")), BROADCAST_LANGS)
    known = counts.filter("phrase <> ''")
    words = F.split("phrase", " ")
    candidates = known.filter(F.contains(F.col("phrase"), F.lit(" "))).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))

    size = F.size("w")
    spans = F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))
    holders = candidates.filter(size > 2).select("lang", F.col("a").alias("held"), F.explode(F.array_distinct(F.flatten(spans))).alias("phrase"))
    held = holders.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = candidates.join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < inside * F.col("a")))

    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("right")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.k", F.col("c.left").alias("left"), F.col("c.right").alias("right"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumns({"over": (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")})
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:  # the best of parts of a language first, so that no task sorts a whole language
        salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt", "rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), known AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100
), spans AS (
  SELECT lang, f, w, unnest(range(2, k)) AS size FROM known WHERE k > 2
), holders AS (
  SELECT lang, f, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM spans
), held AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(f) AS f FROM holders GROUP BY 1, 2
), kept AS (
  SELECT c.lang, c.phrase, c.f AS a, c.w, c.k FROM known c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase WHERE c.k >= 2 AND (h.f IS NULL OR 100 * h.f < 100 * c.f)
), cuts AS (
  SELECT lang, phrase, a, w, unnest(range(1, k)) AS k FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN known l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN known r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : len(c.w)], ' ') JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM scored
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best WHERE first = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
