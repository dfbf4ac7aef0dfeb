"""Index tables: postings, vectors, incremental work and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.scratch import bucketed, stored
from loomline.functions.sizing import spread
from loomline.functions.text import tokenize
from loomline.operators.membership import absent

Encoder = Callable[[list[str]], np.ndarray]


#: Documents of a block of postings, blocks of a slice of a term (so that no bucket holds all of a frequent one), and buckets at most.
BLOCK_DOCS, SLICE_BLOCKS, BUCKETS = 1024, 64, 4096
#: Distinct terms of queries that are sent to the documents, and their bytes; terms of documents that a task counts at once.
ASKED_TERMS, ASKED_BYTES, COUNT_TERMS = 4_000_000, 64 << 20, 250_000
#: Terms up to which their document counts are broadcast.
BROADCAST_COUNTS = 500_000


def term_counts(terms: Column) -> Column:
    """term and tf of each distinct term of an array, counted as runs of the sorted array: no shuffle and no row a term."""
    whole = F.sort_array(terms)  # array_sort compares by an interpreted function
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
    runs = lambda s, at: F.transform(at, lambda i, j: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - i).alias("tf")))
    counted = lambda s: F.element_at(F.transform(F.array(starts(s)), lambda at: runs(s, at)), 1)
    return F.when(F.size(terms) > 0, F.element_at(F.transform(F.array(whole), counted), 1))


def postings_of(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, block, key, tf, dl: a row a posting of a table of blocks; further columns stay."""
    rest = [c for c in blocks.columns if c not in ("postings", "max_tf", "min_dl", "n", "cf")]
    return blocks.select(*rest, F.inline("postings")).withColumnRenamed("key", key)


def keyword_index(docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """blocks (term, slice, block, postings, max_tf, min_dl, n, cf), terms (term, df, max_tf, min_dl, cf), corpus (n, avgdl, blocks), postings (term, key, tf, dl).

    A document's terms are counted in its row; one exchange deals them by term and slice, and a block gathers the postings of a term in some BLOCK_DOCS
    documents that a hash of the key chooses, with what bounds their scores: the largest tf and the least length. Blocks are written once, bucketed
    by term (and slice, where a term has more than SLICE_BLOCKS blocks), so later jobs join them without an exchange. Rows of one key count as one document, whose length for a term is that of the rows that hold it.
    Documents without a term still count in n and avgdl. `postings` unfolds the blocks.
    """
    docs = spread(docs)
    n, keys, nulls = docs.agg(F.count("*"), F.count_distinct(key), F.count_if(F.col(key).isNull())).first()
    blocks = max(1, -(-n // BLOCK_DOCS))
    slices = max(1, blocks // SLICE_BLOCKS)
    buckets = min(BUCKETS, max(docs.sparkSession.sparkContext.defaultParallelism, blocks // 8))
    by = ["term", "slice"] if slices > 1 else ["term"]

    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    terms = docs.select(F.col(key).alias("key"), block.alias("block"), tokenize(F.coalesce("text", F.lit(""))).alias("terms"))
    counted = terms.select("key", "block", F.size("terms").alias("dl"), term_counts(F.col("terms")).alias("counts"))
    # inline_outer: for the inner form the optimizer filters on the whole expression, which would count every text several times
    rows = counted.select("key", "block", "dl", F.inline_outer("counts")).filter("term is not null").withColumn("slice", F.col("block") % slices).repartition(buckets, *by)
    merged = rows.groupBy("term", "slice", "block", "key").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl"))
    if n == keys + min(nulls, 1):  # a row a key: nothing to merge
        merged = rows.select("term", "slice", "block", "key", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))
    packed = merged.groupBy("term", "slice", "block").agg(F.collect_list(F.struct("key", "tf", "dl")).alias("postings"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count("*").alias("n"), F.sum("tf").alias("cf"))
    stored_blocks = bucketed(packed, "blocks", buckets, by, ["term", "block"])
    terms = stored(stored_blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.sum("cf").alias("cf")), "terms")
    corpus = terms.agg(F.lit(n).cast("long").alias("n"), (F.coalesce(F.sum("cf"), F.lit(0)) / F.lit(max(n, 1))).alias("avgdl"), F.lit(blocks).alias("blocks"))
    return {"blocks": stored_blocks, "terms": terms, "corpus": corpus, "postings": postings_of(stored_blocks, key).select("term", key, "tf", "dl")}


def _counts_of(names: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, dl, codes, tfs of documents (doc_id, terms): how often each holds which of the names."""
    terms = batch.column("terms")
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    codes = pc.index_in(terms.flatten(), names.cast(terms.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
    pairs, tf = np.unique(doc * len(names) + codes[codes >= 0], return_counts=True)
    doc, code = np.divmod(pairs, max(len(names), 1))
    ends = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code, tf)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *lists], ["doc_id", "dl", "codes", "tfs"])


def counted(names: pa.Array, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _counts_of(), over batches, some COUNT_TERMS terms at a time: every call looks over all names."""
    for batch in batches:
        step = max(1, batch.num_rows * COUNT_TERMS // max(len(batch.column("terms").flatten()), 1))
        for lo in range(0, batch.num_rows, step):
            yield _counts_of(names, batch.slice(lo, step))


def asked_index(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """For a search of all `docs` by these `queries` alone: rows (key, dl, codes, tfs), terms (term, code, df), corpus (n, avgdl).

    A document stays a row, with its length over all terms and its counts of the terms that some query asks for; no posting is moved or sorted, so a task holds one batch. The distinct terms of
    the queries, ASKED_TERMS and ASKED_BYTES at most, are sent to the documents. Where there are more, or where rows share a key, this is the keyword_index.
    """
    words = stored(queries.select(F.explode(F.array_distinct(tokenize(F.coalesce("text", F.lit(""))))).alias("term")).distinct(), "words")
    count, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if count > ASKED_TERMS or size > ASKED_BYTES:
        return keyword_index(docs, key)
    spark = docs.sparkSession
    names = words.orderBy("term").toArrow().column("term").combine_chunks()
    shared = spark.sparkContext.broadcast(names)

    texts = spread(docs.select(F.col(key).alias("doc_id"), "text")).select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("terms"))
    rows = stored(texts.mapInArrow(lambda batches: counted(shared.value, batches), f"doc_id {dict(docs.dtypes)[key]}, dl long, codes array<int>, tfs array<int>"), "rows")
    n, keys, nulls, total = rows.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if n != keys + min(nulls, 1):
        return keyword_index(docs, key)
    coded = spark.createDataFrame(pa.table({"term": names, "code": pa.array(np.arange(len(names), dtype=np.int32))}), "term string, code int")
    df = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    terms = stored(coded.join(F.broadcast(df) if count <= BROADCAST_COUNTS else df, "code"), "terms")
    corpus = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total / max(n, 1)).alias("avgdl"))
    return {"rows": rows, "terms": terms, "corpus": corpus}


def new_chunks(chunks: DataFrame, index: DataFrame, model: str, cap: int, force: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Chunks whose id the index does not hold under the same configuration; all with force. known: a key_filter of those ids, which spares the join what it rules out."""
    if force:
        return chunks
    return absent(chunks, index.filter((F.col("embedding_model") == model) & (F.col("max_words") == cap)), ["id"], known)


#: What a chunk is known by in an index.
CHUNK_KEYS = {"id": "id", "_held": "xxhash64(text)"}


def changed_chunks(chunks: DataFrame, index: DataFrame, known: DataFrame | None = None, part: Column | None = None) -> DataFrame:
    """Chunks that are new or whose text differs from the indexed one. known, part: a key_filter over CHUNK_KEYS and what its parts are."""
    held = index.selectExpr(*[f"{e} AS {name}" for name, e in CHUNK_KEYS.items()])
    return absent(chunks.withColumn("_held", F.expr(CHUNK_KEYS["_held"])), held, [*CHUNK_KEYS], known, part).drop("_held")


def upsert_by_id(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row per id: the new table's where it has one. Applying the same rows twice changes nothing."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_v")]
    order = Window.partitionBy(key).orderBy(F.desc("_v"), *[F.col(c).asc_nulls_last() for c in columns if not dict(both.dtypes)[c].startswith(("map", "variant"))])
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_v")


def hashing_encoder(dims: int = 64, scaled: bool = True) -> Encoder:
    """Offline default: signed hashing of terms, scaled to norm 1 unless the sums themselves are asked for. Any function from texts to a matrix can take its place."""
    import re
    import zlib

    term = re.compile(r"[a-z0-9']+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            for t in term.findall((text or "").lower()):
                h = zlib.crc32(t.encode())
                out[i, h % dims] += 1.0 if h & 0x10000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9) if scaled else out

    return encode


def embed_texts(rows: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder, batch: int = 32) -> DataFrame:
    """rows with vector. The encoder is made once per worker and called on batches of texts; order is kept."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "vector") + ", vector array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in batches:
            texts = frame["text"].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in encode(texts[at : at + batch])]
            yield frame.assign(vector=[v.astype(np.float32) for v in vectors])

    return rows.drop("vector").mapInPandas(run, schema)
