"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import crc_part, table
from loomline.llm.textscan import LOWER, SLICE, as_bytes, row_slices

#: About so many rows are drawn, by a hash of the id, to fit the model on; all where there are fewer.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 15
#: Lengths of the n-grams in bytes of UTF-8.
SIZES = (2, 3, 4)
#: Languages of a model at most: it is broadcast, at BUCKETS floats a language.
MOST_LANGS = 1000
UNKNOWN = "und"
SMOOTHING = 0.5

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD = _FOLD[LOWER]


def grams(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of rows lo to hi, and their rows, in parts of about SLICE bytes, however long a row is.

    Bytes that are no letters count as a space; A to Z are lower-cased. An n-gram lies in one row; one of two spaces or more at its
    start is left out, so gaps of any length count alike.
    """
    begin, end = int(offsets[lo]), int(offsets[hi])
    for at in range(begin, end, SLICE):
        stop = min(at + SLICE + max(SIZES) - 1, end)
        text = _FOLD[data[at:stop]].astype(np.uint32)
        row = np.repeat(np.arange(hi - lo), np.diff(np.clip(offsets[lo : hi + 1], at, stop)))
        buckets, rows = [], []
        for n in SIZES:
            places = min(len(text) - n + 1, SLICE)
            if places <= 0:
                continue
            code = np.zeros(places, np.uint32)
            for i in range(n):
                code = (code << np.uint32(8)) | text[i : places + i]
            good = (row[:places] == row[n - 1 : places + n - 1]) & ~((text[:places] == 0x20) & (text[1 : places + 1] == 0x20))
            code = (code[good] + np.uint32(n)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            buckets.append(((code * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.int32))
            rows.append(row[:places][good])
        if buckets:
            yield np.concatenate(buckets), np.concatenate(rows)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.log_p = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))  # bucket, language
        self.prior = np.log(docs / docs.sum())

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        """The likeliest language of each text (ties: the first by name) and its posterior probability.

        Rows and n-gram buckets make a sparse count matrix; its product with the log-probabilities are the scores.
        """
        data, offsets = as_bytes(column)
        score = np.tile(self.prior, (len(column), 1))
        for lo, hi in row_slices(offsets):
            for bucket, row in grams(data, offsets, lo, hi):
                cell = np.sort(row * BUCKETS + bucket)
                first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(cell)))
                at, column_of = cell[first] // BUCKETS, cell[first] % BUCKETS
                for k in range(len(self.langs)):
                    score[lo:hi, k] += np.bincount(at, count * self.log_p[column_of, k], hi - lo)
        best = score.argmax(1)
        share = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        return [self.langs[i] for i in best], share.tolist()


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> Model | None:
    """Fitted on rows with a language and a text whose crc32(doc_id as text) mod 4 is not 2; None if there are none.

    Rows are drawn by a threshold on a hash of the id, so the draw takes one count and no sort. Counts by
    (language, bucket) are summed on the executors; the model is languages x BUCKETS numbers.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_part(F.col("doc_id")) != 2))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1))) if n > sample_rows else F.lit(True)
    rows = rows.filter(draw).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                own = batch.column(1).filter(pa.array(langs == lang))
                data, offsets = as_bytes(own)
                held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] = seen.get(lang, 0) + len(own)
                for lo, hi in row_slices(offsets):
                    for bucket, _ in grams(data, offsets, lo, hi):
                        held += np.bincount(bucket, minlength=BUCKETS)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1).astype(np.int32), "n": np.append(held[at], seen[lang])})

    names = rows.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if names > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages; is this the language column?")
    parts = rows.mapInArrow(count, "lang string, bucket int, n long")
    counted = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    if not langs:
        return None
    at = {lang: i for i, lang in enumerate(langs)}
    which = np.array([at[x] for x in counted.column("lang").to_pylist()])
    bucket, number = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    counts, texts = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    texts[which[bucket < 0]] = number[bucket < 0]
    counts[which[bucket >= 0], bucket[bucket >= 0]] = number[bucket >= 0]
    return Model(langs, counts, texts)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. A text that is null or has no letter gives `und` and 0, as every text does without a model.

    Very long texts are scored whole, in parts. Ties go to the first language by name; repeated rows are scored each. An empty table gives an empty result. Extra columns pass through, but for those named lang_pred and score, which are replaced.
    """
    rest = docs.drop("lang_pred", "score")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            langs, scores = shared.value.predict(column) if shared.value else ([UNKNOWN] * len(column), [0.0] * len(column))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = rest.mapInArrow(run, schema)
    return out.withColumn("lang_pred", F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(lettered, F.col("score")).otherwise(0.0))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(lettered, F.col("text")).alias("text"))
    return identify(rows, train(docs)).select("doc_id", (crc_part(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
