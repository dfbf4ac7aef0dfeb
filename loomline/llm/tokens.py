"""Token counts of a unigram vocabulary without making tokens: Aho-Corasick matches and a count-only Viterbi."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import table
from loomline.llm.textscan import Words, as_bytes, row_slices

#: Default vocabulary file, a parameter of every call.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of unigram tokenizers: the mark that stands for a space, and what an unknown character scores below the least piece.
SPACE_MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker keeps, and the longest word in bytes that it keeps.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and log-probabilities from a sentencepiece file. The file is a merge list, whose scores are ranks and no
    log-probabilities; a piece of rank r gets those of Zipf's law, -ln(r + 2). Control and byte pieces stay out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), -math.log(rank + 2)) for rank, i in enumerate(plain)]


class Counter:
    """Piece counts of single words, by the tie rules of unigram tokenizers.

    The best score at a place wins; on equal scores the piece that begins first (the longest). A character
    without a piece of its own may be an unknown, and unknowns in a row count as one.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word after its space mark. Only as many places are kept as the longest piece has characters, however long the word is."""
        text = SPACE_MARK + word
        n, ring = len(text), min(len(text), self.longest) + 1
        best, pieces, unknown = [0.0] * ring, [0] * ring, [False] * ring
        at, top, count, single = 1, -math.inf, 0, False  # place behind the piece, best score and count there, a one-character piece ends there
        ends = self.automaton.iter(text) if len(self.automaton) else iter(())  # by end, the longest first
        last, (length, score) = next(ends, (n, (0, 0.0)))
        while at <= n:
            while last < at:
                begin = (at - length) % ring
                value = best[begin] + score
                if value > top:
                    top, count = value, pieces[begin] + 1
                if length == 1:
                    single = True
                last, (length, score) = next(ends, (n, (0, 0.0)))
            before, here = (at - 1) % ring, at % ring
            lone = not single and best[before] + self.unknown > top
            if lone:
                top, count = best[before] + self.unknown, pieces[before] + (not unknown[before])
            best[here], pieces[here], unknown[here] = top, count, lone
            at, top, single = at + 1, -math.inf, False
        return pieces[n % ring]

    def count_bytes(self, word: bytes) -> int:
        if len(word) > CACHE_BYTES:
            return self.count(word.decode())
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            got = self.cache[word] = self.count(word.decode())
        return got

    def totals(self, column: pa.Array) -> np.ndarray:
        """Pieces of each text: of its words, each counted once per slice of rows."""
        data, offsets = as_bytes(column)
        out = np.zeros(len(column), np.int64)
        for lo, hi in row_slices(offsets, 1 << 22):
            words = Words(data, offsets, lo, hi, fold=False)
            if not len(words.mark):
                continue
            _, first, which = np.unique(words.mark, return_index=True, return_inverse=True)
            starts, ends = words.start[first].tolist(), words.end[first].tolist()
            counts = np.fromiter((self.count_bytes(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)), np.int64, len(first))
            out[lo:hi] += np.bincount(words.row, counts[which], hi - lo).astype(np.int64)
        return out


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text") -> DataFrame:
    """docs with n_tokens: 0 for a null text and for one without words.

    Very long texts and words count whole. Ties between pieces go by the tokenizer's rules (see Counter); repeated rows are counted each. An
    empty table gives an empty result. Extra columns pass through; one named n_tokens is replaced.
    """
    rest = docs.drop("n_tokens")
    schema = T.StructType([*rest.schema.fields, T.StructField("n_tokens", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            totals = counter.totals(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return rest.mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return count_tokens(docs, load_vocabulary()).select("doc_id", "n_tokens")
