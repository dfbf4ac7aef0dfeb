"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make document scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import crc_part, table, written
from loomline.llm.textscan import SLICE, Words, as_bytes, code_points, row_slices

#: Bounds of the sample that the field is fitted on: rows of each label, bytes of a text (longer ones are scored, but not learned from), and how many
#: times as many labelled ids are drawn, so that ids without such a text do not use up the sample.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES, DRAW = 600, 4000, 65_536, 4
#: A document is predicted toxic from this score on.
REJECT = 0.3
#: Byte lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Features in fewer sample documents than this, or in less than this share of them, get no weight.
LEAST_DF, LEAST_SHARE = 3, 0.01
#: Passes over the sample, strength of the Gaussian prior on weights, share of a feature's (shrunk) log-odds that its weight starts from, documents that
#: shrink them, and weight of a clean document, which the sample holds fewer of than the corpus.
EPOCHS, PRIOR, START, SHRINK, CLEAN_WEIGHT = 6, 0.1, 0.5, 2.0, 1.5
BLOCK = 32
#: Bytes of a part of a long text.
PART = SLICE


def scan_chain(m: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """State vectors (scaled to sum 1) of v[t] = m[t] v[t-1] for 2x2 matrices m = (m00, m01, m10, m11), v[-1] = (1/2, 1/2).

    Products are formed inside blocks of BLOCK steps for all blocks at once, then blocks are chained by the same scan, so
    the cost does not depend on how texts are cut.
    """
    n = len(m[0])
    if n <= BLOCK:
        out = np.empty((2, n))
        a = b = 0.5
        for t in range(n):
            a, b = m[0][t] * a + m[1][t] * b, m[2][t] * a + m[3][t] * b
            s = a + b
            a, b = a / s, b / s
            out[0, t], out[1, t] = a, b
        return out[0], out[1]
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    parts = [np.concatenate([x, np.full(pad, one)]).reshape(blocks, BLOCK).T.copy() for x, one in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True)]
    for t in range(1, BLOCK):
        p = [x[t - 1] for x in parts]
        q = [x[t].copy() for x in parts]
        new = (q[0] * p[0] + q[1] * p[2], q[0] * p[1] + q[1] * p[3], q[2] * p[0] + q[3] * p[2], q[2] * p[1] + q[3] * p[3])
        s = new[0] + new[1] + new[2] + new[3]
        for x, y in zip(parts, new, strict=True):
            x[t] = y / s
    va, vb = scan_chain(tuple(x[-1].copy() for x in parts))
    a = np.concatenate([[0.5], va[:-1]])
    b = np.concatenate([[0.5], vb[:-1]])
    ra, rb = parts[0] * a + parts[1] * b, parts[2] * a + parts[3] * b
    s = ra + rb
    return (ra / s).T.ravel()[:n], (rb / s).T.ravel()[:n]


def odds_of(theta: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(theta, -30, 30))


def backward(e: np.ndarray, first: np.ndarray, a: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """beta of each token, scaled: beta[t-1] = A diag(e[t]) beta[t]; where t is a row's first token, beta[t-1] starts anew at (1, 1). after: beta of the last token, if its row goes on."""
    one = np.ones(len(e))
    last = np.append(first[1:], True)
    nxt = np.append(e[1:], 1.0)
    m = [np.where(last, one, a[0, 0]), np.where(last, one, a[0, 1] * nxt), np.where(last, one, a[1, 0]), np.where(last, one, a[1, 1] * nxt)]
    if after is not None:
        m[0][-1] = m[1][-1] = after[0]
        m[2][-1] = m[3][-1] = after[1]
    ba, bb = scan_chain(tuple(x[::-1] for x in m))
    return ba[::-1], bb[::-1]


def chain_marginals(theta: np.ndarray, first: np.ndarray, moves: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(state 1) of each token; for each token that is not a row's first, P(previous, this) as (n, 4) in the order 00, 01, 10, 11; and the last token's forward vector.

    theta: log-odds weight of state 1; first: marks of rows' first tokens; moves: 2x2 log weights [from, to]. Of a chain that is
    cut, `before` is the forward vector of the token ahead of the first one (which is then not marked) and `after` the backward vector of the last one.
    """
    n = len(theta)
    if not n:
        return np.zeros(0), np.zeros((0, 4)), np.full(2, 0.5)
    e = odds_of(theta)
    a = np.exp(moves)
    m = [np.where(first, 1.0, a[0, 0]), np.where(first, 1.0, a[1, 0]), e * np.where(first, 1.0, a[0, 1]), e * np.where(first, 1.0, a[1, 1])]
    if before is not None:
        m[0][0] = m[1][0] = m[0][0] * before[0] + m[1][0] * before[1]
        m[2][0] = m[3][0] = m[2][0] * before[0] + m[3][0] * before[1]
    fa, fb = scan_chain(tuple(m))
    ba, bb = backward(e, first, a, after)
    p0, p1 = fa * ba, fb * bb
    p = p1 / (p0 + p1)
    pair = np.zeros((n, 4))
    pa0, pb0 = np.roll(fa, 1), np.roll(fb, 1)
    if before is not None:
        pa0[0], pb0[0] = before
    for k, (prev, i, j) in enumerate(((pa0, 0, 0), (pa0, 0, 1), (pb0, 1, 0), (pb0, 1, 1))):
        pair[:, k] = prev * a[i, j] * (e * bb if j else ba)
    pair /= pair.sum(1, keepdims=True)
    pair[first] = 0
    return p, pair, np.array([fa[-1], fb[-1]])


def marginals(theta: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two of chain_marginals, of whole chains."""
    return chain_marginals(theta, first, moves)[:2]


class Field:
    """Weights by 64-bit feature mark (exact), a weight by word length, and 2x2 moves."""

    SLOT_BITS = 20

    def __init__(self, marks: np.ndarray):
        """marks: sorted, each once, none 0."""
        self.marks = np.append(marks, np.uint64(0))
        starts = np.searchsorted(marks >> np.uint64(64 - self.SLOT_BITS), np.arange((1 << self.SLOT_BITS) + 1, dtype=np.uint64))
        self.slots = starts[:-1].astype(np.int32)
        self.longest = int(np.diff(starts).max())
        self.w = np.zeros(len(self.marks), np.float64)
        self.by_length = np.zeros(32)
        self.moves = np.zeros((2, 2))

    def known(self, marks: np.ndarray) -> np.ndarray:
        """Index of each mark's weight; that of a mark without one is the last, which stays 0. All marks of a slot are looked at."""
        none = len(self.marks) - 1
        at = self.slots[(marks >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)]
        found = np.full(len(marks), none, np.int32)
        for step in range(self.longest):
            place = np.minimum(at + step, none)
            found = np.where(self.marks[place] == marks, place, found)
        return found

    def features(self, words: Words) -> tuple[list[np.ndarray], np.ndarray]:
        return [self.known(x) for x in feature_marks(words)], np.minimum(words.end - words.start, 31)

    def theta(self, features) -> np.ndarray:
        known, length = features
        return self.by_length[length] + sum(self.w[x] for x in known)


def feature_marks(words: Words) -> list[np.ndarray]:
    """Marks of the word (letters and digits, lower-cased) and of its beginnings, kept apart by a salt."""
    return [words.mark, *[np.where(x, x + np.uint64(2 * i + 1), x) for i, x in enumerate(words.prefix)]]


def scan(data, offsets, lo, hi) -> Words:
    return Words(data, offsets, lo, hi, prefixes=PREFIXES, alnum_only=True)


def windows(data, offsets, lo, hi, backwards: bool = False) -> Iterator[Words]:
    """The words of rows lo to hi; a row of more than PART bytes comes in parts, so that memory does not grow with a row."""
    return Words.parts(data, offsets, lo, hi, prefixes=PREFIXES, alnum_only=True, most=PART, backwards=backwards)


def behind(field: Field, data, offsets, lo, hi) -> list[np.ndarray | None]:
    """For each part of windows() the backward vector of its last token, from a walk over the parts from the end; None where no row goes on behind it. No walk where there is one part."""
    if offsets[hi] - offsets[lo] <= PART:
        return [None] if offsets[hi] > offsets[lo] else []
    out, row, vector = [], -1, None
    for words in windows(data, offsets, lo, hi, backwards=True):
        if not len(words.row):
            out.append(None)
            continue
        out.append(vector if words.row[-1] == row else None)
        e, a = odds_of(field.theta(field.features(words))), np.exp(field.moves)
        ba, bb = backward(e, first_marks(words), a, out[-1])
        vector = a @ np.array([ba[0], e[0] * bb[0]])
        row, vector = words.row[0], vector / vector.sum()
    return out[::-1]


def first_marks(words: Words) -> np.ndarray:
    first = np.ones(len(words.row), bool)
    first[1:] = words.row[1:] != words.row[:-1]
    return first


def log_clean(p: np.ndarray, pair: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Log of each row's chance that none of its tokens is toxic: that of its first, times those of each next one behind a clean one."""
    first = ~pair.any(1)
    toxic = p.copy()
    rest = ~first
    toxic[rest] = pair[rest, 1] / np.maximum(pair[rest, 0] + pair[rest, 1], 1e-300)
    return np.bincount(row, np.log1p(-np.minimum(toxic, 1 - 1e-12)), rows)


def fit(texts: pa.Array, toxic: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5) -> Field | None:
    """A field fitted by AdaGrad on the log-likelihood of document labels; None without both labels or without words.

    A document is toxic if at least one of its tokens is. So a clean one is a chain whose labels are all known (no token is toxic), and a toxic one
    is the chain constrained to any labelling but that one; the gradient is the difference of expected features
    with and without the constraint, both by forward-backward. Which tokens are toxic is nowhere given.
    """
    data, offsets = as_bytes(texts)
    toxic = toxic.astype(bool)
    if not toxic.any() or toxic.all():
        return None
    slices = list(row_slices(offsets, 1 << 18))
    seen = []
    for lo, hi in slices:
        words = scan(data, offsets, lo, hi)
        for marks in feature_marks(words):
            pair = np.unique(np.stack([marks[marks != 0], (words.row[marks != 0] + lo).astype(np.uint64)]), axis=1) if len(marks) else np.zeros((2, 0), np.uint64)
            m, at, n = np.unique(pair[0], return_index=True, return_counts=True)
            hit = np.add.reduceat(toxic[pair[1].astype(np.int64)].astype(np.int64), at) if len(m) else np.zeros(0, np.int64)
            seen.append((m, n, hit))
    marks = np.concatenate([x[0] for x in seen])
    order = np.argsort(marks, kind="stable")
    m, at = np.unique(marks[order], return_index=True)
    if not len(m):
        return None
    n = np.add.reduceat(np.concatenate([x[1] for x in seen])[order], at)
    hit = np.add.reduceat(np.concatenate([x[2] for x in seen])[order], at)
    often = n >= max(LEAST_DF, LEAST_SHARE * len(toxic))
    field = Field(m[often])
    n, hit = n[often], hit[often]
    share = toxic.mean()
    odds = np.log((hit + SHRINK * share) / (n - hit + SHRINK * (1 - share))) - np.log(share / (1 - share))
    field.w[:-1] = START * np.maximum(odds, 0.0)

    batches = []
    for lo, hi in slices:
        words = scan(data, offsets, lo, hi)
        if len(words.row):
            known, length = field.features(words)
            batches.append((lo, hi, [x.astype(np.int32) for x in known], length.astype(np.int8), words.row.astype(np.int32), first_marks(words)))
    tokens = sum(len(x[4]) for x in batches)
    field.by_length[:] = np.log(0.1 * len(toxic) / max(tokens, 1))
    g_w, g_len, g_moves = np.full(len(field.w), 1e-1), np.full(32, 1.0), np.full((2, 2), 1.0)
    for _ in range(epochs):
        for lo, hi, known, length, row, first in batches:
            p, pair = marginals(field.theta((known, length)), first, field.moves)
            none = np.minimum(np.exp(log_clean(p, pair, row, hi - lo)), 1 - 1e-9)
            push = np.where(toxic[lo:hi], none / (1 - none), -CLEAN_WEIGHT)
            gap = push[row] * p
            step_w = sum(np.bincount(x, gap, len(field.w)) for x in known) - PRIOR * field.w / len(batches)
            step_w[-1] = 0
            step_len = np.bincount(length, gap, 32)
            step_moves = np.array([np.bincount(row, x, hi - lo) @ push for x in pair.T])
            step_moves[0] -= np.bincount(row, ~first, hi - lo) @ push
            for weight, step, grown in ((field.w, step_w, g_w), (field.by_length, step_len, g_len), (field.moves, step_moves.reshape(2, 2), g_moves)):
                grown += step * step
                weight += rate * step / np.sqrt(grown)
    return field


def tag(field: Field, column: pa.Array, cut: float = 0.5) -> tuple[list[float], list[list[dict]]]:
    """Score and toxic spans (code points, end exclusive) of each text: the chance that any token is toxic, and the tokens that are so by `cut` or more.

    A text in parts is one chain: forward and backward vectors are carried over its cuts, and spans that meet at one are one span.
    """
    data, offsets = as_bytes(column)
    scores, spans = np.zeros(len(column)), [[] for _ in range(len(column))]
    at = (-1, 0, 0)  # row, byte and code point behind the last span
    for lo, hi in row_slices(offsets):
        clean = np.zeros(hi - lo)
        ahead, forward, hot = -1, None, False  # row, forward vector and mark of the token ahead of a part
        for words, after in zip(windows(data, offsets, lo, hi), behind(field, data, offsets, lo, hi), strict=True):
            if not len(words.row):
                continue
            first = first_marks(words)
            goes_on = words.row[0] == ahead
            first[0] = not goes_on
            p, pair, forward = chain_marginals(field.theta(field.features(words)), first, field.moves, forward if goes_on else None, after)
            clean += log_clean(p, pair, words.row, hi - lo)
            hits = np.flatnonzero(p >= cut)
            joins, ahead, hot = goes_on and hot and p[0] >= cut, words.row[-1], p[-1] >= cut
            runs = np.split(hits, np.flatnonzero((np.diff(hits) > 1) | (np.diff(words.row[hits]) != 0)) + 1) if len(hits) else []
            for run in runs:
                row, begin, end = int(words.row[run[0]]) + lo, int(words.start[run[0]]), int(words.end[run[-1]])
                if row != at[0]:
                    at = (row, int(offsets[row]), 0)
                start = at[2] + code_points(data, at[1], begin)
                at = (row, end, start + code_points(data, begin, end))
                if joins and run[0] == 0:
                    spans[row][-1].update(end=at[2], p=max(spans[row][-1]["p"], float(p[run].max())))
                else:
                    spans[row].append({"start": start, "end": at[2], "p": float(p[run].max())})
        scores[lo:hi] = -np.expm1(clean)
    return scores.tolist(), spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def sample(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """text, toxic of at most TOXIC_ROWS and CLEAN_ROWS training rows with a text of at most SAMPLE_BYTES, drawn by a hash of the id.

    Training rows have crc32(doc_id as text) mod 4 other than 2; an id labelled more than once is toxic if one label says so. Labelled ids
    are drawn by a threshold on the hash, DRAW times as many as wanted, and the sample is taken from those that have a text (the least, where an id has several).
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_part(F.col("doc_id")) != 2))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    wanted = {True: TOXIC_ROWS, False: CLEAN_ROWS}
    share = {r["toxic"]: min(1.0, DRAW * wanted[r["toxic"]] / r["n"]) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    under = lambda flag: F.pmod("draw", F.lit(1 << 30)) < int((1 << 30) * share.get(flag, 1.0))
    ids = written(known.filter(F.when(F.col("toxic"), under(True)).otherwise(under(False))), "labelled")
    texts = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # DRAW times the sample's ids
    texts = written(texts.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text")), "sample")  # one text an id
    parts = [texts.filter(F.col("toxic") == flag).select("doc_id", "draw").orderBy("draw", "doc_id").limit(rows) for flag, rows in wanted.items()]
    chosen = written(parts[0].union(parts[1]).select("doc_id"), "chosen")
    return texts.join(F.broadcast(chosen), "doc_id", "left_semi").orderBy("draw", "doc_id").select("text", "toxic")  # TOXIC_ROWS + CLEAN_ROWS ids


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    rows = sample(docs, labels).toArrow()
    return fit(rows.column("text"), np.asarray(rows.column("toxic").to_pylist(), bool)) if rows.num_rows else None


def score_texts(docs: DataFrame, field: Field | None, text_col: str = "text", names: tuple[str, str] = ("score", "toxic_spans")) -> DataFrame:
    """docs with two more columns, the score and the toxic spans.

    Null and empty texts and those without words score 0; so does every text without a field (no labels of both kinds).
    Texts longer than PART bytes are scored whole, as one chain whose state is carried over the parts it is read in. The score is a function of
    the text alone: equal texts tie, repeated rows are scored each. An empty table gives an empty result. Extra columns pass
    through, but for those of the names given, which are replaced.
    """
    rest = docs.drop(*names)
    schema = T.StructType([*rest.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            scores, spans = ([0.0] * len(column), [[]] * len(column)) if shared.value is None else tag(shared.value, column)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, _ARROW_SPANS)], names=[*batch.schema.names, *names])

    return rest.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans for every row of docs, by a field fitted on a bounded sample of the labels (see score_texts for odd rows)."""
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (crc_part(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "toxic_spans")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
