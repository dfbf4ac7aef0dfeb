"""Personal data: exact patterns, and a conditional random field over word shapes that adds what looks alike."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import table
from loomline.llm.textscan import Words, as_bytes, code_points, row_slices

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the windows drawn from the corpus: documents looked at, windows kept, words on either side of a telling word, and bytes of a text.
SAMPLE_DOCS, SAMPLE_WINDOWS, AROUND, SAMPLE_BYTES = 6000, 4000, 5, 65_536
#: Words of a document, wherever they stand, whose windows may be drawn too.
ANY_WORDS = 1
#: How far a word must be from every kind to be none for certain; room for rounding.
CERTAIN = 1e-3
#: How often a row of the written table counts against a drawn window.
WRITTEN_WEIGHT = 8.0
#: Bytes whose words are decoded together.
DECODE_BYTES = 1 << 23
#: The written labelled table: what people write that the base patterns do not match, marked by kind, among look-alikes that are no personal data.
WRITTEN = """
write to {email jane.doe (at) example.org} today|mail {email jane [at] example.com} or call|contact {email info(at)example.net} for more
reach me: {email j.smith AT(example)com} thanks|my address is {email jane @ example.com} now|send it to {email bob.lee @example.org} please
or {email bob_lee@ example.org} instead|the list {email team-x (at) lists.example.org} is open|ask {email a.b (at) example (dot) org} first
Mail: {email k.weber@firma (dot) de} bitte|adresse {email m.martin (arobase) exemple.fr} merci|correo {email p.ruiz(arroba)ejemplo.es} gracias
call {phone (030) 1234567} now|phone {phone 030 1234567} or write|tel {phone 0171-5558812} any time|dial {phone (555) 012-3456} today
my number is {phone 555-012-3456} ok|fax {phone 030/1234567} only|ring {phone 0044 20 7946 0018} soon|mobile {phone 07700 900123} evenings
Telefon {phone 089 / 123 456 78} werktags|appelez le {phone 01 23 45 67 89} demain|llame al {phone 912 345 678} hoy|tel.: {phone (0)30 901820} bitte
at {phone 1-800-555-0199} free|on {phone 212.555.0142} daily|under {phone 0151 55512345} erreichbar|or {phone (212) 555-0142} at night
card {card 4111 1111 1111 1111,} exp|paid by {card 4111.1111.1111.1111} yesterday|number {card 5500/0000/0000/0004} on file
use {card 3400_000000_00009} here|charge {card 4111-1111-1111-1111.} now|Karte {card 4012 8888 8888 1881;} bis|visa {card (4222222222222220)} ok
host {ip 192.168 .1.7} is up|from {ip 10 . 0 . 0 . 12} again|at {ip 192-168-1-20} today|server {ip 172[.]16[.]5[.]9} blocked|ping {ip 8,8,8,8} fails
addr {ip 203(.)0(.)113(.)7} seen|login from {ip 198.51.100 .23} denied|gateway {ip 10[.]1[.]1[.]1} down
version 2.0 of the|released in 2019 (see notes)|about 1,200 people (and 300 more)|from 10 to 12 (noon)|section 4.2.1 (draft)|licensed under 4.0 terms
on 12.03.2021 we|at 10:30 (or 11:15) the|costs 1.299,00 euro (net)|chapter 12 - page 345|the 3 (three) items|score 3-2 (after 120 minutes)|id 980791 of the
in 2020-11-05 logs|order 4711 (open)|a 5 x 7 grid (small)|isbn 978 (old)|(at) last it|he said (at the dot)|meet (at) noon 12|page 12 (of 345) shows|sum 12 345 678 cells
token = 9f86d081 of|build 20230917 (nightly)|area 51 (closed)|10 000 000 rows (20 tasks)|ratio 16:9 or 4:3|temperature 21.5 (max 30.2)|pi 3.14159 (about)
"""

#: Ways to write each kind that the base patterns do not match, from which more rows are made: A is a name, B a domain's first part, C its last, d a digit (of a card that passes its check, of a part up to 255 where D).
WAYS = {
    "email": ["A (at) B.C", "A [at] B.C", "A(at)B.C", "A[at]B.C", "A @ B.C", "A @B.C", "A@ B.C", "A (at) B (dot) C", "A [at] B [dot] C", "A@B (dot) C", "A AT(B)C", "A (arobase) B.C", "A(arroba)B.C", "A {at} B.C", "A [at] B (dot) C"],
    "phone": ["(0dd) ddddddd", "0ddd ddddddd", "0ddd-ddddddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "0dd/dddddddd", "00dd dd dddd dddd", "0dddd dddddd", "0dd / ddd ddd dd", "0d dd dd dd dd", "ddd ddd ddd", "(0)dd dddddd", "1-ddd-ddd-dddd", "0ddd dddddddd", "dd dd dd dd dd"],
    "card": ["dddd.dddd.dddd.dddd", "dddd/dddd/dddd/dddd", "dddd_dddd_dddd_dddd", "dddd dddd dddd dddd,", "dddd-dddd-dddd-dddd.", "(dddddddddddddddd)", "dddd  dddd  dddd  dddd", "dddd_dddddd_ddddd"],
    "ip": ["D.D .D.D", "D . D . D . D", "D-D-D-D", "D[.]D[.]D[.]D", "D(.)D(.)D(.)D", "D,D,D,D", "D.D.D .D", "D. D. D. D", "D[.]D.D.D"],
}
MADE_ROWS, MADE_WEIGHT = 600, 2.0

_AT = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
#: What stands for an at sign and for a point in addresses that are not to be read by machines: a mark, a short word in brackets, or the word.
_AT_LIKE, _DOT_LIKE = re.compile(r"@|[(\[{]\s*\w{1,8}\s*[)\]}]|\bat\b", re.I), re.compile(r"\w\.\w|[(\[{]\s*\w{1,8}\s*[)\]}].*[(\[{]\s*\w{1,8}\s*[)\]}]|\bdot\b", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A digit run that fails from its start fails from its middle too, so matches may only begin where no digit is before.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: leftmost matches of each kind that do not overlap within it, less those that fail its test."""
    found = []
    if "@" in text:
        free = 0  # a name cannot reach back before the end of the match before
        for m in _AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                free = m.end()
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(v) <= 3 and int(v or "0") <= 255 for v in (p.lstrip("0") for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def plausible(kind: int, text: str) -> bool:
    """Whether an added span can be of its kind: a name's at and a point in some writing; four parts up to 255, a passing check digit, a dialable length."""
    digits = re.findall("[0-9]+", text)
    if kind == 1:
        return len(digits) == 4 and all(len(d) <= 3 and int(d) <= 255 for d in digits)
    if kind == 2:
        return 12 <= len("".join(digits)) <= 19 and luhn("".join(digits))
    if kind == 0:
        return bool(_AT_LIKE.search(text) and _DOT_LIKE.search(text))
    return 7 <= len("".join(digits)) <= 15


# Word shapes -----------------------------------------------------------------------------------------

#: Classes of bytes: lower, upper, digit, then single marks, other ASCII, and bytes of longer characters.
_CLASS = np.full(256, 10, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _i, _c in enumerate("@.-+()_"):
    _CLASS[ord(_c)] = 3 + _i
_CLASS[128:] = 11
CLASSES = 12
_BITS = (1 << np.arange(CLASSES)).astype(np.uint16)[_CLASS]
_DIGIT = (_CLASS == 2).astype(np.int32)
SHAPES, SIZES, ENDS = 1 << CLASSES, 25 * 25, CLASSES * CLASSES
#: Shapes of telling words: with a digit, an at sign, a plus or a bracket.
_TELLING = (np.arange(SHAPES) & sum(1 << i for i in (2, 3, 6, 7, 8))) != 0
#: Feature blocks: own shape, digits and length, first and last class, shape of the word before and behind.
_STARTS = np.cumsum([0, SHAPES, SIZES, ENDS, SHAPES + 1])
FEATURES = int(_STARTS[-1] + SHAPES + 1)


def shape_features(data: np.ndarray, words: Words) -> np.ndarray:
    """Five feature numbers of every word."""
    n = len(words.start)
    if not n:
        return np.zeros((0, 5), np.int32)
    lo, hi = int(words.start[0]), int(words.end[-1])
    part = data[lo:hi]
    edges = np.stack([words.start, words.end], 1).ravel()[:-1] - lo
    shape = np.bitwise_or.reduceat(_BITS[part], edges)[::2].astype(np.int32)
    digits = np.minimum(np.add.reduceat(_DIGIT[part], edges)[::2], 24)
    length = np.minimum(words.end - words.start, 24).astype(np.int32)
    first = np.append(True, words.row[1:] != words.row[:-1])
    before = np.where(first, SHAPES, np.roll(shape, 1))
    behind = np.where(np.roll(first, -1), SHAPES, np.roll(shape, -1))
    ends = _CLASS[data[words.start]].astype(np.int32) * CLASSES + _CLASS[data[words.end - 1]]
    return np.stack([shape, digits * 25 + length, ends, before, behind], 1).astype(np.int32) + _STARTS.astype(np.int32)


class ShapeField:
    """Linear-chain field with the states none and the four kinds."""

    STATES = 1 + len(KINDS)

    def __init__(self):
        self.w = np.zeros((FEATURES, self.STATES), np.float32)
        self.moves = np.zeros((self.STATES, self.STATES), np.float32)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(self.w[features[:, k]] for k in range(features.shape[1]))

    def _most(self) -> np.ndarray:
        """For each kind, the most that a word's moves can gain by it over none, whatever its neighbours are and where a text begins or ends."""
        m = self.moves.astype(np.float64)
        into, out = m - m[:, :1], m - m[:1]  # into[p, s]: from p to s and not to none; out[s, q]: from s to q and not from none
        return np.maximum(into.max(0), 0) + np.maximum(out.max(1), 0)

    def decode_all(self, features: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The likeliest states of all words of each row, as decode() over whole rows gives them.

        A word that loses by every kind, more than any moves can make up for, is none in the best sequence: with none in its place any other one would score more. Such words part a row into runs that do not depend on
        each other, and only those are decoded, each with the none before and behind it.
        """
        out = np.zeros(len(row), np.int8)
        if not len(row):
            return out
        gain = np.full(len(row), -np.inf)
        most = self._most()
        none = sum(self.w[features[:, k], 0].astype(np.float64) for k in range(features.shape[1]))
        for s in range(1, self.STATES):
            np.maximum(gain, sum(self.w[features[:, k], s].astype(np.float64) for k in range(features.shape[1])) - none + most[s], out=gain)
        open_ = gain > -CERTAIN
        near = open_.copy()
        same = row[1:] == row[:-1]
        near[1:] |= open_[:-1] & same
        near[:-1] |= open_[1:] & same
        at = np.flatnonzero(near)
        if not len(at):
            return out
        # a run ends where words were skipped, a row ends, or two words stand side by side that are both none for certain
        begins = np.append(True, (np.diff(at) > 1) | (row[at][1:] != row[at][:-1]) | (~open_[at][1:] & ~open_[at][:-1]))
        out[at] = np.where(open_[at], self.decode(features[at], np.cumsum(begins), ~open_[at]), 0)
        return out

    def decode(self, features: np.ndarray, row: np.ndarray, none: np.ndarray | None = None) -> np.ndarray:
        """The likeliest state of every word (Viterbi, all rows of the batch side by side; ties: the lower state). Words marked in `none` are of no kind."""
        n = len(row)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        length = np.diff(np.append(begin, n))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        score = self.scores(features)
        if none is not None:
            score[none, 1:] = -1e9
        back = np.zeros((n, self.STATES), np.int8)
        best = score[begin].copy()
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))  # rows longer than t
            at = begin[:live] + t
            ways = best[:live, :, None] + self.moves[None]
            came = ways.argmax(1)
            back[at] = came
            best[:live] = np.take_along_axis(ways, came[:, None], 1)[:, 0] + score[at]
        state = best.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            at = begin[:live] + t
            out[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return out


def fit_field(features: list[list[list[int]]], labels: list[list[int]], weights: list[float] | None = None, epochs: int = 60, rate: float = 0.3) -> ShapeField | None:
    """AdaGrad on the weighted log-likelihood of labelled windows; None without any."""
    if not features:
        return None
    field, s = ShapeField(), ShapeField.STATES
    longest = max(map(len, labels))
    b = len(labels)
    x, y, there = np.zeros((longest, b, 5), np.int32), np.zeros((longest, b), np.int64), np.zeros((longest, b), bool)
    for i, (f, lab) in enumerate(zip(features, labels, strict=True)):
        x[: len(lab), i], y[: len(lab), i], there[: len(lab), i] = f, lab, True
    used = np.unique(x[there])
    small = np.searchsorted(used, np.where(there[..., None], x, used[0]))
    w, moves = np.zeros((len(used), s)), np.zeros((s, s))
    g_w, g_m = np.full(w.shape, 1e-2), np.full(moves.shape, 1e-2)
    rows, weigh = np.arange(b), np.ones(b) if weights is None else np.asarray(weights, float)
    for _ in range(epochs):
        unary = w[small].sum(2)
        alpha, beta = np.zeros((longest, b, s)), np.zeros((longest, b, s))
        alpha[0] = unary[0]
        for t in range(1, longest):
            ways = alpha[t - 1][:, :, None] + moves
            top = ways.max(1)
            alpha[t] = np.where(there[t][:, None], top + np.log(np.exp(ways - top[:, None]).sum(1)) + unary[t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            ways = moves + (unary[t + 1] + beta[t + 1])[:, None, :]
            top = ways.max(2)
            beta[t] = np.where(there[t + 1][:, None], top + np.log(np.exp(ways - top[..., None]).sum(2)), 0)
        total = alpha[-1].max(1)
        total = total + np.log(np.exp(alpha[-1] - total[:, None]).sum(1))
        p = np.exp(alpha + beta - total[None, :, None]) * there[..., None]
        gap = -p
        np.add.at(gap, (np.arange(longest)[:, None], rows[None], y), there)
        gap *= weigh[None, :, None]
        step_w = -0.02 * w
        for k in range(5):
            np.add.at(step_w, small[..., k][there], gap[there])
        step_m = np.zeros((s, s))
        for t in range(1, longest):
            live = there[t]
            pair = np.exp(alpha[t - 1][live][:, :, None] + moves + (unary[t] + beta[t])[live][:, None, :] - total[live][:, None, None])
            step_m -= (pair * weigh[live][:, None, None]).sum(0)
            np.add.at(step_m, (y[t - 1][live], y[t][live]), weigh[live])
        for weight, step, grown in ((w, step_w, g_w), (moves, step_m, g_m)):
            grown += step * step
            weight += rate * step / np.sqrt(grown)
    field.w[used] = w
    field.moves[:] = moves
    return field


# Spark jobs ------------------------------------------------------------------------------------------


def _word_labels(text: bytes, words: Words, begin: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """State of each word of one text by its base spans, and the spans."""
    spans = base_spans(text.decode())
    label = np.zeros(len(words.start), np.int64)
    if spans:
        head = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
        start, end = head[words.start - begin], head[words.end - begin]
        for a, kind, b in reversed(spans):
            label[(start < b) & (end > a)] = kind + 1
    return label, spans


def written_rows(part: int | None = None, parts: int = 4) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts and marked spans (start, kind, end) of the written table: all rows, or for the tests those of one part, or (negative) all but it."""
    texts, spans = [], []
    for k, row in enumerate(r for r in re.split("[|\n]", WRITTEN) if r):
        if part is None or (k % parts == part if part >= 0 else k % parts != -part - 1):
            text, marked = "", []
            for piece in re.split("({[a-z]+ [^}]*})", row):
                if piece.startswith("{"):
                    kind, piece = piece[1:-1].split(" ", 1)
                    marked.append((len(text), KINDS.index(kind), len(text) + len(piece)))
                text += piece
            texts.append(text)
            spans.append(marked)
    return texts, spans


def made_rows(n: int = MADE_ROWS, seed: int = 5) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts and marked spans made from WAYS: one span a row among words of no kind."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9))))
    texts, spans = [], []
    for i in range(n):
        kind = KINDS[i % len(KINDS)]
        name = pick([word, lambda: f"{word()}.{word()}", lambda: f"{word()}_{word()}", lambda: f"{word()}-{int(rng.integers(99))}"])()
        filled = pick(WAYS[kind])
        if kind == "email":
            filled = re.sub("[ABC](?![T])", lambda m, name=name: {"A": name, "B": word(), "C": pick(["com", "org", "net", "de", "fr", "es"])}[m[0]], filled)
        else:
            while True:
                value = re.sub("[dD]", lambda m: str(int(rng.integers(256 if m[0] == "D" else 10))), filled)
                if kind != "card" or luhn(re.sub("[^0-9]", "", value)):
                    break
            filled = value
        before = " ".join([*(word() for _ in range(int(rng.integers(0, 5)))), pick(["", "at", "call", "tel", "mail", "card", "from", "is"])]).strip()
        after = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        start = len(before) + bool(before)
        texts.append(f"{before} {filled} {after}".strip() if before else f"{filled} {after}".strip())
        spans.append([(start, KINDS.index(kind), start + len(filled))])
    return texts, spans


def written_windows(part: int | None = None, made: int = MADE_ROWS) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Features and labels of the written table's rows, and of those made from WAYS."""
    texts, spans = (x + y for x, y in zip(written_rows(part), made_rows(made), strict=True))
    data, offsets = as_bytes(pa.array(texts))
    features, labels = [], []
    for row, marked in enumerate(spans):
        words = Words(data, offsets, row, row + 1, marks=False)
        begin = int(offsets[row])
        features.append(shape_features(data, words).tolist())
        labels.append([next((k + 1 for a, k, b in marked if x - begin < b and y - begin > a), 0) for x, y in zip(words.start.tolist(), words.end.tolist(), strict=True)])
    return features, labels


def labelled_windows(docs: DataFrame, seed: int = 13) -> DataFrame:
    """features, labels of word windows of the corpus, labelled by the base patterns: what the field must leave alone or agree with.

    Drawn from about SAMPLE_DOCS documents of at most SAMPLE_BYTES, by a threshold on a hash of the id: AROUND words on either side of each
    telling word, and of ANY_WORDS words of each document. Windows with an at sign outside the base spans are left out, as it may be one that people write otherwise. At most SAMPLE_WINDOWS, by a hash of their place.
    """
    n = docs.count()
    share = int((1 << 30) * min(1.0, SAMPLE_DOCS / max(n, 1)))
    rows = docs.filter((F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.octet_length("text")), F.lit(1 << 30)) < share) & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            draws, features, labels = [], [], []
            for row in range(len(offsets) - 1):
                words = Words(data, offsets, row, row + 1, marks=False)
                shapes = shape_features(data, words)
                if not len(shapes):
                    continue
                any_word = [int(hashlib.md5(f"{batch.column(0)[row]}:any:{j}".encode()).hexdigest()[:12], 16) % len(shapes) for j in range(ANY_WORDS)]
                marked = np.union1d(np.flatnonzero(_TELLING[shapes[:, 0]]), any_word)
                label, _ = _word_labels(data[offsets[row] : offsets[row + 1]].tobytes(), words, int(offsets[row]))
                last = -1
                for i in marked:
                    if i <= last:
                        continue
                    lo, hi = max(0, i - AROUND), min(len(label), i + AROUND + 1)
                    last = hi - 1
                    if ((shapes[lo:hi, 0] >> 3 & 1 == 1) & (label[lo:hi] == 0)).any():
                        continue
                    draws.append(int.from_bytes(hashlib.md5(f"{batch.column(0)[row]}:{i}".encode()).digest()[:7], "big"))
                    features.append(shapes[lo:hi].tolist())
                    labels.append(label[lo:hi].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.int64()), pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))], names=["draw", "features", "labels"])

    windows = rows.mapInArrow(run, "draw long, features array<array<int>>, labels array<int>")
    return windows.orderBy("draw").limit(SAMPLE_WINDOWS)  # numbers alone, SAMPLE_WINDOWS a task at most


def train(docs: DataFrame, part: int | None = None) -> ShapeField:
    """A field fitted on the written table (or a part of it) and windows drawn from docs."""
    rows = labelled_windows(docs).toArrow()
    features, labels = written_windows(part)
    drawn = rows.column("features").to_pylist()
    weights = [WRITTEN_WEIGHT] * (len(labels) - MADE_ROWS) + [MADE_WEIGHT] * MADE_ROWS + [1.0] * len(drawn)
    return fit_field(features + drawn, labels + rows.column("labels").to_pylist(), weights)


def tag(field: ShapeField | None, column: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text. The field's spans are runs of words of one kind; one that touches a base span, or whose numbers cannot be of its kind, is left out."""
    data, offsets = as_bytes(column)
    telling = np.zeros(256, bool)
    telling[[ord("@"), ord("+"), *range(ord("0"), ord("9") + 1)]] = True
    for lo, hi in row_slices(offsets, DECODE_BYTES):
        by_row: dict[int, list[tuple[int, int, int]]] = {}  # start byte, kind, end byte
        for words in Words.parts(data, offsets, lo, hi, marks=False, most=DECODE_BYTES) if field else ():
            state = field.decode_all(shape_features(data, words), words.row)
            hit = np.flatnonzero(state)
            runs = np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(words.row[hit]) != 0) | (np.diff(state[hit]) != 0)) + 1) if len(hit) else []
            for run in runs:
                by_row.setdefault(int(words.row[run[0]]), []).append((int(words.start[run[0]]), int(state[run[0]]) - 1, int(words.end[run[-1]])))
        sums = np.add.reduceat(np.append(telling[data[offsets[lo] : offsets[hi]]], False).astype(np.int32), np.minimum(offsets[lo:hi] - offsets[lo], offsets[hi] - offsets[lo]))
        for row in range(hi - lo):
            begin, end = int(offsets[lo + row]), int(offsets[lo + row + 1])
            base = base_spans(data[begin:end].tobytes().decode()) if end > begin and sums[row] else []
            added, at, place = [], begin, 0
            starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
            for start, kind, stop in by_row.get(row, ()):
                a = place + code_points(data, at, start)
                b = a + code_points(data, start, stop)
                at, place = stop, b
                before = bisect_left(starts, b)
                if (not before or reach[before - 1] <= a) and plausible(kind, data[start:stop].tobytes().decode()):
                    added.append((a, kind, b))
            yield base, sorted(base + added)


RESULT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def find_personal_data(docs: DataFrame, field: ShapeField | None, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all).

    Null and empty texts have no spans. Texts are searched whole, however long; the patterns need one text at a time in memory, the
    field works in parts. Spans that begin at one place are in order of kind. Every row is searched, so repeated rows give
    repeated results. An empty table gives an empty result. Extra columns pass through, but for those of these names, which are replaced.
    """
    rest = docs.drop(*RESULT.names)
    schema = T.StructType([*rest.schema.fields, *RESULT.fields])
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for base, every in tag(shared.value, batch.column(batch.schema.get_field_index(text_col))):
                counts.append([sum(k == kind for _, kind, _ in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(n[:, k]) for k in range(len(KINDS))], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[*batch.schema.names, *RESULT.names])

    return rest.mapInArrow(run, schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return find_personal_data(docs, train(docs)).drop("text")
