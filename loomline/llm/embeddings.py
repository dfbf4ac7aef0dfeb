"""Embedding near-duplicates with an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import small, table, written
from loomline.llm.components import components
from loomline.llm.textscan import mix64

#: Codewords of a half: the root of rows / CELL_ROWS, so that cells keep their size as the table grows; MOST_WORDS is reached at 8.6 billion vectors.
CELL_ROWS, MOST_WORDS = 512, 4096
#: Bounded samples, by vector length: rows the codebooks are fitted on (so many a codeword, at most FIT_ROWS), and query rows of the recall.
FIT_WORD_ROWS, FIT_ROWS, PROBE_ROWS = 64, 65_536, 300
#: Share of links exactly at the threshold whose cell is to be visited, and share of all links of the sampled rows.
EDGE_RECALL, TARGET_RECALL = 0.9, 0.995
#: Cells are shipped in rooms of about ROOM_ROWS vectors; a room that holds more than twice that is met in parts.
ROOM_ROWS = 16_384
#: A batch's vectors of one cell within BALL_ANGLE (a quarter of the links' angle, where that is less) of one of them are handled as one ball if there are BALL_LEAST; tries a cell, and members at most.
BALL_ANGLE, BALL_LEAST, BALL_TRIES, BALL_MOST = math.pi / 32, 32, 64, 1024
#: Angles this near to a limit are left to the verification of members.
MARGIN = 1e-7
#: Groups of equal vectors, and crowded rooms, up to this many rows may be broadcast; more shuffle.
BROADCAST_ROWS = 200_000
_BLOCK = 1024


def codebook(half: np.ndarray, words: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means from a seeded draw; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = half[np.sort(rng.choice(len(half), min(words, len(half)), replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(half[lo : lo + 8192], centres).argmin(1) for lo in range(0, len(half), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, half)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


class MultiIndex:
    """Independent codebooks on the halves of unit vectors of one length; their product is the grid of cells.

    Cells and rooms are numbered from `first_cell` and `first_room`, so that several lengths share one numbering. A room is a
    block of the grid: the cells of one group of near codewords of either half.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, groups: int = 1, visits: int = 1, first_cell: int = 0, first_room: int = 0):
        self.first, self.second, self.cut, self.visits = first, second, first.shape[1], visits
        self.first_cell, self.first_room = first_cell, first_room
        self.group_a, self.group_b = (distances(x, codebook(x, min(groups, len(x)))).argmin(1) for x in (first, second))
        self.groups = groups

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.cut], self.first), distances(x[:, self.cut :], self.second)

    def traverse(self, a: np.ndarray, b: np.ndarray, visits: int) -> np.ndarray:
        """The `visits` cells nearest to each row, nearest first, by the multi-sequence algorithm, all rows in step.

        a, b: distances to the codewords. Each place in a row's sorted first list waits with its next place in the sorted second
        list; in every step the nearest of the waiting pairs leaves and its place moves on.
        """
        visits = min(visits, self.cells)
        i_of, j_of = (np.argsort(x, 1, kind="stable")[:, :visits] for x in (a, b))
        av = np.take_along_axis(a, i_of, 1)
        bv = np.append(np.take_along_axis(b, j_of, 1), np.full((len(b), 1), np.inf), 1)
        at, row = np.zeros(i_of.shape, np.int64), np.arange(len(a))
        out = np.empty((len(a), visits), np.int64)
        for step in range(visits):
            i = (av + np.take_along_axis(bv, at, 1)).argmin(1)
            out[:, step] = i_of[row, i] * b.shape[1] + j_of[row, at[row, i]]
            at[row, i] += 1
        return out

    def rank(self, a: np.ndarray, b_sorted: np.ndarray, value: float) -> int:
        """Cells of one row nearer than `value`."""
        return int(np.searchsorted(b_sorted, value - a - 1e-12, "left").sum())

    def either_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of rows: the place of y's cell in x's order or of x's cell in y's, whichever is less."""
        sides = [self.halves(v) for v in (x, y)]
        sorted_b = [np.sort(b, 1) for _, b in sides]
        own = [(a.argmin(1), b.argmin(1)) for a, b in sides]
        out = np.empty(len(x), np.int64)
        for k in range(len(x)):
            ways = []
            for s in (0, 1):
                (a, b), (i, j) = sides[s], own[1 - s]
                ways.append(self.rank(a[k], sorted_b[s][k], a[k, i[k]] + b[k, j[k]]))
            out[k] = min(ways)
        return out

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Visited cells of each row (its own first) and their rooms."""
        cells = self.traverse(*self.halves(x), self.visits)
        rooms = self.group_a[cells // len(self.second)] * self.groups + self.group_b[cells % len(self.second)]
        return cells + self.first_cell, rooms + self.first_room


def row_matrices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as stored) by length, about `most` numbers at once; null and empty rows and those with null or non-finite numbers or only zeros are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        for lo in range(0, len(rows), max(1, most // d)):
            part = rows[lo : lo + max(1, most // d)]
            x = column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            if good.any():
                yield part[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def digests(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's stored numbers."""
    raw = np.ascontiguousarray(x.astype(np.float64) + 0.0).view(np.uint64)
    marks = mix64(raw ^ mix64(np.arange(1, raw.shape[1] + 1, dtype=np.uint64))[None])
    return marks.sum(1, dtype=np.uint64).view(np.int64), mix64(marks).sum(1, dtype=np.uint64).view(np.int64)


def words_for(rows: int) -> int:
    return int(min(MOST_WORDS, max(1, math.ceil(math.sqrt(rows / CELL_ROWS)))))


def fit_indexes(rows: DataFrame, least: float) -> dict[int, MultiIndex]:
    """An index for each vector length: codebooks fitted on a bounded sample drawn by a hash, and visits by the recall on a bounded sample."""
    size = F.size("v")
    counts = {r["d"]: r["n"] for r in rows.filter(size > 0).groupBy(size.alias("d")).agg(F.count("*").alias("n")).collect()}  # a row per vector length
    wanted = {d: min(FIT_ROWS, max(PROBE_ROWS, FIT_WORD_ROWS * words_for(n))) for d, n in counts.items()}
    if not wanted:
        return {}
    share = F.create_map(*[F.lit(x) for d in wanted for x in (d, int((1 << 30) * min(1.0, 1.2 * wanted[d] / counts[d])))])
    drawn = rows.filter((size > 0) & (F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(1 << 30)) < F.element_at(share, size)))
    column = drawn.select("v").limit(2 * sum(wanted.values())).toArrow().column("v")
    samples: dict[int, list[np.ndarray]] = {}
    for _, x in row_matrices(column):
        samples.setdefault(x.shape[1], []).append(unit(x))
    indexes, cells, rooms = {}, 0, 0
    for d in sorted(counts):
        x = np.concatenate(samples[d]) if d in samples else np.eye(1, d)
        words, cut = words_for(counts[d]), (d + 1) // 2
        second = codebook(x[:, cut:], words if d > 1 else 1)
        groups = max(1, math.ceil(math.sqrt(counts[d] / ROOM_ROWS)))
        indexes[d] = MultiIndex(codebook(x[:, :cut], words), second, groups, 1, cells, rooms)
        cells, rooms = cells + indexes[d].cells, rooms + groups * groups
        indexes[d].visits = min(indexes[d].cells, _edge_visits(indexes[d], x[:PROBE_ROWS], least))
    for d, visits in _visits_of_links(rows, indexes, {d: x[0][:PROBE_ROWS] for d, x in samples.items()}, least).items():
        indexes[d].visits = min(indexes[d].cells, max(indexes[d].visits, visits))
    return indexes


def _edge_visits(index: MultiIndex, x: np.ndarray, least: float) -> int:
    """Visits that reach EDGE_RECALL of partners drawn at exactly the threshold angle, the hardest links there are."""
    if x.shape[1] < 2:
        return 1
    noise = np.random.default_rng(9).normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = least * x + math.sqrt(1 - least * least) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    ranks = np.sort(index.either_rank(x, y))
    return int(ranks[math.ceil(EDGE_RECALL * len(ranks)) - 1]) + 1


def _visits_of_links(rows: DataFrame, indexes: dict[int, MultiIndex], probes: dict[int, np.ndarray], least: float) -> dict[int, int]:
    """Visits by length that reach TARGET_RECALL of the links of the sampled rows, each row weighing the same: by brute force against all rows on the executors."""
    shared = rows.sparkSession.sparkContext.broadcast((indexes, probes))  # codebooks, and PROBE_ROWS vectors a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, probes = shared.value
        found: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, x in row_matrices(batch.column(0)):
                d, x = x.shape[1], unit(x)
                q, at = np.nonzero((s := probes[d] @ x.T if d in probes else np.zeros((0, len(x)))) >= least)
                q, at = (v[s[q, at] < 1 - 1e-12] for v in (q, at))  # equal vectors share a cell
                for lo in range(0, len(q), _BLOCK):
                    ranks = indexes[d].either_rank(probes[d][q[lo : lo + _BLOCK]], x[at[lo : lo + _BLOCK]])
                    for k, r in zip(q[lo : lo + _BLOCK].tolist(), ranks.tolist(), strict=True):
                        found[d, k, r] = found.get((d, k, r), 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_pydict({**{c: pa.array([k[i] for k in keys], pa.int64()) for i, c in enumerate("dkr")}, "n": pa.array([found[k] for k in keys], pa.int64())})

    sums = rows.select("v").mapInArrow(run, "d long, k long, r long, n long").groupBy("d", "k", "r").agg(F.sum("n").alias("n"))
    weighed = sums.withColumn("all", F.sum("n").over(Window.partitionBy("d", "k"))).groupBy("d", "r").agg(F.sum(F.col("n") / F.col("all")).alias("share"))
    out: dict[int, int] = {}
    reached: dict[int, float] = {}
    ranked = weighed.orderBy("d", "r").collect()  # at most a row per length and rank of a sampled link
    whole = {d: sum(r["share"] for r in ranked if r["d"] == d) for d in {r["d"] for r in ranked}}
    for r in ranked:
        if reached.get(r["d"], 0.0) < TARGET_RECALL * whole[r["d"]]:
            reached[r["d"]] = reached.get(r["d"], 0.0) + r["share"]
            out[r["d"]] = r["r"] + 1
    return out


# Balls -----------------------------------------------------------------------------------------------


def balls(x: np.ndarray, cell: np.ndarray, d0: np.ndarray, d1: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the unit rows of a batch: the row that stands for each, and the radius of that one's ball.

    Equal rows stand together at radius 0. In a cell with BALL_LEAST different rows, those within BALL_ANGLE of one of
    them become its ball, but at most a quarter of the angle of `least`, so that all rows of a ball are linked; what is left after BALL_TRIES centres stands for itself, as do all other rows.
    """
    n, widest = len(x), min(BALL_ANGLE, math.acos(least) / 4)
    _, first, same = np.unique(np.stack([d0, d1], 1), axis=0, return_index=True, return_inverse=True)
    stands, radius = first[same.ravel()], np.zeros(n)
    own = np.flatnonzero((stands == np.arange(n)) & (np.bincount(stands, minlength=n) < BALL_LEAST))
    own = own[np.argsort(cell[own], kind="stable")]
    cuts = np.flatnonzero(np.append(True, cell[own][1:] != cell[own][:-1])) if len(own) else []
    centre_of = np.arange(n)
    for left in np.split(own, cuts[1:]) if len(own) else []:
        for _ in range(BALL_TRIES):
            if len(left) < BALL_LEAST:
                break
            angle = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
            angle[0] = 0.0
            near = np.flatnonzero(angle <= widest)[:BALL_MOST]
            if len(near) >= BALL_LEAST:
                centre_of[left[near]] = left[0]
                radius[left[0]] = angle[near].max() + MARGIN
                left = np.delete(left, near)
            else:
                left = left[1:]
    stands = centre_of[stands]
    return stands, radius[stands]


def _placed(rows: DataFrame, indexes: dict[int, MultiIndex], least: float) -> DataFrame:
    """rid, vec_id, v and, for vectors that can have links: the row that stands for it, ball radius, and on rows that stand for
    others their number and least vec_id; digests; visited cells and their rooms."""
    kind = rows.schema["v"].dataType.simpleString()
    schema = f"rid long, vec_id long, v {kind}, item long, r double, w long, lo long, d0 long, d1 long, visits array<long>, rooms array<long>"
    shared = rows.sparkSession.sparkContext.broadcast(indexes)  # two codebooks a vector length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rid = batch.column(0).to_numpy()
            ids, known = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            item, there = np.zeros(n, np.int64), np.zeros(n, bool)
            r, w, low = np.zeros(n), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
            d = np.zeros((2, n), np.int64)
            visits: list = [None] * n
            rooms: list = [None] * n
            for at, x in row_matrices(batch.column(2)):
                index, d[0, at], d[1, at] = shared.value[x.shape[1]], *digests(x)
                x = unit(x)
                cells, into = index.place(x)
                stands, radius = balls(x, cells[:, 0], d[0, at], d[1, at], least)
                item[at], there[at], r[at] = rid[at[stands]], True, radius
                np.add.at(w, at[stands], 1)
                np.minimum.at(low, at[stands], np.where(known[at], ids[at], np.iinfo(np.int64).max))
                for k in np.flatnonzero(stands == np.arange(len(at))).tolist():
                    visits[at[k]], rooms[at[k]] = cells[k], into[k]
            none = ~there
            columns = [
                batch.column(0), batch.column(1), batch.column(2), pa.array(item, pa.int64(), mask=none), pa.array(r, pa.float64(), mask=none),
                pa.array(w, pa.int64()), pa.array(low, pa.int64(), mask=low == np.iinfo(np.int64).max), pa.array(d[0], pa.int64(), mask=none), pa.array(d[1], pa.int64(), mask=none),
                pa.array(visits, pa.list_(pa.int64())), pa.array(rooms, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "vec_id", "v", "item", "r", "w", "lo", "d0", "d1", "visits", "rooms"])

    return written(rows.select("rid", "vec_id", "v").mapInArrow(run, schema), "vectors")


# Rooms -----------------------------------------------------------------------------------------------

MET = "kind int, a long, b long, n long"
COUNT, LINK, UNSURE, MEMBER_COUNT = 0, 1, 2, 3


class _Links:
    """Link counts of local rows, and a forest of their classes in place of all pairs."""

    def __init__(self, rows: int):
        self.count, self.root = np.zeros(rows, np.int64), np.arange(rows)

    def add(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        if not len(x):
            return
        self.count += np.bincount(x, w[y], len(self.root)).astype(np.int64) + np.bincount(y, w[x], len(self.root)).astype(np.int64)
        while True:
            p, q = self.root[x], self.root[y]
            apart = p != q
            if not apart.any():
                return
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _rows_out(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    kinds = np.concatenate([np.full(len(a), k, np.int32) for k, a, _, _ in parts])
    return pa.table({"kind": pa.array(kinds, pa.int32()), **{c: pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i, c in ((1, "a"), (2, "b"), (3, "n"))}})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return unit(np.concatenate([x for _, x in row_matrices(column, 1 << 62)])) if len(column) else np.zeros((0, 1))


def meet(rows: pa.Table, least: float) -> pa.Table:
    """Meetings of one room (or part of one): every visitor with the members of the cells it visits, a matrix product a cell.

    A pair whose sides visit each other's cells is looked at in the lesser cell alone. Two balls of radii p and q and centre angle t
    are wholly linked if t + p + q is within the limit, apart if t - p - q is beyond it, and otherwise returned as unsure.
    """
    limit = math.acos(least)
    x = _matrix(rows.column("v"))
    item, r, w, member, visitor = (rows.column(c).to_numpy() for c in ("item", "r", "w", "member", "visitor"))
    visits = rows.column("visits").combine_chunks()
    each = len(visits.flatten()) // max(1, len(item))
    visits = visits.flatten().to_numpy().reshape(len(item), each)
    own = visits[:, 0]
    members = np.flatnonzero(member)
    members = members[np.argsort(own[members], kind="stable")]
    cells, starts = np.unique(own[members], return_index=True)
    asking = np.repeat(np.flatnonzero(visitor), each)
    asked = visits[visitor].ravel()
    held = np.isin(asked, cells)
    asking, asked = asking[held], asked[held]
    order = np.argsort(asked, kind="stable")
    asking, begin = asking[order], np.searchsorted(asked[order], np.append(cells, np.iinfo(np.int64).max))
    links, unsure = _Links(len(item)), []
    for c, (cell, ys) in enumerate(zip(cells.tolist(), np.split(members, starts)[1:], strict=True)):
        guests = asking[begin[c] : begin[c + 1]]
        wide = limit + r[ys].max(initial=0.0) + MARGIN
        for lo in range(0, len(guests), _BLOCK):
            xs = guests[lo : lo + _BLOCK]
            widest = wide + r[xs].max()
            floor = least if widest == limit + MARGIN else math.cos(min(math.pi, widest))
            s = x[xs] @ x[ys].T
            i, j = np.nonzero(s >= floor)
            s, i, j = s[i, j], xs[i], ys[j]
            here = (own[i] == cell) & (item[i] > item[j])
            far = np.flatnonzero(own[i] != cell)
            mutual = (visits[j[far]] == own[i[far], None]).any(1)
            here[far] = ~mutual | (own[i[far]] > cell)
            s, i, j = s[here], i[here], j[here]
            ball = r[i] + r[j]
            sure = np.where(ball == 0, s >= least, False)
            if (ball > 0).any():
                angle = np.arccos(np.clip(s, -1, 1))
                sure |= (ball > 0) & (angle + ball <= limit - MARGIN)
                open_ = (ball > 0) & ~sure & (angle - ball <= limit + MARGIN)
                unsure.append((item[i[open_]], item[j[open_]]))
            links.add(i[sure], j[sure], w)
    counted, tied = np.flatnonzero(links.count), np.flatnonzero(links.root != np.arange(len(item)))
    parts = [(COUNT, item[counted], item[counted], links.count[counted]), (LINK, item[tied], item[links.root[tied]], tied)]
    return _rows_out(parts + [(UNSURE, a, b, a) for a, b in unsure])


def verify(rows: pa.Table, least: float) -> pa.Table:
    """Members of two balls, compared in blocks: counts by member, and a link between the balls if any pair has one."""
    x = _matrix(rows.column("v"))
    rid, w, side = (rows.column(c).to_numpy() for c in ("rid", "w", "side"))
    single = rows.column("single").to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    count = np.zeros(len(rid), np.int64)
    for lo in range(0, len(left), _BLOCK):
        for hi in range(0, len(right), 8 * _BLOCK):
            p, q = left[lo : lo + _BLOCK], right[hi : hi + 8 * _BLOCK]
            linked = x[p] @ x[q].T >= least
            count[p] += linked @ w[q]
            count[q] += w[p] @ linked
    a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    some, kinds = np.flatnonzero(count), []
    for kind, of in ((COUNT, some[single[some]]), (MEMBER_COUNT, some[~single[some]])):
        kinds.append((kind, rid[of], rid[of], count[of]))
    pair = np.array([[a], [b]]) if len(some) else np.zeros((2, 0), np.int64)
    return _rows_out([*kinds, (LINK, pair[0], pair[1], pair[0])])


def _meetings(items: DataFrame, least: float) -> DataFrame:
    """Rows of MET: every item is sent once to each room it visits, not once to each cell."""
    sent = items.withColumn("home", F.element_at("rooms", 1)).withColumn("room", F.explode(F.array_distinct("rooms")))
    loads = sent.groupBy("room").agg(F.count("*").alias("here"), F.count_if(F.col("room") == F.col("home")).alias("held"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(2.0 * ROOM_ROWS)).cast("int")
    crowded = written(loads.filter(F.col("here") > 2 * ROOM_ROWS).select("room", F.greatest(parts("held"), F.lit(1)).alias("ka"), parts("here").alias("kb")), "crowded")
    dealt = sent.join(small(crowded, BROADCAST_ROWS), "room", "left")
    part = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "item"), F.coalesce(k, F.lit(1))).cast("int")
    dealt = dealt.withColumn("a0", part(3, F.col("ka"))).withColumn("b0", part(4, F.col("kb")))
    upto = lambda k: F.sequence(F.lit(0), F.coalesce(k, F.lit(1)) - 1)
    task = lambda a, b, member, visitor: F.struct(a.alias("a"), b.alias("b"), member.alias("member"), visitor.alias("visitor"))
    home = F.col("room") == F.col("home")
    as_member = F.transform(upto(F.col("kb")), lambda b: task(F.col("a0"), b, F.lit(True), b == F.col("b0")))
    as_visitor = F.transform(F.filter(upto(F.col("ka")), lambda a: ~home | (a != F.col("a0"))), lambda a: task(a, F.col("b0"), F.lit(False), F.lit(True)))
    tasks = F.when(home, F.concat(as_member, as_visitor)).otherwise(as_visitor)
    dealt = dealt.withColumn("t", F.explode(tasks)).select("room", "t.a", "t.b", "t.member", "t.visitor", "item", "v", "r", "w", "visits")
    return written(dealt.groupBy("room", "a", "b").applyInArrow(lambda rows: meet(rows, least), MET), "met")


def _verified(met: DataFrame, placed: DataFrame, items: DataFrame, least: float) -> DataFrame | None:
    """Rows of MET for the pairs of balls that were left unsure; None if there are none."""
    pairs = met.filter(F.col("kind") == UNSURE).select("a", "b")
    if pairs.isEmpty():
        return None
    asked = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    one = items.filter("r = 0").select("item", F.col("item").alias("rid"), "v", "w", F.lit(True).alias("single"))
    many = placed.filter("r > 0").select("item", "rid", "v", F.lit(1).cast("long").alias("w"), F.lit(False).alias("single"))
    members = written(one.union(many).join(asked, "item", "left_semi"), "members")
    sides = [pairs.withColumn("item", F.col(c)).join(members, "item").drop("item").withColumn("side", F.lit(k)) for k, c in enumerate("ab")]
    return written(sides[0].union(sides[1]).groupBy("a", "b").applyInArrow(lambda rows: verify(rows, least), MET), "verified")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: vectors linked by a cosine of `least` or more.

    Every vector lies in a cell of the multi-index of its length and visits the nearest cells, as many as the recall asks for; a pair is
    looked at if either side visits the other's cell, and linked by its exact cosine in double precision. Rooms (blocks of cells) get each
    vector once and make a matrix product a cell. Equal vectors are one item with a weight, and crowds of near vectors in a cell are balls whose
    links are counted whole where the angles allow, and member by member elsewhere; only counts and a forest of links leave a task, never
    all pairs. No partner is capped and a crowded room is met in parts.

    Vectors of different lengths do not link. Null, empty and zero vectors and those with null or non-finite numbers link with nothing. Each row is a
    vector of its own, so a repeated row counts as one more link of its equals. A row with a null id is linked like any other; component_id
    is the least id of the class, null only in a class without ids, whose rows are all kept. An empty table gives an
    empty result. Other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType
    wide = not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType))
    stored_as = F.col(vector_col).cast("array<double>") if wide else F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), stored_as.alias("v")).withColumn("rid", F.monotonically_increasing_id())
    placed = _placed(rows, fit_indexes(rows, least), least)

    centres = placed.filter("rid = item")
    equal = centres.filter("r = 0").groupBy("d0", "d1").agg(F.min("item").alias("rep"), F.sum("w").alias("all"), F.min("lo").alias("low"), F.count("*").alias("n"))
    equal = small(written(equal.filter("n > 1").drop("n"), "equal"), BROADCAST_ROWS)
    alone = F.col("rep").isNull() | (F.col("r") > 0)
    chosen = [F.when(alone, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("item", "rep", "rep"), ("w", "all", "w"), ("lo", "low", "lo"))]
    joined = centres.join(equal, ["d0", "d1"], "left").select("item", "v", "r", "visits", "rooms", *chosen)
    items = joined.filter("item = rep").select("item", "v", "r", "w", "lo", "visits", "rooms")

    met = _meetings(items, least)
    more = _verified(met, placed, items, least)
    met = met.filter(F.col("kind") != UNSURE)
    met = met if more is None else met.union(more)
    counts = met.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("met"))
    classes = components(met.filter(F.col("kind") == LINK).select("a", "b")).withColumnRenamed("node", "item")
    known = items.select("item", "w", "lo").join(classes, "item", "left").join(counts, "item", "left")
    known = written(known.select("item", F.coalesce("component", "item").alias("component"), (F.col("w") - 1 + F.coalesce("met", F.lit(0))).alias("n"), "lo"), "known")
    least_id = known.filter("lo is not null").groupBy("component").agg(F.min("lo").alias("least"))
    known = known.join(least_id, "component", "left").select(F.col("item").alias("rep"), "n", "least")
    answers = joined.select("item", "rep").join(known, "rep").select("item", "n", "least")

    out = placed.select("rid", "vec_id", "item").join(answers, "item", "left")
    links = F.coalesce("n", F.lit(0))
    if more is not None:
        single = more.filter(F.col("kind") == MEMBER_COUNT).groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("alone"))
        out = out.join(single, "rid", "left")
        links = links + F.coalesce("alone", F.lit(0))
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))


def links_by_brute_force(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = PROBE_ROWS) -> DataFrame:
    """vec_id, n_links of about `sample` vectors with an id, drawn by a hash, against all rows: what the recall of near_vectors is measured by. Ids are unique here."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.filter(F.col("vec_id").isNotNull() & (F.pmod(F.xxhash64(F.lit(77), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(2 * sample).toArrow()
    ids, probes = drawn.column("vec_id").to_numpy(), {}
    for at, x in row_matrices(drawn.column("v")):
        probes.setdefault(x.shape[1], []).append((ids[at], unit(x)))
    shared = vectors.sparkSession.sparkContext.broadcast(probes)  # at most 2 * sample vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in row_matrices(batch.column(0)):
                for own, q in shared.value.get(x.shape[1], []):
                    yield pa.RecordBatch.from_pydict({"vec_id": own, "n": (q @ unit(x).T >= least).sum(1)})

    return rows.select("v").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n_links"))


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
