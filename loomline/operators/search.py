"""Ranking tables of queries against tables of documents: keyword, vector, fused, rescored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.scratch import stored
from loomline.functions.sizing import broadcast_if_small as small
from loomline.functions.sizing import is_small, spread
from loomline.functions.text import tokenize
from loomline.operators.index import counted

#: Query terms up to this many rows are broadcast to the postings; more shuffle.
BROADCAST_TERMS = 500_000
#: Postings of a query that a search with pruning adds up first, and how that grows; how far below the floor the last terms stay; what a comparison of scores leaves to rounding.
HEAD, GROWTH, REACH, SLACK = 4000, 4, 0.85, 2e-6
#: Blocks and postings of a part of an index that meets a part of the queries in one group of a task, documents of a part of an index of rows, and query terms of a part of the queries (12 bytes each); scores that a task holds at once.
PART_BLOCKS, PART_POSTINGS, PART_DOCS, PART_TERMS, SCORES = 16, 4_000_000, 16_384, 6_000_000, 4_000_000
#: Query terms, and queries of a search by vectors, from which blocks of queries meet all documents in a task each; fewer are broadcast.
MANY_TERMS, MANY_QUERIES = 100_000, 4096
#: Entries of a task's matrix of frequent terms, and the share of the pairs of a query and a document that hold a term from which it is one: a product of matrices pays for all pairs. Of so many documents the first one gives the scores that the others have to reach.
MATRIX, FREQUENT, LEAD = 4_000_000, 1 / 400, 16
#: Numbers that are gathered at once to score what single precision leaves over, and how far a sum of k products of it may be off, as a share of what the absolute products add up to: k + ROUNDED times EPS.
GATHERED, ROUNDED, EPS = 4_000_000, 8, 2.0**-23
#: Queries of a block, documents of a packed row that meets them and its bytes, and documents of a part of a cell of the search by cells.
QUERY_BLOCK, DOC_BLOCK, PACK_BYTES, CELL_BLOCK = 32_768, 8192, 8 << 20, 131_072
#: Queries that may be broadcast, in rows and bytes; documents of a part that meets them; bytes of a block of vectors, and of the packed rows that are scored at once.
QUERY_ROWS, QUERY_BYTES, DOC_PART, BLOCK_BYTES, PART_BYTES = 262_144, 128 << 20, 32_768, 128 << 20, 32 << 20
#: A task that meets documents part by part keeps up to so many times n rows a query before it cuts them down to n.
KEPT = 3
#: Documents and queries of a product that stays in a core's cache.
DOC_TILE, QUERY_TILE = 1024, 256


def top(scored: DataFrame, n: int, method: str | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, doc_id, score of the n best by rounded score; ties by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "doc_id")
    ranked = scored.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    ranked = ranked.withColumn("method", F.lit(method)) if method else ranked
    return ranked


def _asked_terms(queries: DataFrame, index: dict[str, DataFrame], k1: float, b: float) -> DataFrame:
    """query_id, term, weight (qtf * idf), df, avgdl and most (the largest score that a posting of the term can add), of an index of blocks; stored."""
    asked = queries.select("query_id", F.explode_outer(tokenize(F.coalesce("text", F.lit("")))).alias("term")).filter("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    known = asked.join(index["terms"], "term").crossJoin(F.broadcast(index["corpus"].select("n", "avgdl")))  # one row
    weight = F.col("qtf") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = known.withColumn("weight", weight)
    known = known.withColumn("most", F.col("weight") * _tf_part(F.col("max_tf"), F.col("min_dl"), k1, b))
    return stored(known.select("query_id", "term", "weight", "df", "avgdl", "most"), "asked")


def _asked_rows(queries: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """query_id, codes, weights (qtf * idf), avgdl: a row a query that asks for a term of an index of rows; stored. The index's terms are sent to the queries, so no row is made for a term."""
    spark = queries.sparkSession
    rows, keys, nulls = queries.agg(F.count("*"), F.count_distinct("query_id"), F.count_if(F.col("query_id").isNull())).first()
    if rows != keys + min(nulls, 1):  # rows of one id are one query
        queries = queries.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    n, avgdl = index["corpus"].select("n", "avgdl").first()
    terms = index["terms"].select("term", "code", "df").toArrow()  # as many as index.asked_index() allows
    df = terms.column("df").to_numpy()
    shared = spark.sparkContext.broadcast((terms.column("term").combine_chunks(), terms.column("code").to_numpy(), np.log(1 + (n - df + 0.5) / (df + 0.5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, idf = shared.value
        for made in counted(names, batches):
            at, qtf = (made.column(c).flatten().to_numpy() for c in ("codes", "tfs"))
            ends = made.column("codes").offsets
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (codes[at], qtf * idf[at])]
            yield pa.RecordBatch.from_arrays([made.column("doc_id"), *lists], ["query_id", "codes", "weights"]).filter(pc.greater(pc.list_value_length(lists[0]), 0))

    texts = spread(queries.select(F.col("query_id").alias("doc_id"), "text")).select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("terms"))
    return stored(texts.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, codes array<int>, weights array<double>").withColumn("avgdl", F.lit(avgdl)), "asked")


def _tf_part(tf: Column, dl: Column, k1: float, b: float) -> Column:
    """Grows with tf and falls with dl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _added_up(terms: DataFrame, blocks: DataFrame, k1: float, b: float) -> DataFrame:
    """query_id, block, doc_id, score: what the given terms of each query add, over all their postings.

    Where the terms are few enough to be broadcast, the blocks they need are dealt by block, so that a document's scores are summed and each query's
    best are picked inside the task that holds it. Where they are not, they meet the blocks in a join by term and slice, for which the blocks' buckets need no exchange.
    """
    if is_small(terms, BROADCAST_TERMS):
        needed = blocks.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").repartition("block")
        met = needed.join(F.broadcast(terms), "term")
    else:
        slices = blocks.agg(F.max("slice")).first()[0] or 0
        terms = terms.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices)))) if slices else terms
        met = blocks.join(terms, ["term", "slice"] if slices else "term")
    rows = met.select("query_id", "block", "weight", "avgdl", F.inline("postings"))
    return rows.groupBy("query_id", "block", F.col("key").alias("doc_id")).agg(F.sum(F.col("weight") * _tf_part(F.col("tf"), F.col("dl"), k1, b)).alias("score"))


def _nth(scored: DataFrame, n: int) -> DataFrame:
    """query_id, floor: the n-th best score of each query; none where there are fewer."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    return ranked.filter(F.col("rank") <= n).groupBy("query_id").agg(F.min("score").alias("floor"), F.max("rank").alias("found")).filter(F.col("found") == n).select("query_id", "floor")


def _pruned(known: DataFrame, index: dict[str, DataFrame], n: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of all documents that may be among each query's n best; the terms of which all postings were added up; and what was looked up for single documents.

    Each query's terms are added up in order of what they can add most, in rounds of HEAD, HEAD * GROWTH, ... postings. The n-th best sum so far is a floor: no document under it ranks. The terms at the
    end of the order that together cannot reach the share REACH of the floor are left for last, as a document that holds nothing else cannot rank; rounds end when only those are left. What then cannot reach the floor with the most
    that they can add goes, and only for what stays are their postings looked up, a few terms at a time, with the floor raised in between. Sums in floating point are compared with SLACK to spare.
    """
    by_most = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    order = known.withColumn("before", F.coalesce(F.sum("df").over(by_most.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = order.withColumn("rest", F.sum("most").over(by_most.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    order = stored(order.withColumns({"added": F.lit(False), "last": F.lit(False)}), "order")
    budget, sums, floors = HEAD, None, None
    while sums is None or not order.filter("not added and not last").isEmpty():
        now = ~F.col("added") & ~F.col("last") & (F.col("before") < budget)
        new = _added_up(order.filter(now), index["blocks"], k1, b)
        sums = new if sums is None else sums.unionByName(new).groupBy("query_id", "block", "doc_id").agg(F.sum("score").alias("score"))
        sums = stored(sums, "sums")
        floors = stored(_nth(sums, n), "floors")
        reached = order.withColumn("added", F.col("added") | now).join(small(floors, BROADCAST_TERMS), "query_id", "left")
        out_of_reach = ~F.col("added") & F.coalesce(F.col("rest") < REACH * F.col("floor") - SLACK, F.lit(False))
        order = stored(reached.withColumn("last", out_of_reach).drop("floor"), "order")
        budget *= GROWTH
    whole = order.filter("not last")
    last = order.filter("last").withColumn("place", F.row_number().over(by_most) - 1)
    near, looked, lo, hi = sums, None, 0, 1
    while True:
        reach = last.filter(F.col("place") >= lo).groupBy("query_id").agg(F.sum("most").alias("reach"))
        near = near.join(small(floors, BROADCAST_TERMS), "query_id", "left").join(small(reach, BROADCAST_TERMS), "query_id", "left")
        near = near.filter(F.col("floor").isNull() | (F.col("score") + F.coalesce("reach", F.lit(0.0)) >= F.col("floor") - SLACK))
        near = stored(near.select("query_id", "block", "doc_id", "score"), "near")
        terms = last.filter((F.col("place") >= lo) & (F.col("place") < hi))
        if terms.isEmpty():
            break
        found = stored(_looked_up(near, terms, index["blocks"], k1, b), "looked")
        looked = found if looked is None else looked.unionByName(found)
        near = stored(near.unionByName(found).groupBy("query_id", "block", "doc_id").agg(F.sum("score").alias("score")), "sums")
        floors = stored(_nth(near, n), "floors")
        lo, hi = hi, 2 * hi + 1
    return near.select("query_id", "doc_id", "score"), whole, looked if looked is not None else near.limit(0)


def _looked_up(near: DataFrame, terms: DataFrame, blocks: DataFrame, k1: float, b: float) -> DataFrame:
    """query_id, block, doc_id, score: what single documents (near) get of the given terms. Only blocks that hold such a document are unfolded."""
    wanted = stored(near.select("query_id", "block", "doc_id").join(small(terms, BROADCAST_TERMS).select("query_id", "term", "weight", "avgdl"), "query_id"), "wanted")
    held = blocks.join(small(stored(wanted.select("term", "block").distinct(), "spots"), BROADCAST_TERMS), ["term", "block"])
    rows = held.select("term", "block", F.inline("postings"))
    met = rows.join(small(wanted, BROADCAST_TERMS).withColumnsRenamed({"term": "t", "block": "at"}), (F.col("term") == F.col("t")) & (F.col("block") == F.col("at")) & F.col("key").eqNullSafe(F.col("doc_id")))
    return met.select("query_id", "block", "doc_id", (F.col("weight") * _tf_part(F.col("tf"), F.col("dl"), k1, b)).alias("score"))


def _scored(held: pa.Table, asked: pa.Table, n: int, k1: float, b: float) -> pa.Table:
    """query_id, doc_id, score of the n best documents of some blocks (term, postings) for each query of a table of terms (query_id, term, weight, avgdl)."""
    flat = held.column("postings").combine_chunks().flatten()
    words, keys = held.column("term").combine_chunks().dictionary_encode(), flat.field("key").dictionary_encode(null_encoding="encode")
    sizes = pc.list_value_length(held.column("postings").combine_chunks()).to_numpy(zero_copy_only=False)
    term = pc.index_in(asked.column("term").combine_chunks(), words.dictionary)
    asks = asked.select(["query_id", "weight", "avgdl"]).append_column("code", term).filter(pc.is_valid(term))
    ids = asks.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    order = np.argsort(ids.indices.to_numpy(), kind="stable")
    terms = [x[order] for x in (ids.indices.to_numpy(), asks.column("code").to_numpy(), asks.column("weight").to_numpy())]
    postings = np.repeat(words.indices.to_numpy(), sizes), keys.indices.to_numpy(), flat.field("tf").to_numpy(), flat.field("dl").to_numpy()
    avgdl = asks.column("avgdl")[0].as_py() if asks.num_rows else 1.0
    return _best_of_postings(*postings, keys.dictionary, ids.dictionary, *terms, avgdl, n, k1, b)


def _unfolded(asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, float]:
    """Ids of the queries of a table (query_id, codes, weights, avgdl); place of the query, code and weight of each of their terms; avgdl."""
    codes, weights = asked.column("codes").combine_chunks(), asked.column("weights").combine_chunks()
    query = np.repeat(np.arange(asked.num_rows, dtype=np.int32), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
    avgdl = asked.column("avgdl")[0].as_py() if asked.num_rows else 1.0
    return asked.column("query_id").combine_chunks(), query, codes.flatten().to_numpy(), weights.flatten().to_numpy(), avgdl


def _scored_rows(held: pa.Table, asked: tuple, n: int, k1: float, b: float, floors: np.ndarray | None = None) -> pa.Table:
    """As _scored(), of rows (doc_id, dl, codes, tfs) and unfolded queries."""
    codes, tfs = held.column("codes").combine_chunks(), held.column("tfs").combine_chunks()
    sizes = pc.list_value_length(codes).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(sizes)), sizes)
    postings = codes.flatten().to_numpy(), at, tfs.flatten().to_numpy(), held.column("dl").to_numpy()[at]
    return _best_of_postings(*postings, held.column("doc_id").combine_chunks(), *asked, n, k1, b, floors)


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a with rows j of b, in double precision."""
    step = max(1, GATHERED // max(1, a.shape[1]))
    parts = [np.einsum("ij,ij->i", a[i[lo : lo + step]], b[j[lo : lo + step]]) for lo in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _likely(q: np.ndarray, rough: np.ndarray, n: int, slack: float, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs with scores that may be off by half of slack: which may be among their query's n best, and what each query's others have to reach."""
    if not len(q):
        return np.zeros(0, bool), np.full(queries, -np.inf, np.float32)
    span = 2 * float(np.abs(rough).max()) + 1
    key = np.sort(q * span - rough.astype(np.float64))  # by query, then falling
    counts = np.bincount(q, minlength=queries)
    nth = np.minimum(np.cumsum(counts) - counts + n - 1, len(key) - 1)
    least = np.where(counts >= n, np.arange(queries) * span - key[nth] - slack, -np.inf).astype(np.float32)
    return rough >= least[q], least


def _first(q: np.ndarray, at: np.ndarray, scores: np.ndarray, place: np.ndarray, n: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores of pairs, each query's n best by rounded score, ties by place; raises the queries' floors to the n-th."""
    order = np.lexsort((place[at], -np.round(scores, 6), q))
    q, at, scores = q[order], at[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    nth = rank == n - 1
    floors[q[nth]] = np.fmax(floors[q[nth]], scores[nth])
    return q[rank < n], at[rank < n], scores[rank < n]


def _best_of_postings(of: np.ndarray, at: np.ndarray, tf: np.ndarray, dl: np.ndarray, keys: pa.Array, names: pa.Array, query: np.ndarray, term: np.ndarray, weight: np.ndarray, avgdl: float, n: int, k1: float, b: float, floors: np.ndarray | None = None) -> pa.Table:
    """query_id, doc_id, score of the n best documents (keys) for each query (names); of, at, tf, dl: term, place of the document, count and length of each posting; query, term, weight: the queries' terms, by query.

    Terms that many queries share and many documents hold are one product of matrices in single precision; the postings of the others are added up query by query, in double. What such a sum, with all that it may be
    off, leaves below a query's floor cannot rank; only the others are scored in double precision throughout. Floors are the n-th best scores that are known of each query, here those of the first documents, and are raised for the next call.
    """
    parts = [pa.table({"query_id": names.slice(0, 0), "doc_id": keys.slice(0, 0), "score": pa.array([], pa.float64())})]
    if not len(of) or not len(query):
        return parts[0]
    floors = np.full(len(names), -np.inf) if floors is None else floors
    order = np.sort(of.astype(np.int64) << 32 | np.arange(len(of))) & 0xFFFFFFFF  # as a stable argsort, but sorted as plain numbers
    of, at, tf, dl = of[order], at[order].astype(np.intp), tf[order].astype(np.float64), dl[order].astype(np.float64)
    adds = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    both = np.stack([at, adds], 1)  # so that a span is cut out once
    df = np.bincount(of, minlength=max(of[-1], term.max()) + 1)
    first = np.cumsum(df) - df
    here = df[term] > 0
    query, term, weight = query[here], term[here], weight[here]
    docs = len(keys)
    place = np.empty(docs, np.int64)
    place[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(docs)

    pairs = df * np.bincount(term, minlength=len(df)).astype(np.float64)
    often = np.argsort(-pairs, kind="stable")[: max(1, MATRIX // docs)]
    often = often[pairs[often] >= FREQUENT * docs * len(names)]
    column = np.full(len(df), -1)
    column[often] = np.arange(len(often))
    matrix, row = np.zeros((docs, len(often))), column[of]
    matrix[at[row >= 0], row[row >= 0]] = adds[row >= 0]
    del order, of, tf, dl, row
    rough, most, lead = matrix.astype(np.float32).T, adds.max(), max(n, docs // LEAD)

    step = max(1, SCORES // docs)
    held, none, plain = np.empty((min(step, len(names)), docs), np.float32), np.zeros(docs), np.empty(docs, np.float32)
    for lo in range(0, len(names), step):
        rows = slice(*np.searchsorted(query, [lo, lo + step]))
        if rows.start == rows.stop:
            continue
        q, t, w = query[rows] - lo, term[rows], weight[rows]
        much = column[t] >= 0
        asks = np.zeros((q[-1] + 1, len(often)))
        asks[q[much], column[t[much]]] = w[much]
        scores = np.matmul(asks.astype(np.float32), rough, out=held[: len(asks)])
        slack = SLACK + 2 * (len(often) + ROUNDED) * EPS * most * np.bincount(q, w, len(asks))
        q, t, w = q[~much], t[~much], w[~much]
        ends, starts, counts = np.searchsorted(q, np.arange(len(asks) + 1)).tolist(), first[t].tolist(), df[t]
        stops, found, rest = (first[t] + counts).tolist(), [], []
        for i, sums in enumerate(scores):
            own = slice(ends[i], ends[i + 1])
            less = none
            if own.start < own.stop:
                cut = np.concatenate([both[x:y] for x, y in zip(starts[own], stops[own], strict=True)])
                less = np.bincount(cut[:, 0].astype(np.intp), cut[:, 1] * np.repeat(w[own], counts[own]), docs)
                plain[:] = less
                sums += plain
            floor = floors[lo + i]
            if docs > n:
                floor = max(floor, np.partition(sums[:lead], lead - n)[lead - n])
            hit = np.flatnonzero(sums >= np.float32(max(floor - slack[i], 1e-30)))
            if len(hit) > n:
                likely = sums[hit]
                hit = hit[likely >= np.partition(likely, len(hit) - n)[len(hit) - n] - slack[i]]
            found.append(hit)
            rest.append(less[hit])
        q, best = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
        q, best, exact = _first(q, best, np.concatenate(rest) + _dots(asks, q, matrix, best), place, n, floors[lo : lo + step])
        parts.append(pa.table({"query_id": names.take(pa.array(q + lo)), "doc_id": keys.take(pa.array(best)), "score": pa.array(exact, pa.float64())}))
    return pa.concat_tables(parts)


def _best_of_blocks(known: DataFrame, index: dict[str, DataFrame], n: int, k1: float, b: float) -> DataFrame:
    """query_id, doc_id, score: each query's n best of each part of the index, over all postings of its terms.

    The blocks that hold a term asked for are dealt into parts of PART_BLOCKS blocks and PART_POSTINGS postings at most (a block at least), the queries by a hash into parts of some PART_TERMS terms.
    Each pair of parts is a group, scored in one task: what a task holds does not grow with the tables, and no row is made for a document that is not among its part's best.
    """
    terms = known.groupBy("term").agg(F.max("df").alias("df"), F.count("*").alias("asked"))
    asked, words, postings = terms.agg(F.coalesce(F.sum("asked"), F.lit(0)), F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    blocks, cores = index["corpus"].first()["blocks"], known.sparkSession.sparkContext.defaultParallelism
    over = max(1, -(-asked // PART_TERMS))
    down = min(blocks, max(-(-blocks // PART_BLOCKS), -(-postings // PART_POSTINGS), -(-2 * cores // over)))
    dealt = 3 * over * down  # so that few groups fall together by their hash
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    held = index["blocks"].join(F.broadcast(terms.select("term")) if words <= BROADCAST_TERMS else terms.select("term"), "term", "left_semi")
    left = held.select("term", "postings", (F.col("block") % down).alias("_d"), every(over).alias("_q")).repartition(dealt, "_d", "_q")
    right = known.select("query_id", "term", "weight", "avgdl", F.pmod(F.xxhash64("query_id"), F.lit(over)).cast("int").alias("_q"), every(down).alias("_d")).repartition(dealt, "_d", "_q")
    key = index["blocks"].schema["postings"].dataType.elementType["key"].dataType.simpleString()
    schema = f"query_id {dict(known.dtypes)['query_id']}, doc_id {key}, score double"
    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(lambda held, asked: _scored(held, asked, n, k1, b), schema)


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _packed(rows: DataFrame, name: str, docs: int | None = None) -> DataFrame:
    """_q and a binary column `name`: the rows of each partition as packed tables, of up to `docs` rows and PACK_BYTES where `docs` is given, else one a partition. _q is the place of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, full, place = [], 0, 0, TaskContext.get().partitionId()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([_bytes(pa.Table.from_batches(held))], pa.binary())], ["_q", name])
        for batch in batches:
            step = max(1, min(docs, batch.num_rows * PACK_BYTES // max(batch.nbytes, 1))) if docs else max(1, batch.num_rows)
            for lo in range(0, batch.num_rows, step):
                held.append(batch.slice(lo, step))
                size, full = size + held[-1].num_rows, full + held[-1].nbytes
                if docs and (size >= docs or full >= PACK_BYTES):
                    yield pack()
                    held, size, full = [], 0, 0
        if held:
            yield pack()

    return rows.mapInArrow(run, f"_q int, {name} binary")


def _first_rows(found: pa.Table, n: int) -> pa.Table:
    """Each query's n best rows by rounded score, ties by document."""
    q = found.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    place = np.empty(len(q), np.int64)
    place[pc.array_sort_indices(found.column("doc_id").combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(q))
    q, at, _ = _first(q, np.arange(len(q)), found.column("score").to_numpy(), place, n, np.full(len(q), -np.inf))
    return found.take(pa.array(at))


def _product(docs: DataFrame, queries: DataFrame, blocks: int, per: int, begin: Callable[[pa.Table], tuple[Callable[[pa.Table], None], Callable[[], pa.Table]]], schema: str) -> DataFrame:
    """What becomes of blocks of queries (query_id, ...) that each meet all documents, part by part, in a task. begin(block) gives what is called for each part of the documents, and what gives the rows at the end.

    Queries are dealt by a hash into blocks, a row and a partition each. Documents lie packed in storage and every block's task reads them from there, so neither side is copied on disk for the other; parts have some `per`
    documents or PART_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, end, held, rows, size = None, None, [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if add is None:  # one block is all that a task meets
                    add, end = begin(pa.ipc.open_stream(batch.column("asked")[i].as_buffer()).read_all())
                held.append(pa.ipc.open_stream(batch.column("held")[i].as_buffer()).read_all())
                rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
                if rows >= per or size >= PART_BYTES:
                    add(pa.concat_tables(held))
                    held, rows, size = [], 0, 0
        if held:
            add(pa.concat_tables(held))
        if add:
            yield from end().to_batches()
        pa.default_memory_pool().release_unused()

    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = cores * max(1, -(-blocks // cores))
    dealt = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartitionById(blocks, "_q").drop("_q")
    held = stored(_packed(docs, "held", DOC_BLOCK), "held").select("held")
    asked = stored(_packed(dealt, "asked"), "blocks").repartitionById(blocks, "_q").select("asked")
    met = held.coalesce(1).hint("shuffle_replicate_nl").crossJoin(asked)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition; only that row takes the block along
    return met.select("held", F.when(first, F.col("asked")).alias("asked")).mapInArrow(run, schema)


def _best_of(score: Callable[[pa.Table, np.ndarray], pa.Table], asked: int, n: int) -> tuple[Callable[[pa.Table], None], Callable[[], pa.Table]]:
    """For _product(): each of so many queries' n best. score(docs, floors) raises the queries' floors, so what a part leaves is what the next has to reach; no more than KEPT * n rows a query are held."""
    floors, found = np.full(asked, -np.inf), []

    def add(held: pa.Table) -> None:
        found.append(score(held, floors))
        if sum(x.num_rows for x in found) > KEPT * n * asked:
            found[:] = [end()]

    def end() -> pa.Table:
        return _first_rows(pa.concat_tables(found), n)

    return add, end


def _best_of_rows(queries: DataFrame, index: dict[str, DataFrame], n: int, k1: float, b: float) -> DataFrame:
    """query_id, doc_id, score: each query's n best of an index of rows, over all terms.

    Where queries have many terms, blocks of them meet all rows in a task each (see _product). Fewer are broadcast, a row a query, and meet the rows where they are. A task scores PART_DOCS rows at a time, and what it found
    sets the floor that the next ones have to reach. What is too much to be broadcast, and not many, is dealt by a hash into parts of some PART_TERMS terms, the rows into parts of some PART_DOCS, and each pair of parts is a group.
    """
    rows, spark = index["rows"], queries.sparkSession
    asking = _asked_rows(queries, index)
    schema = f"query_id {dict(asking.dtypes)['query_id']}, doc_id {dict(rows.dtypes)['doc_id']}, score double"
    asked, size, count = asking.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.col("query_id").cast("string"))), F.lit(0)), F.count("*")).first()
    if asked > MANY_TERMS:

        def begin(block: pa.Table) -> tuple[Callable, Callable]:
            own = _unfolded(block)
            return _best_of(lambda held, floors: _scored_rows(held, own, n, k1, b, floors), block.num_rows, n)

        return _product(rows, asking, max(-(-count // QUERY_BLOCK), -(-asked // PART_TERMS), -(-size // QUERY_BYTES)), PART_DOCS, begin, schema)
    if asked <= PART_TERMS and size <= QUERY_BYTES:
        shared = spark.sparkContext.broadcast(_bytes(asking.toArrow()))  # PART_TERMS terms and QUERY_BYTES of ids at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, floors, held, docs, postings = None, None, [], 0, 0
            for batch in batches:
                if own is None and batch.num_rows:
                    own = _unfolded(pa.ipc.open_stream(shared.value).read_all())
                    floors = np.full(len(own[0]), -np.inf)
                for lo in range(0, batch.num_rows, PART_DOCS // 16):
                    held.append(batch.slice(lo, PART_DOCS // 16))
                    docs, postings = docs + held[-1].num_rows, postings + len(held[-1].column("codes").flatten())
                    if docs >= PART_DOCS or postings >= PART_POSTINGS:
                        yield from _scored_rows(pa.Table.from_batches(held), own, n, k1, b, floors).to_batches()
                        held, docs, postings = [], 0, 0
            if held:
                yield from _scored_rows(pa.Table.from_batches(held), own, n, k1, b, floors).to_batches()

        return spread(rows).mapInArrow(run, schema)

    docs, postings = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    over = max(1, -(-asked // PART_TERMS))
    down = max(1, -(-docs // PART_DOCS), -(-postings // PART_POSTINGS), min(-(-2 * spark.sparkContext.defaultParallelism // over), -(-docs // 1024)))
    dealt = 3 * over * down  # so that few groups fall together by their hash
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumns({"_d": block("doc_id", down), "_q": every(over)}).repartition(dealt, "_d", "_q")
    right = asking.withColumn("_q", block("query_id", over)).withColumn("_d", every(down)).repartition(dealt, "_d", "_q")
    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(lambda held, asked: _scored_rows(held, _unfolded(asked), n, k1, b), schema)


def bm25_search(queries: DataFrame, index: dict[str, DataFrame], n: int = 10, k1: float = 1.5, b: float = 0.75, prune: bool = False) -> DataFrame:
    """Okapi ranking of every query (query_id, text) in one job, exact.

    Query terms count with multiplicity; idf = ln(1 + (N - df + 0.5) / (df + 0.5)); only scores over 0 rank. All postings of the terms are scored, by parts of the index (see _best_of_blocks, and _best_of_rows for an index
    that index.asked_index() made for these queries). With `prune`, postings of a keyword_index that
    cannot bring a document among the n best are not (see _pruned): for few queries of an index so large that reading their postings outweighs some rounds of jobs. All give the same rows.
    """
    if "rows" in index:
        return top(_best_of_rows(queries, index, n, k1, b), n)
    known = _asked_terms(queries, index, k1, b)
    scored = _pruned(known, index, n, k1, b)[0].filter("score > 0") if prune else _best_of_blocks(known, index, n, k1, b)
    return top(scored, n)


def bm25_work(queries: DataFrame, index: dict[str, DataFrame], n: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, postings (of all its terms), scored (those that a search with pruning adds up or looks up)."""
    known = _asked_terms(queries, index, k1, b)
    _, whole, looked = _pruned(known, index, n, k1, b)
    added = whole.select("query_id", F.col("df").alias("scored")).unionByName(looked.select("query_id", F.lit(1).cast("long").alias("scored")))
    return known.groupBy("query_id").agg(F.sum("df").alias("postings")).join(added.groupBy("query_id").agg(F.sum("scored").alias("scored")), "query_id")


def _best(scores: np.ndarray, place: np.ndarray, n: int, over: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's n best by rounded score, ties by the columns' place; entries that are not over `over` are none.

    The n-th best of a row's first columns is a floor that is cheap to find, and few of the others reach it; only those are sorted.
    """
    floor = np.full(len(scores), np.nextafter(over, np.inf))
    if scores.shape[1] > n:
        worst = -np.partition(-scores[:, : max(n, scores.shape[1] // LEAD)], n - 1, axis=1)[:, n - 1]
        floor = np.fmax(floor, worst - SLACK)  # all that can round to as much
    q, at = np.divmod(np.flatnonzero(scores >= floor[:, None]), max(scores.shape[1], 1))
    order = np.lexsort((place[at], -np.round(scores[q, at], 6), q))
    q, at = q[order], at[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < n], at[rank < n]


def _met(docs: pa.Table, queries: pa.Table, n: int, vectors: np.ndarray | None = None, floors: np.ndarray | None = None) -> pa.Table:
    """query_id, doc_id, score of the n best of a block of documents for each query of a block. vectors: the queries' unit vectors, where they are made already; floors: the n-th best scores known of them, which this raises.

    The first documents are scored in double precision and give a floor, unless one is known. The others are in single precision, and only what may reach the floor is scored again.
    """
    ids, keys = queries.column("query_id").combine_chunks(), docs.column("doc_id").combine_chunks()
    parts = [pa.table({"query_id": ids.slice(0, 0), "doc_id": keys.slice(0, 0), "score": pa.array([], pa.float64())})]
    if docs.num_rows and queries.num_rows:
        x, names = _unit(docs.column("vector").to_numpy()), docs.column("doc_id").to_numpy()
        vectors = _unit(queries.column("vector").to_numpy()) if vectors is None else vectors
        floors = np.full(len(vectors), -np.inf) if floors is None else floors
        place = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        rough, slack = x.astype(np.float32), SLACK + (x.shape[1] + ROUNDED) * EPS
        tile = min(DOC_TILE, len(x))
        step = max(1, min(QUERY_TILE, SCORES // tile))
        held = np.empty(step * tile, np.float32)
        steps = [min(len(x), tile * k) for k in (1, 2, 5, 12, 30)]  # documents after which the floors are raised
        for lo in range(0, len(vectors), step):
            own, floor = vectors[lo : lo + step], floors[lo : lo + step]
            start, q, at, likely = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            if not (floor > -np.inf).all():
                scores, start = own @ x[:tile].T, tile
                q, at = _best(scores, place[:tile], n)
                likely = scores[q, at].astype(np.float32)
                _first(q, at, scores[q, at], place, n, floor)
            reach, small = (floor - slack).astype(np.float32), own.astype(np.float32)
            found = [(q, at, likely)]
            for d in range(start, len(x), tile):
                width = min(tile, len(x) - d)
                scores = np.matmul(small, rough[d : d + width].T, out=held[: len(own) * width].reshape(len(own), width))
                hit = np.flatnonzero(scores >= reach[:, None])
                q, at = np.divmod(hit, width)
                found.append((q, at + d, scores.ravel()[hit]))
                if d + width in steps or d + width == len(x) or sum(len(c[0]) for c in found) > SCORES // 4:
                    q, at, likely = (np.concatenate(c) for c in zip(*found, strict=True))
                    kept, least = _likely(q, likely, n, 2 * slack, len(own))
                    found, reach = [(q[kept], at[kept], likely[kept])], np.fmax(reach, least)
                    if len(found[0][0]) > SCORES // 8:  # many equal scores: only their order by place tells who stays
                        q, at, _ = found[0]
                        q, at, exact = _first(q, at, _dots(own, q, x, at), place, n, floor)
                        found = [(q, at, exact.astype(np.float32))]
            q, at, _ = (np.concatenate(c) for c in zip(*found, strict=True))
            q, at, exact = _first(q, at, _dots(own, q, x, at), place, n, floor)
            parts.append(pa.table({"query_id": ids.take(pa.array(q + lo)), "doc_id": keys.take(pa.array(at)), "score": pa.array(exact, pa.float64())}))
    return pa.concat_tables(parts)


def _best_of_parts(docs: DataFrame, asked: pa.Table, n: int, schema: str) -> DataFrame:
    """query_id, doc_id, score of the n best of each part of DOC_PART documents, over what the parts before it in its task left: the queries are sent to the documents, which stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(_bytes(asked))  # QUERY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vectors, floors, held, rows = None, None, None, [], 0
        for batch in batches:
            if queries is None and batch.num_rows:
                queries = pa.ipc.open_stream(shared.value).read_all()
                vectors, floors = _unit(queries.column("vector").to_numpy()) if queries.num_rows else None, np.full(queries.num_rows, -np.inf)
            for lo in range(0, batch.num_rows, DOC_PART):
                held.append(batch.slice(lo, DOC_PART))
                rows += held[-1].num_rows
                if rows >= DOC_PART:
                    yield from _met(pa.Table.from_batches(held), queries, n, vectors, floors).to_batches()
                    held, rows = [], 0
        if held:
            yield from _met(pa.Table.from_batches(held), queries, n, vectors, floors).to_batches()

    return docs.mapInArrow(run, schema)


def vector_search(queries: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """Exact cosine ranking of queries (query_id, vector) against docs (doc_id, vector); negative scores rank too. Null vectors rank nowhere.

    Queries of up to MANY_QUERIES rows and QUERY_BYTES are broadcast: documents are read once, and each part of a task sends on its n best. More queries are dealt into blocks, bounded in rows and
    bytes, that meet all documents in a task each (see _product).
    """
    queries = stored(queries.select("query_id", "vector").filter("vector is not null"), "queries")
    docs = docs.select("doc_id", "vector").filter("vector is not null")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double"
    rows, longest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if rows <= min(MANY_QUERIES, QUERY_ROWS) and rows * longest * 8 <= QUERY_BYTES:
        return top(_best_of_parts(docs, queries.toArrow(), n, schema), n)

    def begin(block: pa.Table) -> tuple[Callable, Callable]:
        vectors = _unit(block.column("vector").to_numpy())
        return _best_of(lambda held, floors: _met(held, block, n, vectors, floors), block.num_rows, n)

    blocks = max(-(-rows // QUERY_BLOCK), -(-rows * longest * 8 // BLOCK_BYTES))
    return top(_product(stored(docs, "docs"), queries, blocks, DOC_PART, begin, schema), n)  # stored, as a task that encodes and packs would hold two Python workers


def _nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector and centre, what grows as their distance falls."""
    return 2 * x @ centres.T - (centres * centres).sum(1)


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def _lloyd(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """k centres of a bounded sample; fewer where it has fewer vectors. Centres without a vector stay where they are."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearness(x[lo : lo + 4096], centres).argmax(1) for lo in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantizer:
    """Cells and codes of unit vectors, fitted on a bounded sample.

    A cell is a centre and a centre of what that leaves, so k cells take twice the root of k centres, and placing a vector takes as many comparisons. A code is, for each of `books` stretches of
    dimensions of what the cell leaves, the nearest of 256 words.
    """

    def __init__(self, sample: np.ndarray, cells: int, books: int):
        side = max(1, round(cells**0.5))
        self.first = _lloyd(sample, side)
        left = sample - self.first[_nearness(sample, self.first).argmax(1)]
        self.second = _lloyd(left, -(-cells // side), seed=2)
        left = left - self.second[_nearness(left, self.second).argmax(1)]
        self.cuts = np.linspace(0, sample.shape[1], min(books, sample.shape[1]) + 1).astype(int)
        self.books = [_lloyd(np.ascontiguousarray(left[:, lo:hi]), 256, seed=3) for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (a byte a book) of each vector."""
        one = _nearness(x, self.first).argmax(1)
        left = x - self.first[one]
        two = _nearness(left, self.second).argmax(1)
        left = left - self.second[two]
        codes = [_nearness(left[:, lo:hi], book).argmax(1) for lo, hi, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return one * len(self.second) + two, np.stack(codes, 1).astype(np.uint8)

    def nearness(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell, what grows as their distance falls."""
        size = (self.first**2).sum(1)[:, None] + (self.second**2).sum(1) + 2 * self.first @ self.second.T
        both = (queries @ self.first.T)[:, :, None] + (queries @ self.second.T)[:, None, :]
        return (2 * both - size).reshape(len(queries), -1)

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of queries with vectors of a cell: a table look-up a book."""
        base = queries @ (self.first[cell // len(self.second)] + self.second[cell % len(self.second)])
        out = np.repeat(base[:, None], len(codes), 1)
        for i, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (queries[:, lo:hi] @ self.books[i].T)[:, codes[:, i]]
        return out


def _probes(queries: DataFrame, placed: DataFrame, quantizer: Quantizer, n: int, recall: float, checked: int) -> int:
    """The least number of nearest cells that hold the share `recall` of the n true neighbours of at most `checked` queries, found by brute force."""
    drawn = queries.filter("vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(checked).select("query_id", "vector").toPandas()
    if not len(drawn):
        return 1
    asked = queries.sparkSession.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(drawn["vector"])], "query_id long, vector array<double>")
    true = vector_search(asked, placed, n).join(placed.select("doc_id", "cell"), "doc_id").select("query_id", "cell").toPandas()
    if not len(true):
        return 1
    order = np.argsort(-quantizer.nearness(_unit(drawn["vector"])), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[true["query_id"].to_numpy(), true["cell"].to_numpy()]
    within = np.cumsum(np.bincount(place, minlength=order.shape[1])) / len(place)
    return int(np.argmax(within >= recall)) + 1


def ann_candidates(queries: DataFrame, docs: DataFrame, n: int = 10, budget: int = 200, cells: int | None = None, probes: int | None = None, sample: int = 20_000, recall: float = 0.97, checked: int = 300, books: int = 16) -> tuple[DataFrame, DataFrame]:
    """query_id, doc_id of the `budget` best candidates of each query by estimated scores, and the documents' stored vectors (doc_id, vector)."""
    data = stored(docs.filter("vector is not null").select("doc_id", "vector"), "vectors")
    spark, rows = docs.sparkSession, data.count()
    kind_q, kind_d, kind_v = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"], dict(docs.dtypes)["vector"]
    asked = stored(queries.select("query_id", "vector").filter("vector is not null"), "queries")
    if not rows:
        return asked.select("query_id").crossJoin(data.select("doc_id")).limit(0), data
    fitted = data.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vector").toPandas()["vector"]
    quantizer = Quantizer(_unit(fitted), cells or max(1, round(2 * rows**0.5)), books)
    shared = spark.sparkContext.broadcast(quantizer)  # twice the root of the cells, and 256 words a book

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                cell, codes = shared.value.place(_unit(frame["vector"]))
                yield frame.assign(cell=cell, code=[c.tobytes() for c in codes])

    placed = stored(data.mapInPandas(place, f"doc_id {kind_d}, vector {kind_v}, cell long, code binary"), "placed")
    probes = probes or _probes(asked, placed, quantizer, n, recall, checked)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                near = np.argsort(-shared.value.nearness(_unit(frame["vector"])), axis=1, kind="stable")[:, :probes]
                yield frame.assign(cell=near.tolist())

    visiting = asked.mapInPandas(visit, f"query_id {kind_q}, vector {kind_v}, cell array<long>").withColumn("cell", F.explode("cell"))
    sizes = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL_BLOCK)).cast("int").alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    there = placed.select("cell", "doc_id", "code").join(small(sizes, BROADCAST_TERMS), "cell").select("cell", "doc_id", "code", part.alias("part"))
    visiting = visiting.join(small(sizes, BROADCAST_TERMS), "cell").select("cell", "query_id", "vector", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def estimate(docs: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if docs.num_rows and queries.num_rows:
            codes = np.frombuffer(b"".join(docs.column("code").to_pylist()), np.uint8).reshape(docs.num_rows, -1)
            cell, names = docs.column("cell")[0].as_py(), docs.column("doc_id").to_numpy()
            place = np.argsort(np.argsort(names, kind="stable"), kind="stable")
            for lo in range(0, queries.num_rows, 64):
                own = queries.slice(lo, 64)
                scores = shared.value.scores(_unit(own.column("vector").to_numpy()), cell, codes)
                q, at = _best(scores, place, budget)
                parts.append(pa.table({"query_id": own.column("query_id").take(pa.array(q)), "doc_id": docs.column("doc_id").take(pa.array(at)), "score": pa.array(scores[q, at], pa.float64())}))
        none = pa.table({"query_id": queries.column("query_id").slice(0, 0), "doc_id": docs.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables(parts) if parts else none

    pairs = there.groupBy("cell", "part").cogroup(visiting.groupBy("cell", "part"))
    found = top(pairs.applyInArrow(estimate, f"query_id {kind_q}, doc_id {kind_d}, score double"), budget)
    return found.select("query_id", "doc_id"), data


def _exact(query: Column, doc: Column) -> Column:
    """Cosine in double precision, as in _unit()."""
    of = lambda v: v.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x))) + 1e-9
    return total(F.zip_with(of(query), of(doc), lambda x, y: x * y)) / (size(of(query)) * size(of(doc)))


def ann_search(queries: DataFrame, docs: DataFrame, n: int = 10, budget: int = 200, **options) -> DataFrame:
    """Approximate cosine ranking in three steps: nearest cells, estimated scores of what lies in them, exact scores of the `budget` best of those.

    Cells follow the root of the row count without a limit. As many are visited as hold 0.97 of the true neighbours of at most 300 queries, measured by brute force (options of ann_candidates() set
    this). Vectors in visited cells are met as codes of a byte a book; exact vectors are read for `budget` documents a query, whatever the number of rows. Null vectors rank nowhere. Queries are sent to the cells they
    visit; a cell of more than CELL_BLOCK documents is met in parts.
    """
    found, data = ann_candidates(queries, docs, n, budget, **options)
    found = stored(found, "candidates")
    held = data.join(small(found.select("doc_id").distinct(), BROADCAST_TERMS), "doc_id", "left_semi").withColumnRenamed("vector", "held")
    rows = found.join(held, "doc_id").join(queries.select("query_id", "vector"), "query_id")
    return top(rows.select("query_id", "doc_id", _exact(F.col("vector"), F.col("held")).alias("score")), n)


def rrf_fuse(lists: list[DataFrame], k: int = 60, n: int = 10) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the lists; ties go to the earlier list, then its rank, then doc_id."""
    parts = [r.select("query_id", "doc_id", "rank", F.lit(i).alias("list_no")) for i, r in enumerate(lists)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.repartition("query_id")  # which serves the grouping and the ranking, so rows move once
    fused = whole.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "seen", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("query_id", "doc_id", "score", "rank")


def hybrid_search(text_queries: DataFrame, index: dict[str, DataFrame], vector_queries: DataFrame, docs: DataFrame, n: int = 10, per: int = 10, k: int = 60) -> DataFrame:
    """Keyword and vector lists of `per` documents each, fused."""
    return rrf_fuse([bm25_search(text_queries, index, per), vector_search(vector_queries, docs, per)], k, n)


def term_overlap(query: Column, text: Column) -> Column:
    """Default pair score: the share of the query's distinct terms that the text has."""
    return _overlap(F.array_distinct(tokenize(query)), tokenize(text))


def _overlap(asked: Column, terms: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms)).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def _shared_terms(held: pa.Table, block: pa.Table, names: pa.Array, codes: np.ndarray, sizes: np.ndarray, pairs: pa.Table) -> pa.Table:
    """query_id, doc_id, was, score: the term overlap of the pairs (at, doc_id, was) of queries of a block (query_id) and a part of the documents (doc_id, terms). names, codes, sizes: the queries' terms, as places in a list of them, and how many each has."""
    here = pa.table({"doc_id": held.column("doc_id"), "row": pa.array(np.arange(held.num_rows))})
    here = pairs.join(here, "doc_id", join_type="inner", use_threads=False).combine_chunks()
    rows, row = np.unique(here.column("row").to_numpy(), return_inverse=True)
    terms = pc.split_pattern(held.column("terms").combine_chunks().take(pa.array(rows)), " ")
    found = pc.index_in(terms.flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    known = np.sort((doc * len(names) + found)[found >= 0])
    at = here.column("at").to_numpy()
    first, count = (np.cumsum(sizes) - sizes)[at], sizes[at]
    pair = np.repeat(np.arange(len(at)), count)
    asked = row[pair] * len(names) + codes[np.arange(len(pair)) + np.repeat(first - (np.cumsum(count) - count), count)]
    place = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    hits = np.bincount(pair[known[place] == asked] if len(known) else pair[:0], minlength=len(at))
    score = pa.array(hits / np.maximum(count, 1), pa.float64())
    return pa.table({"query_id": block.column("query_id").take(pa.array(at)), "doc_id": here.column("doc_id"), "was": here.column("was"), "score": score})


def _overlaps(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, was, score: the term overlap of every candidate with a query and a document (both with terms, with spaces between them). Blocks of queries, with their candidates, meet all documents in a task each (see _product): no terms are copied for a candidate."""
    listed = ranked.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "rank")).alias("c"))
    asked = stored(listed.join(queries, "query_id").select("query_id", "terms", F.col("c.doc_id").alias("docs"), F.col("c.rank").alias("ranks")), "candidates")
    rows, size, pairs = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)), F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()
    schema = f"query_id {dict(asked.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, was {dict(ranked.dtypes)['rank']}, score double"

    def begin(block: pa.Table) -> tuple[Callable, Callable]:
        terms = pc.split_pattern(block.column("terms").combine_chunks(), " ")
        sizes, words = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64), terms.flatten().dictionary_encode()
        names, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        names = pc.if_else(pc.equal(names, ""), pa.scalar(None, names.type), names)  # a text without terms shares none with another
        listed = block.column("docs").combine_chunks()
        at = np.repeat(np.arange(block.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        pairs = pa.table({"at": pa.array(at), "doc_id": listed.flatten(), "was": block.column("ranks").combine_chunks().flatten()})
        found = []
        return lambda held: found.append(_shared_terms(held, block, names, codes, sizes, pairs)), lambda: pa.concat_tables(found)

    return _product(docs, asked, max(-(-rows // QUERY_BLOCK), -(-size // BLOCK_BYTES), -(-pairs // (16 * QUERY_BLOCK))), DOC_PART, begin, schema)


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, n: int = 5, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Candidates rescored on (query text, document text), the n best; ties keep the former rank. Candidates without a document go.

    `scorer` takes batches of both texts, which are joined to the candidates; without one, term overlap is scored from terms that are taken once a query and once a document, and copied for no candidate.
    """
    if scorer:
        texts = queries.select("query_id", F.col("text").alias("q_text"))
        pairs = ranked.select("query_id", "doc_id", F.col("rank").alias("was")).join(docs.select("doc_id", "text"), "doc_id").join(texts, "query_id")
        pairs = pairs.select("query_id", "doc_id", "was", F.pandas_udf(scorer, "double")("q_text", "text").alias("score"))
    else:
        terms = F.array_join(F.array_distinct(tokenize(F.coalesce("text", F.lit("")))), " ").alias("terms")
        wanted, docs = ranked.select("doc_id").distinct(), docs.select("doc_id", "text")
        if is_small(wanted, BROADCAST_TERMS):  # else most documents are candidates, and finding which would move all texts
            docs = docs.join(F.broadcast(wanted), "doc_id", "left_semi")
        pairs = _overlaps(ranked, queries.select("query_id", terms), docs.select("doc_id", terms))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "was", "doc_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("was")


def lookup_chunks(ranked: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """query_id, rank, score and the chunks' columns without their vector; unknown ids go."""
    found = chunks.drop("vector").withColumnRenamed(key, "doc_id")
    return ranked.select("query_id", "rank", "doc_id", "score").join(found, "doc_id")


def retrieve(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 5, rescore: bool = False, scorer=None) -> DataFrame:
    """The top_k chunks of every query with their score: of the ranking as it is, or of its candidates rescored."""
    docs = chunks.select(F.col("id").alias("doc_id"), "text")
    best = rerank(ranked, queries, docs, top_k, scorer) if rescore else ranked.filter(F.col("rank") <= top_k)
    return lookup_chunks(best, chunks)
