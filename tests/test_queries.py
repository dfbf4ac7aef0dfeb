"""Every query of the library against its SQL on the smallest tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.operators import feedback, index, search
from loomline.plans import registry

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_ann_recall_is_over_nine_tenths(spark):
    for folder in (SMALL, "/root/testdata/sf0.1"):
        exact = {(r["query_id"], r["doc_id"]) for r in registry.QUERIES["vector_search"](spark, folder).collect()}
        near = {(r["query_id"], r["doc_id"]) for r in registry.QUERIES["ann_search"](spark, folder).collect()}
        assert len(exact & near) >= 0.9 * len(exact)


def test_hybrid_and_rerank_find_documents_without_a_vector(spark, tmp_path):
    texts = [(0, "red fox"), (1, "blue whale"), (2, "green owl sings"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "green owl"), (9, "blue")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r["query_id"], r["doc_id"]) for r in registry.QUERIES["hybrid_search"](spark, str(tmp_path)).collect()}
    assert found == {(0, 2), (0, 0), (0, 1), (9, 1)}
    best = {r["query_id"]: r["doc_id"] for r in registry.QUERIES["rerank"](spark, str(tmp_path)).filter("rank = 1").collect()}
    assert best == {0: 2, 9: 1}


def test_keyword_search_is_the_same_with_and_without_a_broadcast(spark, monkeypatch):
    rows = [(0, "red fox red"), (1, "red"), (2, "the fox sees the owl"), (2, "owl"), (3, None), (4, ""), (None, "fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "red fox red"), (1, "owl"), (2, "absent"), (3, None), (4, "the fox the owl")], "query_id long, text string")
    made = index.keyword_index(docs)
    near = rows_of(*_rows(search.bm25_search(asked, made, 3)))
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    far = rows_of(*_rows(search.bm25_search(asked, made, 3)))
    assert near == far and {r[1] for r in near[1]} == {"0", "1", "4"}


def _rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def _collection(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(words[i] for i in np.minimum(rng.zipf(1.3, k), 300) - 1)
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n)] + [(0, "w0 w1 w1"), (None, "w2 w2 w3"), (n, None)]
    asked = [(i, text(int(rng.integers(0, 12)))) for i in range(25)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 500_000), (2, 0)])
def test_pruned_keyword_search_equals_full_scoring(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(search, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(search, "HEAD", 5)
    monkeypatch.setattr(index, "BLOCK_DOCS", 16)
    monkeypatch.setattr(index, "SLICE_BLOCKS", 8)
    docs, asked = _collection(spark, seed)
    made = index.keyword_index(docs)
    assert made["blocks"].select("slice").distinct().count() > 1
    full = rows_of(*_rows(search.bm25_search(asked, made, 5, prune=False).drop("method")))
    assert rows_of(*_rows(search.bm25_search(asked, made, 5, prune=True))) == full
    work = search.bm25_work(asked, made, 5).collect()
    assert all(r["scored"] <= r["postings"] for r in work) and sum(r["scored"] for r in work) < 0.8 * sum(r["postings"] for r in work)


def test_postings_are_plain_counts_and_join_without_an_exchange(spark):
    docs, _ = _collection(spark, 3)
    made = index.keyword_index(docs)
    got = {(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in made["postings"].collect()}
    texts = {}
    for r in docs.filter("text is not null").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"].split())
    want = {(d, t): (sum(w.count(t) for w in own), sum(len(w) for w in own if t in w)) for d, own in texts.items() for t in {t for w in own for t in w}}
    assert got == want
    again = made["blocks"].groupBy("term").agg(F.sum("n"))
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_candidates_of_a_query_do_not_follow_the_rows(spark):
    rng = np.random.default_rng(4)
    for rows in (300, 3000):
        x = rng.standard_normal((rows, 12)).astype(np.float32)
        docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id long, vector array<float>")
        asked = spark.createDataFrame([(i, v) for i, v in enumerate((x[:15] + 0.1).tolist())], "query_id long, vector array<float>")
        found, _ = search.ann_candidates(asked, docs, 5, budget=60)
        assert {r["n"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} <= set(range(1, 61))
        exact = {(r["query_id"], r["doc_id"]): r["score"] for r in search.vector_search(asked, docs, 5).collect()}
        near = {(r["query_id"], r["doc_id"]): r["score"] for r in search.ann_search(asked, docs, 5, budget=60).collect()}
        assert len(exact.keys() & near.keys()) >= 0.9 * len(exact) and all(abs(near[k] - exact[k]) < 1e-9 for k in exact.keys() & near.keys())
    assert search.ann_search(asked, docs.limit(0), 5).count() == 0


@pytest.mark.parametrize("scores", [2_000_000, 50])
def test_keyword_search_by_parts_equals_scoring_a_row_a_posting(spark, monkeypatch, scores):
    monkeypatch.setattr(index, "BLOCK_DOCS", 16)
    docs, asked = _collection(spark, 4)
    asked = asked.union(spark.createDataFrame([(None, "w1 w250")], "query_id long, text string"))
    made = index.keyword_index(docs)
    for name, value in {"PART_BLOCKS": 3, "PART_TERMS": 40, "SCORES": scores, "MATRIX": 1000}.items():
        monkeypatch.setattr(search, name, value)
    found = search.bm25_search(asked, made, 5)
    known = search._asked_terms(asked, made, 1.5, 0.75)
    by_row = search.top(search._added_up(known, made["blocks"], 1.5, 0.75).filter("score > 0"), 5)
    assert rows_of(*_rows(found)) == rows_of(*_rows(by_row.select(found.columns)))
    assert "Generate inline" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a posting


def test_exact_vector_search_holds_a_bounded_number_of_scores(spark, monkeypatch):
    shapes, best = [], search._best

    def seen(scores, place, n):
        shapes.append(scores.size)
        return best(scores, place, n)

    monkeypatch.setattr(search, "_best", seen)
    monkeypatch.setattr(search, "SCORES", 100)
    x = np.random.default_rng(0).normal(size=(40, 4))
    table = pa.table({"doc_id": pa.array(range(40)), "vector": pa.array(x.tolist())})
    made = search._met(table, pa.table({"query_id": pa.array(range(9)), "vector": pa.array(x[:9].tolist())}), 3)
    assert made.num_rows == 27 and max(shapes) <= 100
    assert [r["doc_id"] for r in made.to_pylist()[::3]] == list(range(9))


def test_the_best_are_found_from_a_floor_of_the_first_columns():
    rng = np.random.default_rng(6)
    for over in (-np.inf, 0.0):
        scores = np.round(rng.normal(size=(20, 500)), 1)  # with ties
        scores[0], scores[1, 7:], scores[2, :400] = np.arange(500), -1.0, -np.inf
        scores[3, :100] = np.nan
        place = rng.permutation(500)
        q, at = search._best(scores, place, 5, over)
        for i, row in enumerate(scores):
            want = sorted((j for j in range(500) if row[j] > over), key=lambda j: (-row[j], place[j]))[:5]  # noqa: B023
            assert at[q == i].tolist() == want
    assert [x.size for x in search._best(np.zeros((3, 0)), place[:0], 5)] == [0, 0]


@pytest.mark.parametrize("sizes", [{}, {"PART_TERMS": 40, "PART_DOCS": 32, "SCORES": 50, "MATRIX": 1000}, {"PART_DOCS": 32, "FREQUENT": 0.5}])
def test_keyword_search_by_rows_equals_that_by_blocks(spark, monkeypatch, sizes):
    docs, asked = _collection(spark, 5)
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(10**9, None), (None, "w1 w2 w2")], docs.schema))
    asked = asked.union(spark.createDataFrame([(None, "w1 w250")], "query_id long, text string"))
    want = [search.bm25_search(asked, index.keyword_index(docs), 5, *k).collect() for k in ((1.5, 0.75), (1.2, 0.0))]
    for name, value in sizes.items():
        monkeypatch.setattr(search, name, value)
    made = index.asked_index(docs, asked)
    assert "blocks" not in made
    for k, rows in zip(((1.5, 0.75), (1.2, 0.0)), want, strict=True):
        found = search.bm25_search(asked, made, 5, *k)
        assert rows_of(*_rows(found)) == rows_of(rows[0].__fields__, [tuple(r) for r in rows])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("FlatMapCoGroupsInArrow" in plan) == ("PART_TERMS" in sizes)  # else documents do not move
    monkeypatch.setattr(index, "ASKED_TERMS", 3)
    assert "blocks" in index.asked_index(docs, asked)
    monkeypatch.undo()
    assert "blocks" in index.asked_index(docs.union(docs.limit(1)), asked)


def test_reranking_takes_the_terms_of_a_text_once(spark):
    docs = spark.createDataFrame([(1, "red fox Red"), (2, "owl"), (3, None), (4, "fox owl")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a red, red owl"), (8, "?"), (9, None)], "query_id long, text string")
    ranked = spark.createDataFrame([(q, d, r) for q in (7, 8, 9) for r, d in enumerate((3, 2, 1, 5), 1)], "query_id long, doc_id long, rank int")
    made = search.rerank(ranked, asked, docs, 2)
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in made.collect()) == [(7, 1, 2, 0.333333), (7, 2, 1, 0.333333), (8, 1, 3, 0.0), (8, 2, 2, 0.0), (9, 1, 3, 0.0), (9, 2, 2, 0.0)]


def test_a_work_list_is_neither_sorted_nor_gathered(spark):
    from loomline.operators import judge_eval as J

    results = spark.createDataFrame([(1, "a", "good"), (1, "a", "failed"), (2, "a", "failed"), (2, None, "good"), (None, "a", "bad"), (3, "b", "bad"), (9, "a", "failed")], "faq_id long, answer_model string, score string")
    records = spark.createDataFrame([(1,), (2,), (3,), (None,)], "faq_id long")
    models = spark.createDataFrame([("a",), ("b",), (None,)], "answer_model string")
    work = J.eval_worklist(records, models, results)
    done = {(1, "a"), (3, "b")}
    assert sorted(str(tuple(r)) for r in work.select("faq_id", "answer_model").collect()) == sorted(str((f, m)) for f in (1, 2, 3, None) for m in ("a", "b", None) if (f, m) not in done)
    kept = J.drop_stale_results(results, work)
    assert sorted(str(tuple(r)) for r in kept.select("faq_id", "answer_model", "score").collect()) == sorted(map(str, [(1, "a", "good"), (1, "a", "failed"), (2, None, "good"), (None, "a", "bad"), (3, "b", "bad"), (9, "a", "failed")]))
    assert kept._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") >= 2


def test_latency_quantiles_are_exact_beyond_a_sketch(spark):
    rows = spark.range(30_000).selectExpr("timestamp_seconds(id * 10) AS ts", "cast(pmod(xxhash64(id), 100003) AS double) AS retrieval_ms")
    rows = rows.union(spark.sql("SELECT timestamp_seconds(5 * id), 7D FROM range(2000)")).union(spark.sql("SELECT timestamp_seconds(0), CAST(null AS double)"))
    for k in (8, 4096):  # at 8, bands are no narrower than all
        for unit in ("day", "week"):
            made = feedback.exact_quantiles(rows, feedback.latency_sketches(rows, k), unit, {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, k)
            by = {}
            for r in rows.filter("retrieval_ms is not null").selectExpr(f"cast(date_trunc('{unit}', ts) as date) AS at", "retrieval_ms AS v").collect():
                by.setdefault(r["at"], []).append(r["v"])
            want = {at: (len(v), *[sorted(v)[max(1, -(-len(v) * q // 100)) - 1] for q in (0, 50, 95, 100)], max(v)) for at, v in by.items()}
            assert {r[0]: tuple(r)[1:] for r in made.collect()} == want
    assert max(len(v) for v in by.values()) > 4096


def test_rewritten_questions_match_the_sql_where_episodes_share_them(spark, duck, tmp_path):
    turns = "SELECT 10 * e + c AS conv_id, 0L AS turn, 'user' AS role, concat('the question ', c) AS text FROM (SELECT explode(sequence(0L, 3L)) AS e), (SELECT explode(sequence(0L, 1L)) AS c)"
    spark.sql(turns).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["rewrite_lookup"](spark, str(tmp_path))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["rewrite_lookup"]).fetchall()
    assert sorted(map(tuple, got.select("query_id", "retrieve_query").collect())) == sorted(want) and len(want) == 8


def test_index_of_one_row_a_key_groups_its_postings_once(spark, monkeypatch):
    seen, kept = [], index.bucketed
    monkeypatch.setattr(index, "bucketed", lambda df, *a: seen.append(df) or kept(df, *a))
    rows = [(1, "red fox red"), (2, "owl"), (None, "fox"), (3, None)]
    made = [index.keyword_index(spark.createDataFrame(more, "doc_id long, text string")) for more in (rows, [*rows, (2, "owl sees"), (None, "fox")])]
    groups = [df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") for df in seen]
    assert groups == [1, 2] and seen[0].dtypes == seen[1].dtypes
    got = [sorted((r["term"], r["doc_id"] or 0, r["tf"], r["dl"]) for r in m["postings"].collect()) for m in made]
    assert got[0] == [("fox", 0, 1, 1), ("fox", 1, 1, 3), ("owl", 2, 1, 1), ("red", 1, 2, 3)]
    assert got[1] == [("fox", 0, 2, 2), ("fox", 1, 1, 3), ("owl", 2, 2, 3), ("red", 1, 2, 3), ("sees", 2, 1, 2)]


def test_many_queries_and_documents_meet_without_groups(spark, monkeypatch):
    docs, asked = _collection(spark, 8)
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    asked = asked.union(spark.createDataFrame([(None, "w1 w250")], "query_id long, text string"))
    few = rows_of(*_rows(search.bm25_search(asked, index.asked_index(docs, asked), 5)))
    x = np.random.default_rng(8).integers(-3, 4, (5000, 6)).astype(float)  # with equal scores, and vectors of nothing but zeros
    x[7] = np.nan
    held = spark.createDataFrame([(i, v) for i, v in enumerate(x[:700].tolist())], "doc_id long, vector array<double>")
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "query_id long, vector array<double>")
    monkeypatch.setattr(search, "QUERY_ROWS", 0)
    grouped = rows_of(*_rows(search.vector_search(wanted, held, 5)))
    monkeypatch.undo()
    found = search.vector_search(wanted, held, 5)
    assert "CoGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(*_rows(found)) == grouped and len(grouped[1]) == 4999 * 5
    for name, value in {"MANY_TERMS": 0, "MANY_QUERIES": 0, "PART_DOCS": 64, "DOC_PART": 64, "DOC_TILE": 16, "MATRIX": 4000}.items():
        monkeypatch.setattr(search, name, value)
    assert rows_of(*_rows(search.bm25_search(asked, index.asked_index(docs, asked), 5))) == few
    assert rows_of(*_rows(search.vector_search(wanted, held, 5))) == grouped


def test_what_cannot_reach_a_known_floor_is_not_sent_on():
    x = np.random.default_rng(9).normal(size=(300, 8))
    table = lambda lo, hi: pa.table({"doc_id": pa.array(range(lo, hi)), "vector": pa.array(x[lo:hi].tolist())})
    asked = pa.table({"query_id": pa.array(range(20)), "vector": pa.array(x[:20].tolist())})
    floors = np.full(20, -np.inf)
    first = search._met(table(0, 200), asked, 5, floors=floors)
    then = search._met(table(200, 300), asked, 5, floors=floors)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit[:20] @ unit.T
    assert first.num_rows == 100 and then.num_rows < 60
    got = sorted((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in pa.concat_tables([first, then]).to_pylist())
    for q in range(20):
        best = sorted((-round(s, 6), d) for _, d, s in (r for r in got if r[0] == q))[:5]
        assert [d for _, d in best] == np.argsort(-scores[q])[:5].tolist()


def test_crowds_of_equal_vectors_are_cut_down_on_the_way(monkeypatch):
    seen, first = [], search._first
    monkeypatch.setattr(search, "_first", lambda q, *a: seen.append(len(q)) or first(q, *a))
    monkeypatch.setattr(search, "SCORES", 400)
    monkeypatch.setattr(search, "DOC_TILE", 20)
    docs = pa.table({"doc_id": pa.array(range(1000, 0, -1)), "vector": pa.array([[1.0, 2.0]] * 1000)})
    found = search._met(docs, pa.table({"query_id": pa.array(range(4)), "vector": pa.array([[2.0, 1.0]] * 4)}), 3)
    assert sorted((r["query_id"], r["doc_id"]) for r in found.to_pylist()) == [(q, d) for q in range(4) for d in (1, 2, 3)]
    assert max(seen) <= 400


def test_blocks_of_queries_send_on_n_rows_a_query_and_copy_no_documents(spark, monkeypatch):
    docs, asked = _collection(spark, 12)
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(None, "w1 w2 w2")], docs.schema)).repartition(9)
    asked = asked.union(spark.createDataFrame([(None, "w1 w250"), (3, "w0 w7"), (77, None), (78, "absent")], asked.schema))  # two rows of one query
    want = rows_of(*_rows(search.bm25_search(asked, index.keyword_index(docs), 5)))
    x = np.random.default_rng(12).integers(-2, 3, (300, 4)).astype(float)  # with equal scores
    held = spark.createDataFrame([(f"d{i:03}", v) for i, v in enumerate(x.tolist())] + [("none", None)], "doc_id string, vector array<double>").repartition(7)
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(x[:50].tolist())], "query_id long, vector array<double>")
    near = rows_of(*_rows(search.vector_search(wanted, held, 3)))
    for name, value in {"MANY_TERMS": 0, "MANY_QUERIES": 0, "PART_DOCS": 40, "DOC_PART": 40, "DOC_BLOCK": 16, "QUERY_BLOCK": 6, "KEPT": 1}.items():
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(index, "COUNT_TERMS", 50)
    made = index.asked_index(docs, asked)
    best = search._best_of_rows(asked, made, 5, 1.5, 0.75)
    assert max(r["count"] for r in best.groupBy("query_id").count().collect()) <= 5
    assert "Cogroup" not in best._jdf.queryExecution().optimizedPlan().toString() and best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the queries
    assert rows_of(*_rows(search.bm25_search(asked, made, 5))) == want
    assert rows_of(*_rows(search.vector_search(wanted, held, 3))) == near


def test_rescoring_copies_no_terms_for_a_candidate(spark, monkeypatch):
    docs, asked = _collection(spark, 13, 150)
    asked = asked.union(spark.createDataFrame([(3, "w0 w7"), (None, "w1"), (77, None), (78, "?")], asked.schema))  # rows of one id are joined each
    ranked = spark.createDataFrame([(q, (q * 7 + r * 11) % 160 if r else 0, r + 1) for q in (*range(25), 77, 78, 99) for r in range(6)], "query_id long, doc_id long, rank int")
    share = lambda q, t: len(q & t) / len(q) if q else 0.0
    plain = lambda q, t: [share(set((a or "").split()) - {"?"}, set((b or "").split())) for a, b in zip(q, t, strict=True)]
    import pandas as pd

    def scorer(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(plain(q, t))

    columns = ["query_id", "doc_id", "rank", "score"]
    want = rows_of(*_rows(search.rerank(ranked, asked, docs, 20, scorer).select(columns)))
    monkeypatch.setattr(search, "DOC_BLOCK", 16)
    monkeypatch.setattr(search, "DOC_PART", 40)
    for few in (500_000, 0):
        monkeypatch.setattr(search, "BROADCAST_TERMS", few)
        made = search.rerank(ranked, asked, docs, 20)
        assert "Join Inner" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert rows_of(*_rows(made.select(columns))) == want and len(want[1]) > 150


def test_what_a_step_needs_goes_when_it_ends(spark, tmp_path):
    import time
    from pathlib import Path

    from loomline.functions import scratch

    shuffles = lambda: sum("shuffle_" in f for f in str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")).split())
    was = shuffles()
    with scratch.passing(spark) as keep:
        first = scratch.stored(spark.range(1000).repartition(3, "id"), "first")
        with scratch.passing(spark) as keep_inner:
            second = keep_inner(scratch.stored(first.filter("id < 10"), "second"))
            scratch.stored(second, "third")
        last = keep(scratch.stored(second.groupBy("id").count(), "last"))
    for _ in range(50):
        if shuffles() <= was:
            break
        time.sleep(0.1)
    assert shuffles() <= was
    there = {p.name.split("-")[0] for p in Path(scratch.session_dir(spark).removeprefix("file://")).iterdir() if p.name.startswith(("first-", "second-", "third-", "last-"))}
    assert there == {"last"} and last.count() == 10 and spark.conf.get(scratch.FREE_SHUFFLES) == "false"
    names = lambda: {p.name for p in Path(scratch.session_dir(spark).removeprefix("file://")).iterdir()}
    before = names()
    made = registry.QUERIES["recall_at_depth"](spark, SMALL)
    assert not any(n.startswith(("segments-", "rows-", "words-", "queries-")) for n in names() - before) and made.count() == 5
