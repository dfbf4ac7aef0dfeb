"""Small literal cases, one for each rule that is easy to get wrong."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import chunking, context, feedback, index, intake, judge_eval, qa, rank_eval, search
from loomline.sources import files
from loomline.streaming import feedback as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clocks(spark):
    assert one(spark, X.clock_to_seconds(F.lit("01:02:03"))) == 3723
    assert one(spark, X.clock_to_seconds(F.lit("101:00:00"))) == 363600
    for bad in ("1:2", "a:b:c", "", "1:2:3:4"):
        assert one(spark, X.clock_to_seconds(F.lit(bad))) is None
    assert one(spark, X.seconds_to_clock(F.lit(363600))) == "101:00:00"
    assert one(spark, X.parse_timestamp(F.lit("x (00:01:02) y"), F.lit(""))) == "00:01:02"
    assert one(spark, X.parse_timestamp(F.lit(""), F.lit("https://e.x/?a=1&t=61"))) == "00:01:01"
    assert one(spark, X.parse_timestamp(F.lit(None).cast("string"), F.lit(None).cast("string"))) is None


def test_names_and_urls(spark):
    assert one(spark, X.safe_filename(F.lit(' a/b:c?.. '))) == "a-b-c-"
    assert one(spark, X.safe_filename(F.lit(" ... "))) == "unknown"
    assert one(spark, X.candidate_urls(F.lit("https://a.b/x-transcript/"))) == ["https://example.com/x-transcript/"]
    assert one(spark, X.candidate_urls(F.lit("https://a.b/x/y"))) == ["https://example.com/x-transcript/", "https://example.com/x/"]
    assert one(spark, X.candidate_urls(F.lit("https://a.b"))) == ["https://a.b"]
    assert one(spark, X.title_episode(F.lit("Podcast #12 x"))) == 12
    assert one(spark, X.title_guest(F.lit("Transcript for A B: c: d"))) == "A B"
    assert one(spark, X.route_provider(F.lit(None).cast("string"), F.lit("DeepSeek-x"))) == "deepseek"


PAGE = """<html><h1 class="entry-title">First #1</h1><h1 class="entry-title">Podcast #2 &amp; more</h1>
<div class="ts-segment"><span class="ts-text">before any chapter</span></div>
<h2>No id</h2><h2 id="chapter1_a">One</h2><h2 id="chapter2_b">Two <b>x</b></h2>
<div class="ts-segment big"><span class="ts-name">Ann</span><span class="ts-timestamp"><a href="?t=5">(00:00:09)</a></span><span class="ts-text">Hello <i>there</i>
 friend</span></div>
<div class="ts-segment"><span class="ts-name">Bob</span></div>
<div class="ts-segment"><span class="ts-name"> </span><span class="ts-timestamp"><a href="v?a=1&t=65">x</a></span><span class="ts-text">1 &lt; 2</span><p>open"""


def test_walk_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<h2 id='chapter1_z'>only")], "page_id int, html string")
    nodes = intake.parse_segments(pages)
    got = [(r["kind"], r["speaker"], r["timestamp"], r["text"]) for r in nodes.filter("page_id = 1").orderBy("node_pos").collect()]
    assert got == [
        ("title", None, None, "Podcast #2 & more"),
        ("segment", "Unknown", None, "before any chapter"),
        ("chapter", None, None, "One"),
        ("chapter", None, None, "Two x"),
        ("segment", "Ann", "00:00:09", "Hello there friend"),
        ("segment", "Unknown", "00:01:05", "1 < 2"),
    ]
    placed = [(r["chapter_index"], r["chapter"]) for r in intake.assign_chapters(nodes).filter("page_id = 1").orderBy("node_pos").collect()]
    assert placed == [(0, None), (2, "Two x"), (2, "Two x")]


def seg(spark, rows):
    return spark.createDataFrame(rows, "episode int, chapter_index int, chapter string, pos int, speaker string, timestamp string, text string")


def test_guest_ties_and_host_only(spark):
    rows = [(1, 1, "c", 0, "host", None, "x"), (1, 1, "c", 1, "Zed", None, "x"), (1, 1, "c", 2, "Ann", None, "x"), (2, 1, "c", 0, "host", None, "x")]
    titled = spark.createDataFrame([(2, "Titled")], "episode int, guest string")
    got = {r["episode"]: r["guest"] for r in intake.detect_guest(seg(spark, rows), "host", titled).collect()}
    assert got == {1: "Zed", 2: "Titled"}


def test_nested_episode_keeps_empty_and_headless(spark):
    rows = [(1, 0, None, 0, "a", None, "early"), (1, 2, "Two", 1, "a", "00:00:01", "x")]
    heads = spark.createDataFrame([(1, 1, "One"), (1, 2, "Two")], "episode int, chapter_index int, chapter string")
    guests = spark.createDataFrame([(1, "G")], "episode int, guest string")
    nested = intake.nest_episodes(heads, seg(spark, rows).withColumn("pos", F.col("pos").cast("long")), guests)
    row = nested.first()
    assert [(c["title"], len(c["segments"])) for c in row["chapters"]] == [("One", 0), ("Two", 1), ("Unknown", 1)]
    assert intake.episode_summary(nested).first()["n_chapters"] == 3


def test_greedy_chunks(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, 1, "A", 0, "s", "00:00:00", words(12)), (1, 1, "A", 1, "s", "00:00:10", words(5)), (1, 1, "A", 2, "s", "00:00:20", words(5)), (1, 1, "A", 3, "s", None, ""), (1, 3, "C", 0, "s", "00:01:00", words(1))]
    guests = spark.createDataFrame([(1, "G")], "episode int, guest string")
    got = chunking.chunk_segments(seg(spark, rows), guests, 10).orderBy("id").collect()
    assert [(r["id"], r["start_ts"], r["end_ts"]) for r in got] == [("1-01-001", "00:00:00", "00:00:00"), ("1-01-002", "00:00:10", None), ("1-03-003", "00:01:00", "00:01:00")]
    assert "\n".join(r["text"] for r in got if r["chapter"] == "A").split("\n") == [f"s: {r[6]}" for r in rows[:4]]


def test_responses(spark):
    item = '{"question": "What is it?", "answer": "Something that is long enough.", "source_timestamps": %s, "boundary": "%s"}'
    contents = [
        '{"qa_pairs": [%s, 3, {"question": "short", "answer": "x"}, {"skipped": true}]}' % (item % ('"00:00:01"', "merge")),
        "[%s]" % (item % ('["1","2","3","4","5","6","7"]', "odd")),
        'Sure:\n```json\n{"faqs": [%s]}\n```' % (item % ("[]", "ok")),
        'It is {"results": [%s]} so.' % (item % ("[]", "long_split")),
        '{"qa_pairs": [', "", '{"other": 1}',
    ]
    frame = spark.createDataFrame([(1, 1, i, c) for i, c in enumerate(contents)], "episode int, chapter_index int, batch int, content string")
    parsed = qa.parse_responses(frame)
    assert {r["batch"] for r in parsed.filter("failed").collect()} == {4, 5}
    valid = qa.validate_qa(parsed)
    got = {(r["batch"], r["item_pos"]): (r["outcome"], len(r["source_timestamps"])) for r in valid.collect()}
    assert got == {(0, 0): ("merge", 1), (0, 1): ("skipped", 0), (0, 2): ("skipped", 0), (0, 3): ("skipped", 0), (1, 0): ("ok", 6), (2, 0): ("ok", 0), (3, 0): ("long_split", 0)}
    ids = [r["id"] for r in qa.assign_qa_ids(valid).orderBy("id").collect()]
    assert ids == ["1-01-001", "1-01-002", "1-01-003", "1-01-004"]
    assert qa.qa_stats(valid).first()["n_skipped"] == 3


def test_upper_median_and_over_500(spark):
    rows = [(1, 1, 0, i, "q", "a", [], "ok", t) for i, t in enumerate((10, 500, 501, 20))]
    frame = spark.createDataFrame(rows, "episode int, chapter_index int, batch int, item_pos int, question string, answer string, source_timestamps array<string>, outcome string, est_tokens int")
    r = qa.qa_stats(frame).first()
    assert (r["est_tokens_median"], r["est_tokens_max"], r["est_over_500"]) == (500, 501, 1)


def test_later_success_clears_failure(spark):
    frame = spark.createDataFrame([(1, 1, 0, True, 1), (1, 1, 1, False, 1), (1, 1, 1, True, 2), (1, 2, 0, False, 1)], "episode int, chapter_index int, batch int, ok boolean, run int")
    got = {r["chapter_index"]: (r["done_batches"], r["failed_batches"], r["complete"]) for r in qa.merge_batch_status(frame).collect()}
    assert got == {1: ([0, 1], [], True), 2: ([], [0], False)}
    assert [(r["chapter_index"], r["batch"]) for r in qa.pending_batches(frame.select("episode", "chapter_index", "batch").distinct(), frame).collect()] == [(2, 0)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_bm25_multiplicity_and_unknown_words(spark):
    made = index.keyword_index(docs(spark, [("a", "red fox"), ("b", "red red hen"), ("c", ""), ("d", None)]))
    assert made["corpus"].first()["n"] == 4
    asked = spark.createDataFrame([("1", "red"), ("2", "red red"), ("3", "none known")], "query_id string, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25_search(asked, made).collect()}
    assert set(got) == {("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")}
    assert abs(got["2", "a"] - 2 * got["1", "a"]) < 1e-9


def test_partition_invariance(spark):
    made = [("%03d" % i, f"w{i % 7} w{i % 11} w{i}") for i in range(200)]
    asked = spark.createDataFrame([("1", "w3 w5 w9"), ("2", "w1")], "query_id string, text string")
    results = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        frame = docs(spark, made).repartition(int(n))
        results.append(sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search.bm25_search(asked, index.keyword_index(frame)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert results[0] == results[1]


def test_vector_ties_zero_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, None)], "doc_id int, vector array<float>")
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id int, vector array<float>")
    got = search.vector_search(asked, rows, 4).filter("query_id = 4").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4]
    assert search.vector_search(asked.limit(0), rows).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, rank int, score double")


def test_rrf(spark):
    a, b = ranked(spark, [("q", "x", 1, 1.0), ("q", "y", 2, 1.0)]), ranked(spark, [("q", "y", 1, 1.0), ("q", "x", 2, 1.0), ("q", "z", 3, 1.0)])
    assert [r["doc_id"] for r in search.rrf_fuse([a]).orderBy("rank").collect()] == ["x", "y"]
    assert [r["doc_id"] for r in search.rrf_fuse([a, b]).orderBy("rank").collect()] == ["x", "y", "z"]


def test_rerank_drops_missing_and_takes_a_scorer(spark):
    candidates = ranked(spark, [("q", "a", 1, 1.0), ("q", "b", 2, 1.0), ("q", "gone", 3, 1.0)])
    asked = spark.createDataFrame([("q", "red hen")], "query_id string, text string")
    texts = docs(spark, [("a", "blue"), ("b", "red hen!")])
    assert [r["doc_id"] for r in search.rerank(candidates, asked, texts).orderBy("rank").collect()] == ["b", "a"]

    def shorter(q, t):
        return -t.str.len().astype("float64")

    assert [r["doc_id"] for r in search.rerank(candidates, asked, texts, scorer=shorter).orderBy("rank").collect()] == ["a", "b"]


def test_ground_truth_and_metrics(spark):
    chunks = spark.createDataFrame([(1, "c1", 1, "00:00:00", "00:00:10"), (1, "c2", 1, "00:00:10", "00:30:00"), (1, "c3", 2, None, "00:00:05"), (2, "d1", 1, "00:00:00", "01:00:00")], "episode int, id string, chapter_index int, start_ts string, end_ts string")
    asked = spark.createDataFrame([("q1", 1, ["00:00:10", "bad", None, "00:25:00"]), ("q2", 1, ["09:00:00"]), ("q3", 2, ["00:00:01", "00:00:02"])], "query_id string, episode int, timestamps array<string>")
    gold = rank_eval.map_ground_truth(asked, chunks)
    assert sorted((r["query_id"], r["doc_id"]) for r in gold.collect()) == [("q1", "c1"), ("q1", "c2"), ("q3", "d1")]
    lists = spark.createDataFrame([("m", "q1", "x", 1), ("m", "q1", "c2", 2), ("m", "q2", "c1", 1)], "method string, query_id string, doc_id string, rank int")
    hits = rank_eval.query_hits(lists, gold, ["m", "none"])
    got = {r["method"]: r for r in rank_eval.compare_methods(hits).collect()}
    assert (got["m"]["hit_1"], got["m"]["hit_3"], got["m"]["mrr"]) == (0.0, 0.5, 0.25)
    assert abs(got["m"]["recall"] - 1 / 3) < 1e-12 and got["none"]["recall"] == 0.0
    rates = [r["hit_rate"] for r in rank_eval.hit_rate_at_k(hits).filter("method = 'm'").orderBy("k").collect()]
    assert rates == sorted(rates)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    first = index.upsert_by_id(old, new)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, index.upsert_by_id(first, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    changed = index.changed_chunks(spark.createDataFrame([("a", "x"), ("b", "new")], "id string, text string"), spark.createDataFrame([("a", "x"), ("b", "old")], "id string, text string"))
    assert [r["id"] for r in changed.collect()] == ["b"]


def test_sample_quota_is_half_even_and_exact(spark):
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(10)], "id int, episode string")
    got = judge_eval.stratified_sample(rows, 5, 1).groupBy("episode").count().collect()
    assert {r["episode"]: r["count"] for r in got} == {"a": 3, "b": 2}
    assert judge_eval.stratified_sample(rows, 50, 1).count() == 10


def test_judges(spark):
    schema = "faq_id int, answer_model string, score string, error string, tokens struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, judge_tokens struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"
    rows = spark.createDataFrame([(1, "a", "good", None, (1, None, 2), None), (2, "a", "bad", "", None, (1, 1, 2)), (1, "b", "good", None, None, None), (2, "b", "failed", "boom", None, None)], schema)
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "answer_model string")
    got = {r["answer_model"]: r for r in judge_eval.judge_summary(rows, models).collect()}
    assert got["b"]["failed"] == 1 and got["a"]["failed"] == 0 and got["c"]["good_rate"] is None
    assert judge_eval.best_model(judge_eval.judge_summary(rows, models)).first()["answer_model"] == "b"
    use = {r["answer_model"]: (r["prompt_tokens"], r["completion_tokens"], r["total_tokens"]) for r in judge_eval.token_usage(rows).collect()}
    assert use == {"a": (2, 1, 4), "b": (0, 0, 0)}


def test_feedback(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, 1, "2026-08-07 22:30:00", words(0)), (2, -1, "2026-08-10 10:00:00", words(49)), (3, 0, "bad", words(50)), (4, None, None, words(999)), (5, 1, "2026-08-10 01:00:00", words(1000))]
    log = spark.createDataFrame(rows, "feedback_id int, rating int, ts string, answer string")
    parsed = feedback.feedback_parse(log)
    days = [(str(r["day"]), r["n"]) for r in feedback.daily_counts(parsed).orderBy("day").collect()]
    assert days == [("2026-08-08", 1), ("2026-08-09", 0), ("2026-08-10", 2)]
    total = feedback.feedback_totals(log).first()
    assert (total["total"], total["good"], total["bad"], total["positive_rate"]) == (5, 2, 3, 0.4)
    assert {r["label"]: r["n"] for r in feedback.label_counts(parsed).collect()} == {"helpful": 2, "not helpful": 1}
    bins = [r["n"] for r in feedback.answer_length_histogram(log).orderBy("bin_start").collect()]
    assert bins == [2, 1, 0, 0, 0, 0, 1, 1]
    assert feedback.daily_counts(parsed.limit(0)).count() == 0


def test_citations(spark):
    doc = "struct<episode:int,guest:string,chapter:string,start_ts:string,end_ts:string,text:string>"
    d = [(1, "G", "C", "s", "e", "t"), (2, "H", "D", "s", "e", "t")]
    rows = spark.createDataFrame([("x [2] [2] [9] [0]", d), ("none", d), ("My SOURCE [1]", d), ("x", [])], f"raw string, docs array<{doc}>")
    got = context.cite_sources(rows).collect()
    assert got[0]["sources"] == ['[2] Episode 2 · H · chapter "D" · s-e'] and len(got[1]["sources"]) == 2
    assert got[2]["answer"] == "My SOURCE [1]" and got[3]["sources"] == []


def test_feedback_files(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = spark.createDataFrame([(1, "q", None, "m", ["1-2"], None)], "rating int, question string, answer string, model string, doc_ids array<string>, ts string")
    files.append_feedback(log, path)
    (tmp_path / "log" / "part-x.json").write_text('\n{"rating": 1, "ts": "2026-01-01T00:00:00Z"}\nbroken\n')
    got = files.read_feedback(spark, path).collect()
    assert len(got) == 3 and sum(r["_corrupt_record"] is not None for r in got) == 1 and sum(r["ts"] is not None for r in got) == 2


def test_stream_drops_repeats_and_equals_batch(spark, tmp_path):
    rows = [(i, 1 if i % 3 else -1, datetime(2026, 1, 1 + i % 4, 12)) for i in range(40)]
    log = spark.createDataFrame(rows, "feedback_id long, rating int, ts timestamp")
    log.union(log).write.parquet(f"{tmp_path}/in")
    stream.run_to_table(stream.daily_label_counts(stream.read_feedback_stream(spark, f"{tmp_path}/in", log.schema, "parquet"), "10 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((str(r["day"]), r["label"], r["n"]) for r in stream.read_counts(spark, f"{tmp_path}/out").collect())
    want = log.withColumn("label", feedback.rating_label()).groupBy(F.to_date("ts").alias("day"), "label").count().collect()
    assert got == sorted((str(r["day"]), r["label"], r["count"]) for r in want)


def test_episode_and_qa_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>x</p>")
    assert files.read_pages(spark, f"file://{tmp_path}").first()["html"] == "<p>x</p>"
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "a.json").write_text('{"episode": 7, "faqs": [{"id": null, "question": "q", "answer": "a"}, {"id": "z", "question": "q", "answer": "a", "episode": 8}]}')
    assert sorted((r["faq_id"], r["episode"]) for r in files.read_qa(spark, f"file://{tmp_path}/qa").collect()) == [("7-q1", 7), ("z", 8)]


def test_pages_are_packed_and_their_files_do_not_grow_with_them(spark, tmp_path):
    odd = [" ", "\n", "a\r\nb\n\n", "\u2028é😀", '"\\', "x" * 300_000]
    for i, html in enumerate(odd):
        (tmp_path / "in" / str(i % 2)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(i % 2) / f"{i}.html").write_text(html, newline="")
    loose = files.read_pages(spark, f"file://{tmp_path}/in")
    files.pack_pages(loose, f"{tmp_path}/packed")
    read = lambda rows: sorted((r["path"].rsplit("/", 1)[1], r["html"]) for r in rows.collect())
    assert read(files.read_packed_pages(spark, f"{tmp_path}/packed")) == read(loose) == [(f"{i}.html", html) for i, html in enumerate(odd)]

    from loomline.plans.registry import QUERIES

    spark.range(-1500, 1500).selectExpr("id + 1500 AS page_id", "concat('<p>', id, '\n\n') AS html").repartition(3).write.parquet(f"{tmp_path}/many/pages.parquet")
    made = QUERIES["read_pages"](spark, f"{tmp_path}/many")
    assert len(made.inputFiles()) < 20
    assert sorted(tuple(r) for r in made.collect()) == [(i, f"<p>{i - 1500}\n\n") for i in range(3000)]


def test_indented_files_and_lines_are_read(spark, tmp_path):
    import json

    episode = {"episode": 3, "guest": "G", "chapters": [{"title": "A", "segments": [{"speaker": "G", "timestamp": "00:00:01", "text": "hi"}]}, {"title": "B", "segments": []}]}
    pairs = {"episode": 7, "faqs": [{"id": None, "question": "q", "answer": "a", "source_timestamps": ["00:00:01"]}]}
    for form, indent in (("indented", 2), ("lines", None)):
        for name, what in (("episodes", episode), ("qa", pairs)):
            (tmp_path / form / name).mkdir(parents=True)
            for k in (0, 1):
                (tmp_path / form / name / f"{k}.json").write_text("\n" + json.dumps({**what, "episode": what["episode"] + k}, indent=indent))
        read = files.flatten_episodes(files.read_episodes(spark, f"file://{tmp_path}/{form}/episodes")).collect()
        assert sorted((r["episode"], r["chapter"], r["text"]) for r in read) == [(3, "A", "hi"), (4, "A", "hi")]
        assert sorted((r["faq_id"], r["timestamps"]) for r in files.read_qa(spark, f"file://{tmp_path}/{form}/qa").collect()) == [("7-q1", ["00:00:01"]), ("8-q1", ["00:00:01"])]


def test_brackets_in_a_context(spark):
    rows = spark.createDataFrame([("q", 1, 5, None, 'Part [one] more "x"', "00:00:01", "00:00:02", "t"), ("q", 2, 5, "G", None, "00:00:03", "00:00:04", None)], "query_id string, rank int, episode int, guest string, chapter string, start_ts string, end_ts string, text string")
    assert context.build_context(rows).first()["context"] == '[1] (Episode 5 · Unknown · chapter "Part [one] more "x"" · 00:00:01-00:00:02)\nt\n\n[2] (Episode 5 · G · chapter "" · 00:00:03-00:00:04)\n'


def test_chapters_of_one_title(spark):
    pairs = spark.createDataFrame([(1, "B", "1-02-001"), (1, "A", "1-01-001"), (1, "A", "1-03-001"), (1, "?", "1-00-001")], "episode int, chapter string, id string")
    chapters = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "A", 3)], "episode int, chapter string, chapter_index int")
    assert [(r["id"], r["place"]) for r in qa.order_qa(pairs, chapters).orderBy("place").collect()] == [("1-01-001", 1), ("1-03-001", 2), ("1-02-001", 3), ("1-00-001", 4)]


def test_many_open_tags_are_walked_once():
    import time

    began = time.time()
    rows = intake.walk_page("<h1 class='entry-title'>T</h1>" + "<p>x" * 60_000 + "<div class='ts-segment'><span class='ts-name'>N</span><span class='ts-text'>hi</span></div>")
    assert [r[1] for r in rows] == ["title", "segment"] and time.time() - began < 5


def test_vector_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "DOC_BLOCK", 7)
    import numpy as np

    x = np.random.default_rng(1).integers(-2, 3, (40, 3)).astype(float)
    rows = spark.createDataFrame([(f"d{i:02}", v.tolist()) for i, v in enumerate(x)] + [("null", None)], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(10)] + [(99, None)], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search.vector_search(asked, rows, 5).collect())
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    want = [(q, k + 1, f"d{i:02}") for q in range(10) for k, i in enumerate(sorted(range(40), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5])]
    assert got == want


def test_entry_without_the_llm_packages():
    """With a package of the subpackage missing, and with the subpackage and the pipeline gone, the other queries stay."""
    import subprocess
    import sys
    from pathlib import Path

    for gone in (["ahocorasick"], ["loomline.llm", "corpus_pipeline"], ["corpus_pipeline"]):
        code = f"import sys\nfor n in {gone!r}: sys.modules[n] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'bm25_search' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)\nprint('op3_near_duplicates' in q)"
        out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120, check=True).stdout
        assert out.strip() == str(gone == ["corpus_pipeline"] and _llm_is_there())


def _llm_is_there() -> bool:
    try:
        import loomline.llm.registry  # noqa: F401
    except ImportError:
        return False
    return True


def test_each_file_is_judged_by_itself(spark, tmp_path):
    from loomline.sources import documents

    files_of = {
        "lines.json": '{"a": 1}\n\n{"a": 2}\n', "first_broken.json": '{"a": \n{"a": 3}\n{"a": 4}\n', "indented.json": '{\n  "a": 5,\n  "b": [\n    {"c": 1}\n  ]\n}\n', "several.json": '{\n "a": 6\n}\n{\n "a": 7\n}\n{"a": 8}{"a": 9}\n',
        "array.json": '[{"a": 10},\n {"a": 11}]', "broken_indented.json": '{\n  "a": 12,\n  "b": [{"c": 1}\n', "words.json": 'no json\n"text"\n12\n{"a": 13}\n', "marked.json": '﻿{"a": 14}\n', "empty.json": "", "blank.json": " \n\n",
    }
    for name, text in files_of.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sorted(r["a"] for r in documents.read_json(spark, str(tmp_path), "a int").collect())
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14]
    rejects = {(r["path"].rpartition("/")[2], r["reject"]) for r in documents.read_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {("first_broken.json", '{"a":'), ("broken_indented.json", '{\n  "a": 12,\n  "b": [{"c": 1}'), ("words.json", 'no json\n"text"\n12')}


def test_large_files_keep_their_lines(spark, tmp_path, monkeypatch):
    from loomline.sources import documents

    monkeypatch.setattr(documents, "WHOLE_BYTES", 10)
    (tmp_path / "a.json").write_text('{"a": \n{"a": 3}\n')
    assert [r["a"] for r in documents.read_json(spark, str(tmp_path), "a int").collect()] == [3]
    assert [r["reject"] for r in documents.read_rejects(spark, str(tmp_path)).collect()] == ['{"a":']


def _counting(folder):
    """An encoder that leaves a line a text in a file of its own, and stops at a text that says so while the folder has no file `go`."""

    def make():
        import os
        import uuid

        import numpy as np

        def encode(texts):
            if "stop" in texts and not os.path.exists(f"{folder}/go"):
                raise RuntimeError("stopped")
            with open(f"{folder}/{uuid.uuid4().hex}.calls", "w") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return np.array([[len(t), 1.0] for t in texts], np.float32)

        return encode

    return make


def _calls(folder):
    return sorted(line for f in folder.glob("*.calls") for line in f.read_text().splitlines())


def test_texts_are_encoded_once_and_a_stopped_run_goes_on(spark, tmp_path):
    from pyspark.errors import PySparkException

    from loomline.operators import encoding
    from loomline.sources import snapshots

    store, seen = str(tmp_path / "store"), tmp_path / "seen"
    seen.mkdir()
    rows = spark.createDataFrame([(i, f"text {i % 40} " + "x" * (i % 7)) for i in range(120)] + [(200, None), (201, "")], "id long, text string")
    texts = {r["text"] or "" for r in rows.collect()}
    assert encoding.encode_into(rows, store, _counting(seen), batch=4, wave_chars=200) == len(texts)
    assert _calls(seen) == sorted(texts) and len(snapshots.entries(spark, store)) > 3
    assert encoding.encode_into(rows, store, _counting(seen)) == 0 and len(_calls(seen)) == len(texts)
    got = encoding.with_vectors(rows, store).collect()
    assert len(got) == 122 and all(r["vector"][0] == len(r["text"] or "") for r in got)

    more = rows.union(spark.createDataFrame([(300 + i, f"new {i}") for i in range(60)] + [(400, "stop")], "id long, text string"))
    try:
        encoding.encode_into(more, store, _counting(seen), batch=1, wave_chars=60, parts=1)
        raise AssertionError("did not stop")
    except PySparkException:
        pass
    kept = snapshots.read_snapshot(spark, store, model="hashing-64").count()
    (seen / "go").touch()
    before = len(_calls(seen))
    assert encoding.encode_into(more, store, _counting(seen), batch=1, wave_chars=60) == len(texts) + 61 - kept
    assert len(_calls(seen)) - before == len(texts) + 61 - kept and snapshots.read_snapshot(spark, store, model="hashing-64").count() == len(texts) + 61


def test_searches_encode_each_text_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"doc {i}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"ask {i}") for i in range(5)], "query_id long, text string")
    search.vector_search(index.embed_texts(asked, _counting(tmp_path)), index.embed_texts(docs, _counting(tmp_path)), 3).collect()
    assert len(_calls(tmp_path)) == 55


def test_snapshots_rewrite_touched_buckets_alone(spark, tmp_path):
    from loomline.sources import snapshots

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "id string, v long")
    assert snapshots.upsert(rows, path, buckets=8) == 1
    old = {e["bucket"]: e["folder"] for e in snapshots.entries(spark, path)}
    one = spark.createDataFrame([("k5", 500), ("k5", 400), ("new", 1)], "id string, v long")
    assert snapshots.upsert(one, path) == 2
    touched = {r["b"] for r in one.select(snapshots.bucket_of("id", 8).alias("b")).collect()}
    assert {b for b, f in old.items() if {e["bucket"]: e["folder"] for e in snapshots.entries(spark, path)}[b] != f} == touched
    got = {r["id"]: r["v"] for r in snapshots.read_snapshot(spark, path).collect()}
    assert len(got) == 201 and got["k5"] == 400 and got["new"] == 1 and got["k7"] == 7
    assert snapshots.read_snapshot(spark, path, 1).filter("id = 'k5'").first()["v"] == 5  # the old version stays readable
    with pytest.raises(RuntimeError):
        snapshots.commit(spark, path, [], 1)  # another writer was first
    assert snapshots.last_version(spark, path) == 2 and snapshots.upsert(one.limit(0), path) == 2


def test_null_speakers_texts_and_answers(spark):
    rows = [(1, 1, "c", 0, None, "00:00:01", "hello there"), (1, 1, "c", 1, "A", "00:00:02", None), (1, None, "c", 2, "A", "00:00:03", "lost")]
    seg = spark.createDataFrame(rows, "episode int, chapter_index int, chapter string, pos int, speaker string, timestamp string, text string")
    got = chunking.chunk_segments(seg, spark.createDataFrame([(1, "A")], "episode int, guest string")).collect()
    assert [(r["id"], r["text"]) for r in got] == [("1-01-001", "Unknown: hello there\nA: ")] and chunking.keyless_segments(seg).count() == 1
    doc = "struct<id:string,episode:int,guest:string,chapter:string,start_ts:string,end_ts:string,text:string>"
    answers = spark.createDataFrame([(None, [("a", 1, "g", "c", "00:00:01", "00:00:02", "t")])], f"raw string, docs array<{doc}>")
    assert context.cite_sources(answers).first()["answer"].startswith("\n\nSources:\n[1] ")


def test_resume_takes_the_first_queries_before_it_drops_finished_ones(spark):
    asked = spark.createDataFrame([(f"q{i}", 9 - i) for i in range(6)], "query_id string, place int")
    done = spark.createDataFrame([("q5", "ok", 10), ("q0", "ok", 10)], "query_id string, status string, depth int")
    assert sorted(r["query_id"] for r in rank_eval.resume_queries(asked, done, {"depth": 10}, limit=3, order="place").collect()) == ["q3", "q4"]
    assert rank_eval.resume_queries(asked, done, {"depth": 10}, limit=1, order="place").count() == 0


def test_days_as_a_stream_equal_the_batch(spark, tmp_path):
    """Late, repeated and restarted input; local days, days without rows, timers that close a day."""
    from loomline.streaming import days

    rows = [(i, [1, -1, 0, None][i % 4], datetime(2026, 1, 1 + 2 * (i % 3), 23, i % 60), f"q{i}", None if i % 5 else "m") for i in range(60)]
    more = [(100 + i, 1, datetime(2026, 1, 4, 1, i), f"late {i}", "m") for i in range(5)] + rows[:7] + [(300, 1, datetime(2026, 1, 12, 12), "last", None), (301, 1, None, "no time", None)]
    schema = "feedback_id long, rating int, ts timestamp, question string, model string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    source = lambda: stream.read_feedback_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, "parquet")
    days.run_days(source(), f"{tmp_path}/out", f"{tmp_path}/state", late="3 days")
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    days.run_days(source(), f"{tmp_path}/out", f"{tmp_path}/state", late="3 days")
    whole = feedback.feedback_parse(spark.createDataFrame(rows + more[:5] + more[-2:], schema))
    timed = whole.filter("ts is not null")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(days.read_daily_counts(spark, f"{tmp_path}/out")) == plain(feedback.daily_counts(whole))
    assert plain(days.read_label_counts(spark, f"{tmp_path}/out")) == plain(feedback.label_counts(timed))
    latest = days.read_latest(spark, f"{tmp_path}/out")
    assert feedback.recent_questions(latest).collect() == feedback.recent_questions(whole).collect()
    closed = {str(r["day"]): r["closed"] for r in days.read_day_labels(spark, f"{tmp_path}/out").collect()}
    assert closed["2026-01-02"] and not closed["2026-01-12"]


def test_sketches_keep_their_rank_error_over_merges(spark):
    rows = spark.range(60_000).selectExpr("timestamp_seconds(id * 10) AS ts", "cast(pmod(xxhash64(id), 1000003) AS double) AS retrieval_ms")
    exact = sorted(r["retrieval_ms"] for r in rows.collect())
    k = 512
    made = feedback.latency_quantiles(feedback.latency_sketches(rows, k), "month", k=k).first()
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        rank = np.searchsorted(exact, made[name], "right") / len(exact)
        assert abs(rank - q) < 4 / k
    assert made["n"] == 60_000


def test_chapters_of_one_walk_equal_those_of_a_window(spark):
    seg = lambda name, text: f'<div class="ts-segment"><span class="ts-name">{name}</span><span class="ts-timestamp">(00:00:0{len(text)})</span><span class="ts-text">{text}</span></div>'
    head = lambda i, title: f'<h2 id="chapter{i}_x">{title}</h2>'
    pages = [(1, seg("A", "a") + head(1, "One") + seg("B", "bb") + head(2, "") + head(3, "Three") + seg("", "ccc")), (2, None), (3, head(1, "Empty")), (4, seg("A", "a") * 3)]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    once = intake.page_segments(frame)
    columns = ["page_id", "node_pos", "chapter_index", "chapter", "speaker", "timestamp", "text"]
    window = intake.assign_chapters(intake.parse_segments(frame)).select(*columns)
    assert sorted(map(str, once.select(*columns).collect())) == sorted(map(str, window.collect())) and once.count() == 6
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_membership_filter_gives_the_exact_anti_join(spark, monkeypatch):
    from loomline.functions.scratch import stored
    from loomline.operators import membership

    held = spark.range(0, 60_000).select((F.col("id") * 7).alias("k"), F.lit("a").alias("s")).union(spark.createDataFrame([(None, "a"), (7, None)], "k long, s string"))
    rows = spark.range(0, 20_000).select((F.col("id") * 5).alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), F.lit(1).alias("extra")).union(spark.createDataFrame([(None, "a", 1), (7, None, 1), (35, "a", 1)], "k long, s string, extra int"))
    keys, part = ["k", "s"], F.pmod(F.xxhash64("k"), F.lit(4))
    want = sorted(rows.join(held, keys, "left_anti").select("k", "s", "extra").collect(), key=str)
    for known, by in ((stored(membership.key_filter(held, keys), "f"), None), (stored(membership.key_filter(held, keys, part), "f"), part)):
        assert known.count() >= 60_000 * membership.BITS_A_KEY / membership.BLOCK_BITS and known.filter("length(bits) != 4096").count() == 0
        maybe = membership.possibly_known(rows, keys, known, "maybe", by)
        assert maybe.columns == ["k", "s", "extra", "maybe"]
        sure = rows.join(held, keys, "left_semi")
        assert sure.join(maybe.filter("not maybe"), keys, "left_semi").count() == 0  # none that is held is ruled out
        passed = maybe.filter("maybe").count()
        assert sure.count() <= passed <= sure.count() + 0.02 * 20_000
        assert "Exchange hashpartitioning" not in maybe._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        for few in (1_000_000, 0):  # keys found are broadcast, or possible hits shuffled
            monkeypatch.setattr(membership, "BROADCAST_KEYS", few)
            assert sorted(membership.absent(rows, held, keys, known, by).select("k", "s", "extra").collect(), key=str) == want
    monkeypatch.setattr(membership, "FILTER_BYTES", 4096)  # too large a filter is not used
    assert not membership.fits(known) and sorted(membership.absent(rows, held, keys, known, by).select("k", "s", "extra").collect(), key=str) == want


def test_membership_filter_on_odd_tables(spark):
    from loomline.operators import membership

    none = spark.createDataFrame([], "k long")
    rows = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert membership.key_filter(none, ["k"]).count() == 0
    assert membership.absent(rows, none, ["k"], membership.key_filter(none, ["k"])).count() == 3
    assert membership.absent(none, rows, ["k"], membership.key_filter(rows, ["k"])).count() == 0
    assert membership.absent(rows, rows, ["k"], membership.key_filter(rows, ["k"])).collect() == [(None,)]
    ints = rows.selectExpr("int(k) AS k")
    assert membership.absent(ints, rows, ["k"], membership.key_filter(rows, ["k"])).collect() == [(None,)]  # hashes of other types differ, so the filter is left aside
    doubles = spark.createDataFrame([(0.0,)], "k double")
    assert membership.absent(spark.createDataFrame([(-0.0,)], "k double"), doubles, ["k"], membership.key_filter(doubles, ["k"])).count() == 0


def test_snapshots_keep_filters_of_touched_buckets(spark, tmp_path):
    from loomline.operators import index, membership
    from loomline.sources import snapshots

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(200)], "id string, text string")
    snapshots.upsert(rows, path, buckets=8, filter_keys=index.CHUNK_KEYS)
    old = {e["bucket"]: e["filter"] for e in snapshots.entries(spark, path)}
    more = spark.createDataFrame([("k5", "other text"), ("new", "text")], "id string, text string")
    assert snapshots.upsert(more, path, filter_keys=index.CHUNK_KEYS) == 2
    new = {e["bucket"]: e["filter"] for e in snapshots.entries(spark, path)}
    assert {b for b, f in old.items() if new[b] != f} == {r["b"] for r in more.select(snapshots.bucket_of("id", 8).alias("b")).collect()}
    known, parts = snapshots.read_filter(spark, path)
    asked = rows.union(more).union(spark.createDataFrame([("k6", "changed"), ("k900", "text 9")], "id string, text string"))
    got = index.changed_chunks(asked, snapshots.read_snapshot(spark, path), known, snapshots.bucket_of("id", parts))
    assert sorted(tuple(r) for r in got.collect()) == [("k5", "text 5"), ("k6", "changed"), ("k900", "text 9")]
    snapshots.upsert(more, path)  # a bucket written without a filter: none is read
    assert snapshots.read_filter(spark, path) == (None, 0) and not membership.fits(None)


def test_texts_of_chunks_move_once(spark):
    rng = __import__("random").Random(3)
    words = lambda n: " ".join(["w"] * n)
    rows = [(e, c, f"c{c}", p, rng.choice(["s", None]), f"{p:08}", rng.choice([words(rng.randint(0, 6)), None])) for e in (1, 2, None) for c in (1, 2, 4, None) for p in range(rng.choice([1, 30]))]
    rows += [(1, 2, "c2", 5, "t", "00000000", "x y"), (1, 2, "c2", None, "u", None, "z")]  # one place twice, and no place
    rng.shuffle(rows)
    guests = spark.createDataFrame([(1, "G")], "episode int, guest string")
    made = chunking.chunk_segments(seg(spark, rows), guests, 10)
    assert not [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "text" in x or "collect_list" in x]
    want, n = [], {}
    order = lambda v: (v is not None, v)
    size = lambda r: len((r[6] or "").split())
    for e, c in sorted({r[:2] for r in rows if None not in r[:2]}):
        pack = []
        packs = [pack]
        for r in sorted((r for r in rows if r[:2] == (e, c)), key=lambda r: (order(r[3]), size(r))):
            if pack and sum(map(size, pack)) + size(r) > 10:
                packs.append(pack := [])
            pack.append(r)
        for pack in packs:
            n[e] = n.get(e, 0) + 1
            lines = sorted((order(r[3]), order(r[5]), f"{r[4] or 'Unknown'}: {r[6] or ''}") for r in pack)
            want.append((f"{e}-{c:02}-{n[e]:03}", e, {1: "G"}.get(e), f"c{c}", c, lines[0][1][1], lines[-1][1][1], "\n".join(x[2] for x in lines)))
    for records in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        assert sorted(map(tuple, made.collect())) == sorted(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
