"""Queries of answer evaluation and feedback monitoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.scratch import scratch, stored
from loomline.operators import feedback as B
from loomline.operators import judge_eval as J
from loomline.plans import views as V
from loomline.plans.views import SEG, STOP_WORDS, table, with_ctes
from loomline.sources import files
from loomline.streaming import days
from loomline.streaming import feedback as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY 1), q AS (SELECT lang, c, round_even(c / (SELECT sum(c) FROM c) * 120, 0)::BIGINT AS quota FROM c),
f AS (SELECT lang, quota + CASE WHEN lang = (SELECT lang FROM c ORDER BY c DESC, lang LIMIT 1) THEN 120 - (SELECT sum(quota) FROM q) ELSE 0 END AS quota FROM q)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS rn FROM documents) JOIN f USING (lang) WHERE rn <= quota""")
def stratified_sample(spark, d):
    """A sampling operator: 120 documents spread over languages."""
    return J.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), 120, 7, "doc_id", "lang").select("doc_id", "lang")


_BATCH = "w AS (SELECT j.faq_id, m.answer_model FROM (SELECT DISTINCT faq_id FROM judged) j CROSS JOIN models m WHERE NOT EXISTS (SELECT 1 FROM judged r WHERE r.faq_id = j.faq_id AND r.answer_model = m.answer_model AND r.score IN ('good', 'bad')))"


def _worklist(spark, d):
    results = V.judged(spark, d)
    return J.eval_worklist(results.select("faq_id").distinct(), V.models(spark, d), results), results


@query(with_ctes("judged", "models")[:-1] + f", {_BATCH} SELECT faq_id, answer_model FROM w")
def eval_worklist(spark, d):
    return _worklist(spark, d)[0].select("faq_id", "answer_model")


@query(with_ctes("judged", "models")[:-1] + f", {_BATCH} SELECT faq_id, answer_model, score FROM judged WHERE (faq_id, answer_model) NOT IN (SELECT faq_id, answer_model FROM w)")
def drop_stale_results(spark, d):
    work, results = _worklist(spark, d)
    return J.drop_stale_results(results, work).select("faq_id", "answer_model", "score")


@query(with_ctes("judged") + "SELECT faq_id FROM judged WHERE answer_model = 'src1' AND error IS NULL")
def results_compatible(spark, d):
    return J.results_compatible(V.judged(spark, d), {"answer_model": "src1", "error": None}).select("faq_id")


@query(with_ctes("judged") + """SELECT answer_model, sum(n_chars + CASE WHEN toxic IS NULL THEN 0 ELSE 10 END)::BIGINT AS prompt_tokens, sum(CASE WHEN quality IS NULL THEN 0 ELSE faq_id % 100 END + CASE WHEN toxic IS NULL THEN 0 ELSE 2 END)::BIGINT AS completion_tokens,
  sum(n_chars + faq_id % 100 + CASE WHEN toxic IS NULL THEN 0 ELSE 12 END)::BIGINT AS total_tokens FROM judged GROUP BY 1""")
def token_usage(spark, d):
    return J.token_usage(V.judged(spark, d))


_SUMMARY = """summary AS (SELECT m.answer_model, count(faq_id) AS total, count(*) FILTER (score = 'good') AS good, count(*) FILTER (score = 'bad') AS bad, count(error) AS failed,
  CASE WHEN count(faq_id) > 0 THEN count(*) FILTER (score = 'good')::DOUBLE / count(faq_id) END AS good_rate FROM models m LEFT JOIN judged j ON j.answer_model = m.answer_model GROUP BY 1)"""


@query(with_ctes("judged", "models")[:-1] + f", {_SUMMARY} SELECT answer_model, total, good, bad, failed, round(good_rate, 6) AS good_rate FROM summary")
def judge_summary(spark, d):
    return J.judge_summary(V.judged(spark, d), V.models(spark, d)).withColumn("good_rate", F.round("good_rate", 6))


@query(with_ctes("judged", "models")[:-1] + f", {_SUMMARY} SELECT answer_model, round(good_rate, 6) AS good_rate FROM summary WHERE total > 0 ORDER BY summary.good_rate DESC, answer_model DESC LIMIT 1")
def best_model(spark, d):
    return J.best_model(J.judge_summary(V.judged(spark, d), V.models(spark, d))).withColumn("good_rate", F.round("good_rate", 6))


@query(with_ctes("judged") + "SELECT faq_id, answer_model, substr(question, 1, 90) AS question, reasoning FROM judged WHERE score = 'bad' ORDER BY faq_id, answer_model LIMIT 10")
def bad_cases(spark, d):
    return J.bad_cases(V.judged(spark, d), 10)


@query(with_ctes("judged") + """, r AS (SELECT answer_model, avg(CASE WHEN score = 'good' THEN 1.0 ELSE 0.0 END) FILTER (rewrite_mode = 'plain') AS a, avg(CASE WHEN score = 'good' THEN 1.0 ELSE 0.0 END) FILTER (rewrite_mode = 'rewritten') AS b FROM judged GROUP BY 1)
SELECT answer_model, round(a, 6) AS rate_plain, round(b, 6) AS rate_rewritten, round(b - a, 6) AS delta FROM r""")
def compare_runs(spark, d):
    made = J.compare_runs(V.judged(spark, d))
    return made.select("answer_model", *[F.round(c, 6).alias(c) for c in ("rate_plain", "rate_rewritten", "delta")])


@query(with_ctes("judged") + "SELECT faq_id, score, 10 AS depth FROM judged")
def write_results(spark, d):
    """Two configurations written to one place; each keeps its own rows."""
    path = scratch(spark, "results")
    rows = V.judged(spark, d).select("faq_id", "score")
    files.write_results(rows, path, {"depth": 10})
    files.write_results(rows.withColumn("score", F.lit("other")), path, {"depth": 20})
    return spark.read.parquet(path).filter("depth = 10")


# feedback --------------------------------------------------------------------------------------------


def _parsed(spark, d):
    return B.feedback_parse(V.feedback(spark, d))


@query(with_ctes("feedback") + "SELECT feedback_id, CASE WHEN feedback_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, label FROM feedback")
def feedback_parse(spark, d):
    """Times as text, some malformed."""
    log = V.feedback(spark, d).withColumn("ts", F.when(F.col("feedback_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time"))
    return B.feedback_parse(log).select("feedback_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "label")


@query(with_ctes("feedback") + "SELECT count(*) AS total, count(*) FILTER (rating = 1) AS good, count(*) - count(*) FILTER (rating = 1) AS bad, round(count(*) FILTER (rating = 1) / count(*)::DOUBLE, 6) AS positive_rate FROM feedback")
def feedback_totals(spark, d):
    return B.feedback_totals(V.feedback(spark, d)).withColumn("positive_rate", F.round("positive_rate", 6))


@query(with_ctes("feedback") + "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS time, substr(question, 1, 120) AS question, coalesce(model, '') AS model, CASE rating WHEN 1 THEN 'helpful' WHEN -1 THEN 'not helpful' WHEN 0 THEN 'no rating' END AS rating FROM feedback WHERE ts IS NOT NULL ORDER BY ts DESC, feedback_id LIMIT 5")
def recent_questions(spark, d):
    return B.recent_questions(_parsed(spark, d))


@query(with_ctes("feedback") + "SELECT label, count(*) AS n FROM feedback WHERE label IS NOT NULL GROUP BY 1")
def label_counts(spark, d):
    return B.label_counts(_parsed(spark, d))


@query(with_ctes("feedback") + """, x AS (SELECT (ts + INTERVAL 1 HOUR)::DATE AS day, count(*) AS n FROM feedback WHERE ts IS NOT NULL GROUP BY 1)
SELECT c.day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM x) c LEFT JOIN x ON x.day = c.day""")
def daily_counts(spark, d):
    """Local days in January (UTC + 1)."""
    return B.daily_counts(_parsed(spark, d))


@query(with_ctes("feedback") + "SELECT episode, count(*) AS n FROM (SELECT k::VARCHAR AS episode FROM feedback WHERE k IS NOT NULL UNION ALL SELECT (k + 1)::VARCHAR FROM feedback WHERE k IS NOT NULL) GROUP BY 1")
def citations_by_episode(spark, d):
    return B.citations_by_episode(V.feedback(spark, d))


def _user_turns(spark, d, role, name):
    return table(spark, d, "conversations").filter(F.col("role") == role).select(F.col("text").alias(name))


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM conversations WHERE role = 'user') WHERE word NOT IN {STOP_WORDS!r} GROUP BY 1 ORDER BY n DESC, word LIMIT 15""")
def top_words(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    return B.top_words(_user_turns(spark, d, "user", "question"), stop)


@query(r"""WITH b(bin_start, bin_end) AS (VALUES (0, 50), (50, 100), (100, 150), (150, 200), (200, 300), (300, 500), (500, 1000), (1000, NULL)),
a AS (SELECT len(regexp_extract_all(text, '\S+')) AS w FROM conversations WHERE role = 'assistant')
SELECT bin_start, bin_end, count(w) AS n FROM b LEFT JOIN a ON w >= bin_start AND (bin_end IS NULL OR w < bin_end) GROUP BY 1, 2""")
def answer_length_histogram(spark, d):
    return B.answer_length_histogram(_user_turns(spark, d, "assistant", "answer"))


@query(with_ctes("feedback") + "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, retrieval_ms FROM feedback WHERE ts IS NOT NULL AND retrieval_ms IS NOT NULL")
def latency_series(spark, d):
    return B.latency_series(_parsed(spark, d)).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "retrieval_ms")


_LATENCY = " count(*) AS n, quantile_disc(retrieval_ms, 0.5) AS p50, quantile_disc(retrieval_ms, 0.95) AS p95, max(retrieval_ms) AS longest FROM feedback WHERE ts IS NOT NULL AND retrieval_ms IS NOT NULL GROUP BY 1"


@query(with_ctes("feedback") + "SELECT ts::DATE AS day," + _LATENCY)
def latency_by_day(spark, d):
    return B.latency_by_day(_parsed(spark, d))


@query(with_ctes("feedback") + "SELECT date_trunc('week', ts)::DATE AS week," + _LATENCY)
def latency_by_week(spark, d):
    """Sketches of days, stored and merged by week; the log gives the values between which they place a quantile."""
    return B.exact_quantiles(_parsed(spark, d), stored(B.latency_sketches(_parsed(spark, d)), "sketches"), "week")


@query(with_ctes("feedback") + "SELECT feedback_id, rating, question, model, array_to_string([k || '-01-001', (k + 1) || '-02-002'], ',') AS doc_ids FROM feedback")
def append_feedback(spark, d):
    """The log appended in two parts as JSON lines and read again."""
    path = scratch(spark, "feedback")
    log = V.feedback(spark, d).select("rating", F.concat_ws("|", F.col("feedback_id").cast("string"), "question").alias("question"), F.lit(None).cast("string").alias("answer"), "model", "doc_ids", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    files.append_feedback(log.filter("rating is not null"), path)
    files.append_feedback(log.filter("rating is null").withColumn("ts", F.lit(None).cast("string")), path)
    back = files.read_feedback(spark, path).filter("ts is not null and _corrupt_record is null")
    parts = F.split("question", r"\|", 2)
    return back.select(parts[0].cast("long").alias("feedback_id"), "rating", parts[1].alias("question"), "model", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(with_ctes("feedback") + "SELECT ts::DATE AS day, label, count(*) AS n FROM feedback WHERE label IS NOT NULL GROUP BY 1, 2")
def feedback_stream(spark, d):
    """The log, sent twice, as a stream of files up to what is there; equal to the batch."""
    path, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    log = V.feedback(spark, d).select("feedback_id", "rating", "ts")
    log.union(log).repartitionByRange(4, "ts").write.parquet(path)
    stream = S.read_feedback_stream(spark, path, log.schema, "parquet")
    S.run_to_table(S.daily_label_counts(stream, "40 days"), out, scratch(spark, "stream-state"))
    return S.read_counts(spark, out)


@query(with_ctes("feedback") + """, l AS (SELECT (ts + INTERVAL 1 HOUR)::DATE AS day FROM feedback WHERE ts IS NOT NULL), s AS (SELECT min(day) AS lo, max(day) AS hi FROM l),
c AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM s)
SELECT c.day, count(l.day) AS n FROM c LEFT JOIN l ON l.day = c.day GROUP BY 1""")
def feedback_days_stream(spark, d):
    """The log, sent twice, as a stream with state a day: counts of all ratings by local day, equal to the batch."""
    path, out = scratch(spark, "days-in"), scratch(spark, "days-out")
    log = V.feedback(spark, d).select("feedback_id", "rating", "ts", "question", "model")
    log.union(log).repartitionByRange(4, "ts").write.parquet(path)
    days.run_days(S.read_feedback_stream(spark, path, log.schema, "parquet"), out, scratch(spark, "days-state"), late="40 days")
    return days.read_daily_counts(spark, out)


@query(with_ctes("feedback") + "SELECT coalesce(rating, 9) AS rating, count(*) AS n, count(DISTINCT question) AS questions FROM feedback GROUP BY 1")
def read_feedback(spark, d):
    """The log as JSON lines with broken lines between, which are told apart."""
    path = scratch(spark, "feedback")
    log = V.feedback(spark, d).select("rating", "question", "model", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    lines = log.select(F.to_json(F.struct("*")).alias("value"))
    lines.union(lines.limit(3).select(F.lit("{broken"))).write.text(path)
    good = files.read_feedback(spark, path).filter("_corrupt_record is null")
    return good.groupBy(F.coalesce("rating", F.lit(9)).alias("rating")).agg(F.count("*").alias("n"), F.countDistinct("question").alias("questions"))
