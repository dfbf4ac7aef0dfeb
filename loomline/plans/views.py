"""Stand-ins of the jobs' inputs, made from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.text import seconds_to_clock, word_count
from loomline.operators.chunking import chunk_segments
from loomline.operators.intake import detect_guest

HOST, CAP, MODEL = "user", 200, "hashing-64"
STOP_WORDS = ("a", "and", "for", "in", "is", "it", "of", "on", "the", "to", "with")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: ten conversations are an episode's chapters; the clock is the running number of words as seconds."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.expr("conv_id div 10").alias("episode"), (F.col("conv_id") % 10 + 1).cast("int").alias("chapter_index"),
        F.concat(F.lit("Chapter "), (F.col("conv_id") % 10 + 1).cast("string")).alias("chapter"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text",
    )
    before = Window.partitionBy("episode").orderBy("chapter_index", "pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(word_count(F.col("text"))).over(before), F.lit(0))
    return rows.withColumn("timestamp", seconds_to_clock(at))


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_guest(segments(spark, sf_dir), HOST)


def chunks(spark: SparkSession, sf_dir: str, cap: int = CAP, rows: DataFrame | None = None) -> DataFrame:
    """rows: the segments, where they are made already."""
    rows = segments(spark, sf_dir) if rows is None else rows
    return chunk_segments(rows, detect_guest(rows, HOST), cap)


def golden_queries(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Every user turn asks; its truth is at the clock of the turn after it. rows: the segments, where they are made already."""
    nxt = F.lead("timestamp").over(Window.partitionBy("episode", "chapter_index").orderBy("pos"))
    rows = segments(spark, sf_dir) if rows is None else rows
    rows = rows.withColumn("text", F.when(F.col("speaker") == HOST, F.col("text")))  # no other text has to move
    rows = rows.withColumn("next", nxt).filter(F.col("speaker") == HOST)
    name = F.format_string("%s-%s-%s", F.col("episode").cast("string"), F.col("chapter_index").cast("string"), F.col("pos").cast("string"))
    return rows.select(name.alias("query_id"), "episode", "text", F.when(F.col("next").isNotNull(), F.array("next")).otherwise(F.array().cast("array<string>")).alias("timestamps"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of the user and the next turn, numbered in their chapter, as a model would list them."""
    w = Window.partitionBy("episode", "chapter_index").orderBy("pos")
    rows = segments(spark, sf_dir).withColumn("answer", F.lead("text").over(w)).filter((F.col("speaker") == HOST) & F.col("answer").isNotNull())
    return rows.withColumn("no", F.row_number().over(w) - 1).withColumnRenamed("text", "question")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses in four shapes by conversation: raw, fenced, in prose, broken."""
    fields = [
        F.col("question"), F.col("answer"),
        F.when(F.col("no") % 3 == 1, "merge").when(F.col("no") % 3 == 2, "odd").otherwise("ok").alias("boundary"),
        (F.col("no") % 5 == 4).alias("skipped"),
    ]
    one = F.to_json(F.struct(*fields, F.col("timestamp").alias("source_timestamps")))
    many = F.to_json(F.struct(*fields, F.array("timestamp").alias("source_timestamps")))
    item = pairs(spark, sf_dir).select("episode", "chapter_index", "no", F.when(F.col("no") % 2 == 0, many).otherwise(one).alias("item"))
    grouped = item.groupBy("episode", "chapter_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "item"))), lambda x: x["item"]), ",").alias("items"))
    key = F.when(F.col("chapter_index") % 2 == 0, "faqs").otherwise("qa_pairs")
    whole = F.concat(F.lit('{"'), key, F.lit('":['), F.col("items"), F.lit("]}"))
    kind = (F.col("chapter_index") - 1) % 4
    content = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\nDone."))).when(kind == 2, F.concat(F.lit("The pairs are "), whole, F.lit(" as asked.")))
    return grouped.select("episode", "chapter_index", F.lit(0).alias("batch"), content.otherwise(F.expr("substring(concat('{\"', 'qa_pairs', '\":[', items, ']}'), 1, length(items) + 14)")).alias("content"))


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the batches of 150 words: the first fails every third batch, the second mends those of even chapters."""
    from loomline.operators.chunking import batch_segments

    batches = batch_segments(segments(spark, sf_dir), 150).select("episode", "chapter_index", "batch").distinct()
    first = batches.withColumn("ok", F.col("batch") % 3 != 2).withColumn("run", F.lit(1))
    second = batches.filter("batch % 3 = 2 and chapter_index % 2 = 0").withColumn("ok", F.lit(True)).withColumn("run", F.lit(2))
    return first.union(second)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judged answers: the model is the source, the verdict the quality label."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("failed")
    tokens = F.struct(F.col("n_chars").alias("prompt_tokens"), F.when(F.col("quality").isNotNull(), F.col("doc_id") % 100).alias("completion_tokens"), (F.col("n_chars") + F.col("doc_id") % 100).alias("total_tokens"))
    judge = F.when(F.col("toxic").isNotNull(), F.struct(F.lit(10).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(12).alias("total_tokens")))
    return rows.select(
        F.col("doc_id").alias("faq_id"), F.col("text").alias("question"), F.col("source").alias("answer_model"), F.col("lang").alias("episode"), score.alias("score"),
        F.concat(F.lit("label "), F.col("quality").cast("string")).alias("reasoning"), F.when(score == "failed", "no verdict").alias("error"),
        tokens.alias("tokens"), judge.alias("judge_tokens"), F.when(F.col("lang") == "en", "plain").otherwise("rewritten").alias("rewrite_mode"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("answer_model")).distinct()
    return rows.union(spark.createDataFrame([("unused",)], "answer_model string"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("feedback_id"), F.when(kind == "purchase", 1).when(kind == "error", -1).when(kind == "view", 0).alias("rating"),
        F.concat_ws(" ", kind, F.lit("of user"), F.col("user_id").cast("string")).alias("question"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string"))).alias("model"),
        F.when(k.isNotNull(), F.array(F.concat(k, F.lit("-01-001")), F.concat((k.cast("int") + 1).cast("string"), F.lit("-02-002")))).alias("doc_ids"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(kind != "signup", F.col("value")).alias("retrieval_ms"),
    )


#: The same in SQL, by name, each after those it needs.
CTES: dict[str, str] = {
    "seg0": r"""SELECT conv_id // 10 AS episode, (conv_id % 10 + 1)::INTEGER AS chapter_index, 'Chapter ' || (conv_id % 10 + 1) AS chapter, turn AS pos, role AS speaker, text,
      len(regexp_extract_all(text, '\S+')) AS words FROM conversations""",
    "seg": """SELECT *, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS timestamp FROM (
      SELECT *, coalesce(sum(words) OVER (PARTITION BY episode ORDER BY chapter_index, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM seg0)""",
    "guests": f"""SELECT e.episode, g.speaker AS guest FROM (SELECT DISTINCT episode FROM seg) e LEFT JOIN (
      SELECT episode, speaker, row_number() OVER (PARTITION BY episode ORDER BY n DESC, seen, speaker) AS rn FROM (
        SELECT episode, speaker, count(*) AS n, min(chapter_index * 1000000 + pos) AS seen FROM seg WHERE speaker <> '{HOST}' GROUP BY 1, 2)) g
      ON g.episode = e.episode AND rn = 1""",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY episode, chapter_index ORDER BY pos) AS n FROM seg",
    "packs": f"""SELECT episode, chapter_index, n, words AS acc, 1 AS pack FROM ordered WHERE n = 1 UNION ALL
      SELECT o.episode, o.chapter_index, o.n, CASE WHEN p.acc + o.words > {CAP} THEN o.words ELSE p.acc + o.words END, CASE WHEN p.acc + o.words > {CAP} THEN p.pack + 1 ELSE p.pack END
      FROM packs p JOIN ordered o ON o.episode = p.episode AND o.chapter_index = p.chapter_index AND o.n = p.n + 1""",
    "packs150": """SELECT episode, chapter_index, n, words AS acc, 0 AS batch FROM ordered WHERE n = 1 UNION ALL
      SELECT o.episode, o.chapter_index, o.n, CASE WHEN p.acc + o.words > 150 THEN o.words ELSE p.acc + o.words END, CASE WHEN p.acc + o.words > 150 THEN p.batch + 1 ELSE p.batch END
      FROM packs150 p JOIN ordered o ON o.episode = p.episode AND o.chapter_index = p.chapter_index AND o.n = p.n + 1""",
    "packed": """SELECT o.episode, o.chapter_index, p.pack, any_value(o.chapter) AS chapter, min(o.s) AS lo, max(o.s) AS hi, arg_min(o.timestamp, o.n) AS start_ts, arg_max(o.timestamp, o.n) AS end_ts,
      string_agg(o.speaker || ': ' || o.text, E'\\n' ORDER BY o.n) AS text FROM ordered o JOIN packs p USING (episode, chapter_index, n) GROUP BY 1, 2, 3""",
    "chunks": """SELECT printf('%d-%02d-%03d', episode, chapter_index, row_number() OVER (PARTITION BY episode ORDER BY chapter_index, pack)) AS id, episode, guest, chapter, chapter_index, start_ts, end_ts, text, lo, hi
      FROM packed JOIN guests USING (episode)""",
    "golden": f"""SELECT printf('%d-%d-%d', episode, chapter_index, pos) AS query_id, episode, text, t FROM (
      SELECT *, lead(s) OVER (PARTITION BY episode, chapter_index ORDER BY pos) AS t FROM seg) WHERE speaker = '{HOST}'""",
    "gold": """SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, c.id AS doc_id, row_number() OVER (PARTITION BY query_id, t ORDER BY c.chapter_index, c.id) AS rn
      FROM golden g JOIN chunks c ON c.episode = g.episode AND g.t BETWEEN c.lo AND c.hi) WHERE rn = 1""",
    "pairs": f"""SELECT episode, chapter_index, chapter, pos, timestamp, text AS question, answer, row_number() OVER (PARTITION BY episode, chapter_index ORDER BY pos) - 1 AS no FROM (
      SELECT *, lead(text) OVER (PARTITION BY episode, chapter_index ORDER BY pos) AS answer FROM seg) WHERE speaker = '{HOST}' AND answer IS NOT NULL""",
    "valid": """SELECT episode, chapter_index, 0 AS batch, no AS item_pos, trim(question) AS question, trim(answer) AS answer, timestamp AS source_timestamps,
      CASE WHEN no % 5 = 4 OR length(trim(question)) < 8 OR length(trim(answer)) < 20 THEN 'skipped' WHEN no % 3 = 1 THEN 'merge' ELSE 'ok' END AS outcome,
      (length(trim(question)) + length(trim(answer)) + 3) // 4 AS est_tokens FROM pairs WHERE (chapter_index - 1) % 4 <> 3""",
    "batches": "SELECT DISTINCT episode, chapter_index, batch FROM packs150",
    "status": """SELECT episode, chapter_index, batch, batch % 3 <> 2 AS ok, 1 AS run FROM batches UNION ALL
      SELECT episode, chapter_index, batch, true, 2 FROM batches WHERE batch % 3 = 2 AND chapter_index % 2 = 0""",
    "judged": """SELECT d.doc_id AS faq_id, d.text AS question, d.source AS answer_model, d.lang AS episode, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'failed' END AS score,
      'label ' || quality AS reasoning, CASE WHEN quality IS NULL OR quality NOT IN (0, 1) THEN 'no verdict' END AS error, n_chars, quality, toxic,
      CASE WHEN lang = 'en' THEN 'plain' ELSE 'rewritten' END AS rewrite_mode FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "models": "SELECT DISTINCT source AS answer_model FROM documents UNION ALL SELECT 'unused'",
    "feedback": """SELECT event_id AS feedback_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'view' THEN 0 END AS rating, event_type || ' of user ' || user_id AS question,
      CASE WHEN user_id % 7 <> 0 THEN 'model-' || (user_id % 3) END AS model, (props::JSON ->> '$.k')::INTEGER AS k, ts, CASE WHEN event_type <> 'signup' THEN value END AS retrieval_ms,
      CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'error' THEN 'not helpful' END AS label FROM events""",
}


def with_ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n"


SEG = ("seg0", "seg")
CHUNKS = (*SEG, "guests", "ordered", "packs", "packed", "chunks")


def bm25_sql(name: str, docs: str, queries: str, n: int, k1: float = 1.5, b: float = 0.75) -> str:
    """CTE `name` (query_id, doc_id, score, rank) over relations with doc_id, text and query_id, text."""
    tok = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
    return f"""
    {name}_k AS (SELECT doc_id, {tok} AS terms FROM {docs}),
    {name}_d AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM {name}_k),
    {name}_n AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {name}_k),
    {name}_tf AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM {name}_d GROUP BY doc_id, term),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
    {name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok}) AS term FROM {queries}) GROUP BY ALL),
    {name}_s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)))) AS score
      FROM {name}_q JOIN {name}_df USING (term) JOIN {name}_tf USING (term), {name}_n GROUP BY 1, 2),
    {name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {n})"""


def hashed_sql(name: str, texts: str, key: str, dims: int = 64) -> str:
    """CTE `name` (key, vector) of signed hashed terms over a relation with that key and text; crc32 by its table."""
    sums = ", ".join(f"coalesce(sum(sign) FILTER (place = {i}), 0)::DOUBLE" for i in range(dims))
    return f"""
    {name}_c AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
    {name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM {texts}),
    {name}_h AS (SELECT term, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(term)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]))) AS h FROM (SELECT DISTINCT term FROM {name}_t), {name}_c),
    {name}_p AS (SELECT {key}, h % {dims} AS place, CASE WHEN h & 65536 > 0 THEN 1 ELSE -1 END AS sign FROM {name}_t JOIN {name}_h USING (term)),
    {name} AS (SELECT {key}, [{sums}] AS vector FROM {name}_p RIGHT JOIN {texts} USING ({key}) GROUP BY 1)"""


def cosine_sql(name: str, docs: str, queries: str, n: int) -> str:
    """CTE `name` over relations with doc_id, vector and query_id, vector."""
    return f"""
    {name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, coalesce(nullif(list_cosine_similarity(q.vector::DOUBLE[], d.vector::DOUBLE[]), 'nan'::DOUBLE), 0) AS score FROM {queries} q, {docs} d)) WHERE rank <= {n})"""


def rrf_sql(name: str, lists: list[str], n: int, k: int = 60) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank, {i} AS list_no FROM {x}" for i, x in enumerate(lists))
    return f"""
    {name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, doc_id) AS rank FROM (
      SELECT query_id, doc_id, sum(1.0::DOUBLE / ({k} + rank)) AS score, min(list_no * 100000 + rank) AS seen FROM ({union}) GROUP BY 1, 2)) WHERE rank <= {n})"""
