"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import collections
import re

import corpus_pipeline
from loomline.llm import mixing, sharding

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, frames = [collections.Counter(r["doc_id"] for r in docs.collect())], {}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
        assert docs.columns == columns + ["shard"] * (name == "sharding")
    start, clean, unique, safe, mixed, sharded = kept
    assert set(clean) <= set(start) and len(clean) >= 0.85 * len(start)

    sets = {i: shingles(texts[i]) for i in clean}
    label = {i: i for i in clean}
    for _ in range(3):
        for i in sorted(clean):
            for j in sorted(clean):
                if j < i and sets[i] and sets[j]:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        label[i] = label[j] = min(label[i], label[j])
    assert set(unique) == {i for i in clean if label[i] == i}

    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(safe) == {i for i in unique if not any(len(q & sets[i]) >= 0.8 * len(q) for q in items if q)}

    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(frames["benchmark_decontamination"]).collect()}
    assert mixed == collections.Counter({k: v for k, v in plan.items() if v})
    assert sharded == mixed
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(frames["mixing"]).collect()}
    assert all(shard[r["doc_id"]] == r["shard"] for r in docs.collect())


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SMALL).filter("shard is null").count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, null ids, empty tables and columns whose names the stages use."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 0), (5, long + " more", "en", "b", 1), (4, long, "en", "b", 1), (7, "same words here", "fr", None, 1), (6, "same words here", "fr", "a", 1),
        (8, "Same WORDS here", "fr", "a", 1), (8, "Same WORDS here", "fr", "a", 1), (None, "no id at all in this one", "en", "c", 1), (None, "no id at all in this one", "en", "c", 1), (None, leak, "en", "c", 1), (8, leak, "en", "c", 1),
    ]
    clashing = ("score", "toxic_spans", "_h", "_key", "shard", "row", "key", "class", "times", "copy", "h", "src", "edge", "size")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(clashing)]).repartition(3)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SMALL)
        assert out.columns == frame.columns + ["shard_"] * (name == "sharding")
        assert all(out.filter(f"{c} <> {i}").isEmpty() for i, c in enumerate(clashing))
        ids[name] = sorted(str(r["doc_id"]) for r in out.collect())
        assert stage(spark, frame.limit(0), SMALL).count() == 0
    every = sorted(str(r[0]) for r in rows)
    assert ids["toxicity"] == every and ids["sharding"] == every
    assert ids["minhash_near_dedup"] == sorted(["1", "2", "3", "4", "6", "None", "8"])
    assert ids["benchmark_decontamination"] == sorted(str(r[0]) for r in rows if r[1] != leak)
    assert set(ids["mixing"]) <= set(every)
