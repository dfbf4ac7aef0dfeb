"""Odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; and laws of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import chat, decontaminate, langid, mixing, neardup, pii, sharding, tokens, toxicity
from loomline.llm.components import components


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**60, 20_000)
    for n in (1, 2, 24, 100):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02
        assert (np.bincount(a, minlength=n) < 1.5 * len(keys) / n + 50).all()


def test_sharding_odd(odd_documents, no_documents):
    got = sharding.shard_rows(odd_documents, 4).collect()
    assert len(got) == 12 and {r["law"] for r in got} == {"key"}
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert by_id(sharding.shard_rows(odd_documents))[1]["size"] == 8 and by_id(sharding.shard_rows(odd_documents))[1]["text_crc32"] == 0
    assert sharding.shard_rows(no_documents).count() == 0
    assert sharding.with_shard(odd_documents, 4).count() == 12


def test_equal_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 4)
    rows = spark.createDataFrame([(None, "same")] * 23 + [(1, "a")] * 4 + [(i, "b") for i in range(30)], "doc_id long, text string").repartition(3)
    got = sharding.shard_rows(rows, 3).collect()
    assert sum(r["doc_id"] is None for r in got) == 23 and len(got) == 57
    for shard in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_near_duplicates_odd(odd_documents, no_documents):
    got = by_id(neardup.near_duplicates(odd_documents, 85))
    assert got[1]["n_shingles"] == got[2]["n_shingles"] == got[3]["n_shingles"] == 0
    assert got[5]["component_id"] == 4 and not got[5]["kept"] and got[8]["component_id"] == 6 and got[7]["component_id"] == 6
    assert got[None]["kept"] and got[None]["component_id"] is None and got[9]["component_id"] == 9
    assert neardup.near_duplicates(odd_documents).count() == 12 and neardup.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_lose_no_link_in_a_large_group(spark, percent):
    """Copies of one text with more and more edits: classes equal those of all pairs."""
    rng = np.random.default_rng(percent)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        copy = list(words)
        for at in rng.choice(150, i % 8, replace=False):
            copy[at] = f"e{i}x{at}" if rng.random() < 0.7 else ""
        rows.append((i, " ".join(w for w in copy if w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i] for i in range(len(rows))] == label


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[300] == 0 and got[1199] == 1000 and got[5000] == 4000 and len(got) == 301 + 200 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_odd_and_targets(spark, odd_documents, no_documents):
    got = mixing.mix(odd_documents).collect()
    assert len(got) == 12 and all(r["taken"] <= 2 * r["size"] for r in got)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in targets.values()) - 1.5 * sum(s for s, _ in targets.values())) < 1e-3
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mixed_rows(no_documents).count() == 0
    rows = spark.createDataFrame([(i, "w " * (i % 9), "s" + str(i % 3)) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(rows).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 8
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(rows.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    repeats = {r["doc_id"]: r["repeats"] for r in got}
    copies = {r["doc_id"]: r["n"] for r in mixing.mixed_rows(rows).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {k: v for k, v in repeats.items() if v}


def test_mixing_meets_targets_with_null_and_repeated_ids(spark):
    rows = [(None, "w " * 20, "a", 7, 8)] * 40 + [(1, "x y z", "a", 7, 8)] * 3 + [(i, "q " * (i % 7), "b" if i % 2 else None, 7, 8) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, h long, times long").repartition(5)
    got = mixing.mix(frame).collect()
    for source, size in (("a", 20), ("b", 6), (None, 6)):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size / 2
    want = sorted(str((r["doc_id"], r["size"], r["source"], r["repeats"])) for r in got)
    assert want == sorted(str((r["doc_id"], r["size"], r["source"], r["repeats"])) for r in mixing.mix(frame.repartition(2)).collect())
    mixed = mixing.mixed_rows(frame)
    assert mixed.columns == frame.columns and mixed.filter("h <> 7 or times <> 8").count() == 0
    assert mixed.agg(F.sum(mixing.word_size(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def test_targets_equal_filling_round_by_round(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 40):
        sizes = [int(x) for x in rng.integers(0, 1000, n)]
        frame = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        weight, level = [(3, 1, 2)[i % 3] for i in range(n)], 0.0
        for _ in range(n + 1):
            full = [2 * s <= w * level for s, w in zip(sizes, weight, strict=True)]
            if all(full):
                break
            level = (1.5 * sum(sizes) - sum(2 * s for s, f in zip(sizes, full, strict=True) if f)) / sum(w for w, f in zip(weight, full, strict=True) if not f)
        assert np.allclose([got[f"s{i:02}"] for i in range(n)], [min(2 * s, w * level) for s, w in zip(sizes, weight, strict=True)], atol=1e-5)


def test_scorers_odd(spark, odd_documents, no_documents):
    field = toxicity.fit(__import__("pyarrow").array(["good", "bad words"] * 20), np.array([0, 1] * 20))
    got = by_id(toxicity.score_texts(odd_documents, field))
    assert len(got) == 11 and got[1]["score"] == got[2]["score"] == got[3]["score"] == 0.0 and got[4]["h"] == 7
    assert toxicity.score_texts(odd_documents, None).filter("score > 0").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(odd_documents, labels).count() == 12 and toxicity.classify(no_documents, labels).count() == 0
    model = langid.train(odd_documents.drop("lang_pred"))
    got = by_id(langid.identify(odd_documents, model))
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[10]["lang_pred"] == "und" and got[9]["lang_pred"] in ("en", "fr", "de", "es")
    assert langid.train(no_documents) is None and langid.identify(odd_documents, None).filter("lang_pred <> 'und'").count() == 0
    got = by_id(tokens.count_tokens(odd_documents, [("▁same", -1.0), ("s", -2.0)]))
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[4]["n_tokens"] > 0
    assert tokens.count_tokens(odd_documents, []).count() == 12 and tokens.count_tokens(no_documents, []).count() == 0


def test_personal_data_odd(odd_documents, no_documents):
    got = by_id(pii.find_personal_data(odd_documents, pii.train(odd_documents)))
    assert len(got) == 11 and got[1]["spans"] == got[2]["spans"] == "" and got[1]["n_email"] == 0
    assert pii.find_personal_data(no_documents, pii.train(no_documents)).count() == 0


def test_chat_odd(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", ""),
        (5, None, None, None), (6, 0, "user", "hi "), (None, 0, "user", "lost"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "user", "a"), (9, 5, "user", "twin"), (10, 1, "user", "twin"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS h0", "3 AS n_turns")
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.format_chats(frame).collect()}
    assert set(got) == {3, 4, 5, 6, 7, 9} and got[3][0] == 3 and got[5][1] == "<|unknown|>\n\n<|end|>\n"
    assert got[4][1].startswith("<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n")
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_contained_items_odd(spark, odd_documents, no_documents):
    item = " ".join(f"t{i}" for i in range(40))
    items = spark.createDataFrame([(1, item), (2, "same WORDS here"), (3, ""), (4, None), (None, "x"), (5, "a b c d e")], "item_id long, text string")
    docs = odd_documents.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(50, "before " + item.upper() + " after"), (51, item[: len(item) * 3 // 4]), (52, item), (52, item), (53, "x a b c d e y")], "doc_id long, text string"), allowMissingColumns=True).selectExpr("*", "1 AS w0", "2 AS mark", "3 AS n_item", "4 AS item_id", "5 AS need")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contained_items(docs, items).collect())
    assert got == [(6, 2, 1, 1), (7, 2, 1, 1), (8, 2, 1, 1), (50, 1, 36, 36), (52, 1, 36, 36), (53, 5, 1, 1)]
    assert got == sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contained_items(docs, items.selectExpr("*", "1 AS rate", "2 AS mark", "3 AS n_item")).collect())
    assert decontaminate.contained_items(no_documents, items).count() == 0 and decontaminate.contained_items(docs, items.limit(0)).count() == 0


def test_containment_of_all_sizes_equals_brute_force(spark):
    """Items of one to 600 shingles, contained to 60 % and more, in one piece or scattered over a long document."""
    rng = np.random.default_rng(8)
    items, docs = [], []
    for i, n in enumerate([1, 4, 5, 9, 30, 40, 70, 130, 300, 600]):
        words = [f"i{i}w{k}" for k in range(n + 4 if n > 1 else 3)]
        items.append((i, " ".join(words)))
        for j in range(12):
            cut = [w if rng.random() > 0.008 * (j % 6) else f"x{j}" for w in words]
            filler = [f"f{x}" for x in rng.integers(0, 3000, 800)]
            at = sorted(rng.integers(0, 800, 2).tolist()) if j % 2 else [300, 300]
            half = len(cut) // 2
            docs.append((100 * i + j, " ".join(filler[: at[0]] + cut[:half] + filler[at[0] : at[1]] + cut[half:] + filler[at[1] :])))
    sets = {}
    for kind, rows in (("i", items), ("d", docs)):
        for key, text in rows:
            w = text.split()
            sets[kind, key] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    want = sorted((d, i, len(sets["i", i]), len(sets["i", i] & sets["d", d])) for d, _ in docs for i, _ in items if len(sets["i", i] & sets["d", d]) >= 0.8 * len(sets["i", i]))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 40
