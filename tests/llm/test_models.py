"""Operators that SQL cannot express, against brute force, exact counts or held-out accuracy."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import embeddings, langid, pii, tokens, toxicity
from loomline.llm.common import table
from loomline.llm.textscan import Words, as_bytes

SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# words -----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA b\t\n\x0b\x0cé中😀.", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, offsets = as_bytes(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    got = [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(words.row, words.start, words.end, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    marks = {}
    for (_, w), m in zip(got, words.mark.tolist(), strict=True):
        folded = w.translate(str.maketrans("A", "a"))
        assert marks.setdefault(folded, m) == m
    assert len(set(marks.values())) == len(marks)


def test_words_across_slices_and_arrow_offsets(monkeypatch):
    from loomline.llm import textscan

    column = pa.array(["skip", "one two", None, "three " * 50, "x" * 300 + " end"]).slice(1)
    whole = Words(*as_bytes(column))
    monkeypatch.setattr(textscan, "SLICE", 40)
    cut = Words(*as_bytes(column))
    assert (whole.mark == cut.mark).all() and (whole.row == cut.row).all() and (whole.start == cut.start).all()


# toxicity --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 40, 100])
def test_marginals_equal_enumeration_or_recursion(n):
    rng = np.random.default_rng(n)
    theta, moves = rng.normal(size=n), rng.normal(size=(2, 2))
    first = rng.random(n) < 0.2
    first[0] = True
    p, pair = toxicity.marginals(theta, first, moves)
    begins = [*np.flatnonzero(first), n]
    for a, b in itertools.pairwise(begins):
        if b - a > 12:
            continue
        total, ones, both = 0.0, np.zeros(b - a), np.zeros((b - a, 4))
        for path in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum(theta[a + i] * y for i, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            total += weight
            ones += weight * np.array(path)
            for i in range(1, b - a):
                both[i, 2 * path[i - 1] + path[i]] += weight
        assert np.allclose(p[a:b], ones / total) and np.allclose(pair[a:b], both / total)


@pytest.mark.parametrize("n", [1, 2, 7])
def test_document_score_equals_enumeration(n):
    rng = np.random.default_rng(n)
    theta, moves = rng.normal(size=2 * n), rng.normal(size=(2, 2))
    first = np.arange(2 * n) % n == 0
    p, pair = toxicity.marginals(theta, first, moves)
    got = toxicity.log_clean(p, pair, np.repeat([0, 1], n), 2)
    for r in (0, 1):
        weights = [np.exp(sum(theta[r * n + i] * y for i, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path))) for path in itertools.product((0, 1), repeat=n)]
        assert np.isclose(got[r], np.log(weights[0] / sum(weights)))


def plain_score(field, text):
    """Chance that any word is toxic by a plain forward recursion over the words of a text."""
    if not text or not text.split():
        return 0.0
    words = Words(*as_bytes(pa.array([text])), prefixes=toxicity.PREFIXES, alnum_only=True)
    place = {int(m): i for i, m in enumerate(field.marks[:-1])}
    marks = [[int(x) for x in m] for m in toxicity.feature_marks(words)]
    theta = [field.by_length[min(int(words.end[t] - words.start[t]), 31)] + sum(field.w[place[m[t]]] if m[t] in place else 0.0 for m in marks) for t in range(len(words.row))]
    clean, total = 0.0, np.array([0.0, theta[0]])
    for t in range(1, len(theta)):
        clean += field.moves[0, 0]
        total = np.array([np.logaddexp(*(total + field.moves[:, y])) + y * theta[t] for y in (0, 1)])
    return 1 - np.exp(clean - np.logaddexp(*total))


def test_query_scores_equal_the_plain_recursion(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    field = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        if len(texts[i] or "") < 20_000:
            assert np.isclose(r["score"], plain_score(field, texts[i]), atol=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


@pytest.mark.parametrize(("folder", "false_ones"), [(MEDIUM, 1), (LARGE, 4)])
def test_toxicity_held_out(spark, folder, false_ones):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert (toxic.predicted == 1).mean() >= 0.9 and (got[got.toxic == 0].predicted == 1).sum() <= false_ones
    assert got.score.between(0, 1).all() and (got.score > 0).all() and got.score.nunique() > 0.8 * len(got)


def test_sample_is_drawn_from_ids_with_a_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 3)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 5)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)] + [(7, 0, 0), (None, 0, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "x" * (70_000 if i % 5 == 0 else 9)) for i in range(200)], "doc_id long, text string")
    got = [tuple(r) for r in toxicity.sample(docs, labels).collect()]
    assert sorted(t for _, t in got) == [False] * 5 + [True] * 3 and all(len(t) == 9 for t, _ in got)


def test_spans_are_the_toxic_words():
    texts = [f"you are a friend said {i} stay calm today" for i in range(60)] + [f"you are a zorgle! said {i} today" for i in range(30)]
    field = toxicity.fit(pa.array(texts), np.array([0] * 60 + [1] * 30))
    scores, spans = toxicity.tag(field, pa.array(["é a zorgle, calm", "words stay calm", None, "", "a zorgle and é a zorgle!"]))
    assert [(s["start"], s["end"]) for s in spans[0]] == [(4, 11)] and scores[0] > 0.9
    assert [(s["start"], s["end"]) for s in spans[4]] == [(2, 8), (17, 24)]
    assert scores[1] < 0.1 and scores[2:4] == [0.0, 0.0] and toxicity.fit(pa.array(["a"]), np.array([0])) is None


def test_long_rows_are_scored_in_parts(monkeypatch):
    texts = [f"you are a friend said {i} stay calm today" for i in range(60)] + [f"you are a zorgle! said {i} today" for i in range(30)]
    field = toxicity.fit(pa.array(texts), np.array([0] * 60 + [1] * 30))
    long = pa.array(["stay calm " * 300 + "zorgle " + "stay calm " * 300, "calm"])
    whole, spans = toxicity.tag(field, long)
    monkeypatch.setattr(toxicity, "PART", 2500)
    parts, same = toxicity.tag(field, long)
    assert len(list(toxicity.windows(*as_bytes(long), 0, 2))) == 3 and np.allclose(whole, parts, atol=1e-9) and [(x["start"], x["end"]) for x in spans[0]] == [(x["start"], x["end"]) for x in same[0]] == [(3000, 3006)]


def test_parts_of_a_text_are_one_chain(monkeypatch):
    """Scores, spans and their chances do not depend on where a text is cut: within spans, in runs of spaces, between rows."""
    texts = [f"you are a friend said {i} stay calm today" for i in range(60)] + [f"you are a zorgle blorx! said {i} today" for i in range(30)]
    field = toxicity.fit(pa.array(texts), np.array([0] * 60 + [1] * 30))
    field.moves[:] = [[0.0, -1.0], [-0.5, 1.5]]
    rng = np.random.default_rng(2)
    words = ["calm", "zorgle", "é", "blorx", "today", "you", "friend", " " * 90]
    rows = [" ".join(words[i] for i in rng.choice(8, 60, p=[0.3, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1])) for _ in range(6)] + [None, "", "   ", "zorgle " * 40]
    whole, spans = toxicity.tag(field, pa.array(rows))
    assert sum(len(x) for x in spans) > 10
    for part in (3, 40, 100, 333):
        monkeypatch.setattr(toxicity, "PART", part)
        scores, same = toxicity.tag(field, pa.array(rows))
        assert np.allclose(scores, whole, rtol=0, atol=1e-9)
        assert [[(s["start"], s["end"]) for s in x] for x in same] == [[(s["start"], s["end"]) for s in x] for x in spans]
        assert np.allclose([s["p"] for x in same for s in x], [s["p"] for x in spans for s in x], atol=1e-9)


# language --------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = table(spark, MEDIUM, "documents")
    got = langid.op8_language(spark, MEDIUM).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_scores_equal_plain_counting(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.train(docs)
    texts = ["Hello there, world", "x", "", "ab  ab"]
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores, strict=True):
        raw = re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode())
        total = model.prior.copy()
        for n in langid.SIZES:
            for i in range(len(raw) - n + 1):
                if raw[i : i + 2] == b"  ":
                    continue
                code = (int.from_bytes(raw[i : i + n], "big") + n) * 0x9E3779B1 % 2**32
                code ^= code >> 15
                total = total + model.log_p[(code * 0x85EBCA77 % 2**32) >> 17]
        p = np.exp(total - total.max())
        assert model.langs[int(total.argmax())] == lang and abs(p.max() / p.sum() - score) < 1e-4


def test_grams_of_long_rows_in_parts(monkeypatch):
    column = pa.array(["some words of a text " * 9, "", "x", "more and more"])
    whole = [np.concatenate(x) for x in zip(*langid.grams(*as_bytes(column), 0, 4), strict=True)]
    monkeypatch.setattr(langid, "SLICE", 16)
    parts = [np.concatenate(x) for x in zip(*langid.grams(*as_bytes(column), 0, 4), strict=True)]
    assert sorted(zip(*map(np.ndarray.tolist, whole), strict=True)) == sorted(zip(*map(np.ndarray.tolist, parts), strict=True))


# tokens ----------------------------------------------------------------------------------------------


def test_counts_equal_the_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models

    vocabulary = tokens.load_vocabulary()
    unigram = Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], unk_id=0, byte_fallback=False)).model
    count = lambda t: sum(len(unigram.tokenize(tokens.SPACE_MARK + w)) for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    docs = table(spark, SMALL, "documents")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op7_token_counts(spark, SMALL).collect()}
    assert got == {r["doc_id"]: count(r["text"]) for r in docs.collect()}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab▁", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -4.0]), min_size=1, max_size=12), st.text(alphabet="abc", min_size=1, max_size=12))
def test_ties_are_those_of_the_tokenizer(pieces, word):
    from tokenizers import Tokenizer, models

    vocabulary = sorted(pieces.items())
    unigram = Tokenizer(models.Unigram([("<unk>", min(pieces.values())), *vocabulary], unk_id=0, byte_fallback=False)).model
    assert tokens.Counter(vocabulary).count(word) == len(unigram.tokenize(tokens.SPACE_MARK + word))


def test_long_words_keep_few_places():
    from tokenizers import Tokenizer, models

    vocabulary = [("a", -2.0), ("ab", -2.5), ("aba", -3.0), ("▁", -1.0), ("▁a", -1.5), ("bb", -4.0)]
    unigram = Tokenizer(models.Unigram([("<unk>", -4.0), *vocabulary], unk_id=0, byte_fallback=False)).model
    word = "".join(np.random.default_rng(5).choice(list("aabbc"), 3000).tolist())
    assert tokens.Counter(vocabulary).count(word) == len(unigram.tokenize(tokens.SPACE_MARK + word))


# embeddings ------------------------------------------------------------------------------------------


def plain_links(rows, least=0.9):
    """Rows (id, vector) as sorted (id, n_links, component) by comparing all pairs."""
    fine = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n_links, label = [0] * len(rows), list(range(len(rows)))
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in fine}
    near = {i: [j for j in fine if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in fine}
    for i in fine:
        n_links[i] = len(near[i])
    changed = True
    while changed:
        changed = False
        for i in fine:
            low = min([label[i], *(label[j] for j in near[i])])
            changed |= low < label[i]
            label[i] = low
    least_id = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least_id[label[i]] = min(own, least_id.get(label[i], own))
    return sorted((str(own), n_links[i], str(least_id.get(label[i]))) for i, (own, _) in enumerate(rows))


def planted_vectors():
    """Groups of several widths, repeated rows and vectors, odd rows, null ids and several lengths."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    copies = [base[i] + rng.normal(size=(n, 16)) * s for i, n, s in ((0, 120, 0.02), (1, 90, 0.06), (2, 60, 0.08), (3, 5, 0.05), (4, 1, 0.1))]
    x = np.concatenate([base, *copies, base[:3] * 2, np.repeat(base[5:6], 50, 0)])
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [1.0, 2.0]), (9004, [None] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, []), (9007, [1.0]), (9008, [2.0]), (9009, [-1.0]), (9010, [1.0, 2.1])]
    again = [(None, base[0].tolist()), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (0, x[0].tolist()), (0, x[0].tolist()), (7, base[9].tolist())]
    return [(i, v.tolist()) for i, v in enumerate(x)] + odd + again


@pytest.mark.parametrize("settings", [{}, {"ROOM_ROWS": 40, "BALL_ANGLE": 0.25, "BALL_LEAST": 4}])
def test_links_equal_all_pairs(spark, monkeypatch, settings):
    """Also with rooms met in parts, and with balls so wide that members must be verified."""
    for name, value in settings.items():
        monkeypatch.setattr(embeddings, name, value)
    rows = planted_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS n_links", "3 AS item", "4 AS v", "5 AS rooms").repartition(3)
    got = embeddings.near_vectors(frame).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == plain_links(rows)
    assert all(r["kept"] == (r["component_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0
    one = embeddings.near_vectors(frame.filter("vec_id = 11")).collect()
    assert [(r["n_links"], r["component_id"]) for r in one] == [(0, 11)]


def test_recall_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 8)
    rows = [r for r in planted_vectors() if r[0] is not None and r[1] and len(r[1]) == 16 and r[0] < 9000]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = plain_links(rows)
    found = sorted((str(r["vec_id"]), r["n_links"]) for r in got.collect())
    assert all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert sum(n for _, n in found) >= 0.95 * sum(n for _, n, _ in want)


def test_query_equals_all_pairs_and_the_sampled_recall(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    got = embeddings.op5_embedding_near_duplicates(spark, SMALL)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got.collect()) == plain_links(rows)
    sampled = embeddings.links_by_brute_force(spark.createDataFrame(planted_vectors()[:400], "vec_id long, embedding array<double>"), sample=50).collect()
    want = {i: n for i, n, _ in plain_links(planted_vectors()[:400])}
    assert len(sampled) > 20 and all(want[str(r["vec_id"])] == r["n_links"] for r in sampled)


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(1)
    index = embeddings.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)), groups=2, visits=12)
    x = rng.normal(size=(20, 8))
    a, b = index.halves(x)
    got, rooms = index.place(x)
    for k in range(20):
        order = sorted(range(30), key=lambda c: a[k, c // 5] + b[k, c % 5])
        assert got[k].tolist() == order[:12] and ((rooms >= 0) & (rooms < 4)).all()
    assert (index.traverse(a, b, 99)[:, :12] == got).all() and index.traverse(a, b, 99).shape == (20, 30)
    assert (index.either_rank(x, x) == 0).all()


# personal data ---------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+ 01245()é", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_numbers():
    zeros = "0" * 6000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}") == [(0, 1, 12_006)] and pii.base_spans("9" * 6000) == [] and pii.base_spans("1." * 3000) != []


def test_cards_and_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert plain_spans("x 4111-1111 11111111 y") == pii.base_spans("x 4111-1111 11111111 y") == [(2, 2, 20)]


def test_personal_data_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    for r in pii.op10_personal_data(spark, SMALL).collect():
        base = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r["spans"].split(","))


def test_added_spans_on_held_out_rows(spark):
    """The written table in four parts, each found by a field that has not seen it."""
    drawn = pii.labelled_windows(table(spark, MEDIUM, "documents")).toArrow()
    found = marked = wrong = 0
    for part in range(4):
        features, labels = pii.written_windows(-part - 1)
        windows, states = drawn.column("features").to_pylist(), drawn.column("labels").to_pylist()
        field = pii.fit_field(features + windows, labels + states, [pii.WRITTEN_WEIGHT] * len(labels) + [1.0] * len(states))
        texts, spans = pii.written_rows(part)
        for want, (base, every) in zip(spans, pii.tag(field, pa.array(texts)), strict=True):
            added = [x for x in every if x not in base]
            marked += len(want)
            found += sum(any(a < z and b > x and k == kind for a, k, b in every) for x, kind, z in want)
            wrong += sum(not any(a < z and b > x for x, _, z in want) for a, _, b in added)
    assert found >= 0.8 * marked and wrong <= 4


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    field = pii.ShapeField()
    field.w = rng.normal(size=field.w.shape).astype(np.float32)
    field.moves = rng.normal(size=field.moves.shape).astype(np.float32)
    features = rng.integers(0, pii.FEATURES, (9, 5))
    row = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    got = field.decode(features, row)
    score = field.scores(features)
    for r in range(3):
        at = np.flatnonzero(row == r)
        best = max(itertools.product(range(5), repeat=len(at)), key=lambda p: sum(score[i, y] for i, y in zip(at, p, strict=True)) + sum(field.moves[x, y] for x, y in itertools.pairwise(p)))
        assert got[at].tolist() == list(best)


def test_field_keeps_features_that_share_a_slot():
    first = np.uint64(5) << np.uint64(64 - toxicity.Field.SLOT_BITS)
    marks = np.sort(np.append(first + np.arange(1, 4, dtype=np.uint64), np.random.default_rng(0).integers(1, 2**64, 100_000, dtype=np.uint64)))
    marks = np.unique(marks)
    field = toxicity.Field(marks)
    assert (field.known(marks) == np.arange(len(marks))).all()
    assert (field.known(np.array([0, first + np.uint64(9)], np.uint64)) == len(marks)).all()
    assert (toxicity.Field(marks[:0]).known(marks[:3]) == 0).all()
