"""Phrase mining, main text of pages, whitening: against brute force, and on odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import boilerplate, phrases, whitening
from loomline.llm.boilerplate import blocks, main_text


def mined(rows, support, longest=5, inside=100, top=2000):
    """Plain counting of all phrases."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    known = {k: v for k, v in f.items() if v >= support}
    gone = {(lang, w[i:j]) for (lang, w), v in known.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * v >= inside * f[lang, w[i:j]]}
    out = {}
    for (lang, w), a in known.items():
        if len(w) > 1 and (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def phrase_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    words = ["the", "Of", "é", "ab", "ABC", "x" * 70, "x" * 70 + "y", "q,", "r.", "s!\n", "\tt", "u  v", "'w'"]
    return [(" ".join(words[k] for k in rng.zipf(1.6, rng.integers(0, 40)) % len(words)), [None, "en", "und", "fr"][int(rng.integers(0, 4))]) for _ in range(n)]


@pytest.mark.parametrize(("support", "inside", "top"), [(5, 100, 2000), (3, 60, 7), (40, 100, 2000)])
def test_phrases_equal_plain_counting(spark, monkeypatch, support, inside, top):
    monkeypatch.setattr(phrases, "SLICE", 64)  # rows in overlapping parts, too
    rows = phrase_rows(support)
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), support, inside=inside, top=top)
    assert sorted(map(tuple, got.collect())) == mined(rows, support, inside=inside, top=top)


def test_parts_lose_no_phrase():
    data = np.frombuffer(("one two three. four " * 50 + "x" * 300 + " five six").encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = next(phrases.parts(data, offsets, most=1 << 20))
    for most in (1, 7, 50, 333):
        ends = [(w.start[i], w.end[i + 1]) for w in phrases.parts(data, offsets, most=most) for i in range(len(w.start) - 1) if w.follows[i] and i + 2 > w.seen]
        assert ends == [(whole.start[i], whole.end[i + 1]) for i in range(len(whole.start) - 1) if whole.follows[i]]


def test_phrases_odd(spark, odd_documents, no_documents):
    got = phrases.collocations(odd_documents, 2)
    want = mined([(r["text"], r["lang"]) for r in odd_documents.collect()], 2)
    assert sorted(map(tuple, got.collect())) == want and any(r[0] == "fr" and r[2] == "same words here" for r in want)
    assert phrases.collocations(no_documents).count() == 0 and phrases.collocations(odd_documents.filter("doc_id < 4")).count() == 0


def test_a_full_filter_costs_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    rows = phrase_rows(9)
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), 2)
    assert sorted(map(tuple, got.collect())) == mined(rows, 2)


def test_scores_pass_64_bits(spark, monkeypatch):
    counts = spark.createDataFrame([("en", "", 10**15), ("en", "a b", 10**14), ("en", "a", 3 * 10**14), ("en", "b", 10**14 + 7)], "lang string, phrase string, n long")
    monkeypatch.setattr(phrases, "count_exactly", lambda *_: counts)
    monkeypatch.setattr(phrases, "mine_shards", lambda *_: [])
    got = phrases.collocations(spark.createDataFrame([("x", "en")], "text string, lang string")).collect()
    assert [r["score"] for r in got] == [1000 * 10**14 * 10**15 // (3 * 10**14 * (10**14 + 7))]


LONG = "It is the case that the text of this page was here, and it is not one of the short ones at all. " * 3


def test_main_text_of_layouts():
    article = f"<article class='post with-sidebar'><header><h1>Title &amp; more</h1><p>by me</p></header><p>Short.<p>{LONG}<a href=x>a link</a> &lt;b&gt;</p><aside>{LONG}</aside><ul><li>one<li>two</ul><script>if (a<b) '</p>'</script><!-- > --><form>{LONG}</form></article>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body class=page><header>Site {LONG}</header><nav><a href=1>x</a></nav><div class='cookie-notice'>{LONG}</div><main>{article}</main><section id=comments><article><p>{LONG}</p></article></section><footer>f</footer>"
    want = ["Title & more", "Short.", " ".join((LONG + "a link <b>").split()), "one", "two"]
    assert main_text(page).split("\n\n") == want
    assert main_text(f"<form id=all>{page}</form>").split("\n\n") == want


def test_main_text_by_density():
    links = "<div><a href=1>Home of all</a> <a href=2>The news</a></div>"
    page = f"<body>{links}<div>Some site</div><h2>Heading of it</h2><div>{LONG}</div><div>Short one.</div><div>{LONG}</div>{links}<div>(c) 2020</div>"
    assert main_text(page).split("\n\n") == ["Heading of it", LONG.strip(), "Short one.", LONG.strip()]
    foreign = " ".join(f"zork{i} blim{i}" for i in range(40))
    assert main_text(f"{links}<p>{foreign}<p>{foreign}") == f"{foreign}\n\n{foreign}"


@pytest.mark.parametrize("page", ["", "<<<>", "<p", "<!--", "<script>x", "</div></p>x", "<a 'x>y", "<p title='it>x", "<a href=1><br>x"])
def test_broken_pages_give_a_text(page):
    assert isinstance(main_text(page), str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "a b", "&amp;", "&#228", "<", ">", "<br>", "<!-- c", "-->", "<article>", "</article>", "\n"]), max_size=40))
def test_blocks_hold_every_text_once(marks):
    page = "".join(marks)
    found = [b.text for b in blocks(page)]
    assert all(t == " ".join(t.split()) and t for t in found)
    if "<!--" not in page and "<" not in [m for m in marks if len(m) == 1]:
        assert sum(t.count("a b") for t in found) >= page.count("a b") - page.count("a ba b")


def test_extract_odd(spark):
    rows = [(1, None), (2, ""), (3, f"<p>{LONG}"), (3, f"<p>{LONG}"), (None, "<article>é😀</article>"), (5, "<p>w " * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS url")
    got = boilerplate.extract(frame).collect()
    assert len(got) == 6 and [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (1, 2)] == [("", 0)] * 2
    assert [r["text"] for r in got if r["page_id"] == 3] == [LONG.strip()] * 2 and [(r["text"], r["n_chars"]) for r in got if r["page_id"] is None] == [("é😀", 2)]
    assert boilerplate.extract(frame.limit(0)).count() == 0


def whitened(vectors, k=4):
    """Plain numpy on the whole covariance."""
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(e), e / (y * y).sum() * n


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")


def agrees(got, ids, vectors, k=4):
    n, deviation, y, explained = whitened(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(ids) * k
    for j in range(k):
        mine = np.array([by[i, j + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - y[:, j]).max(), np.abs(mine + y[:, j]).max()) < 1e-8
        assert all(abs(by[i, j + 1]["explained"] - explained[j]) < 1e-10 and by[i, j + 1]["n"] == n and by[i, j + 1]["identity_error"] < 1e-9 for i in ids)
    assert [by[i, 1]["deviation"] for i in ids] == deviation.tolist()


@pytest.mark.parametrize("dims", [5, 16, 40])
def test_whitening_equals_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((400, dims)) * np.linspace(2, 0.5, dims) + 3).astype(np.float32).tolist()
    vectors += vectors[:100] * 2 + [vectors[0]] * 200
    got = whitening.whiten(frame_of(spark, list(enumerate(vectors))).repartition(3)).collect()
    agrees(got, range(len(vectors)), vectors)


def test_whitening_odd(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((30, 3)).astype(np.float32).tolist()
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (104, []), (105, [1.0, 2.0])]
    frame = frame_of(spark, [*enumerate(good), *bad]).selectExpr("*", "1 AS x", "2 AS n", "3 AS component")
    got = whitening.whiten(frame).collect()
    agrees(got, range(30), good, 3)
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame_of(spark, bad[:5])).count() == 0
    same = whitening.whiten(frame_of(spark, [(1, [1.0, -0.5]), (None, [1.0, -0.5])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(1, 0, None, None)] * 4
    flat = whitening.whiten(frame_of(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in flat) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    huge = whitening.whiten(frame_of(spark, [(1, [1e38, 0.0]), (2, [-1e38, 1.0])])).collect()
    assert {r["deviation"] for r in huge} == {None} and all(np.isfinite(r["whitened"]) for r in huge if r["component"] == 1)


def test_whitening_certifies_near_ties(spark):
    rng = np.random.default_rng(2)
    x = np.linalg.qr(rng.standard_normal((300, 30)))[0] * np.array([40.0, 39.999, 20, 19.99, *np.linspace(19, 1, 26)])
    fit = spark.createDataFrame([([int(v) for v in r],) for r in np.unique(np.floor(x * 4096).astype(int), axis=0)], "x array<long>")
    space = whitening.fit_components(fit, whitening._sums(fit, 30))
    assert (space.residuals <= 1e-13 * space.values[0]).all() and np.allclose(space.vectors.T @ space.vectors, np.eye(4), atol=1e-12)


@pytest.mark.parametrize("least", [0.95, 0.99, 0.997, 0.999])
def test_links_of_any_threshold_equal_all_pairs(spark, least):
    """A crowd as wide as the limit angle or wider, where balls must follow the threshold."""
    from loomline.llm import embeddings

    rng = np.random.default_rng(int(1000 * least))
    centre = rng.standard_normal((3, 16))
    x = np.concatenate([c / np.linalg.norm(c) + rng.standard_normal((120, 16)) * w for c, w in zip(centre, (0.004, 0.012, 0.03), strict=True)]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= least
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").coalesce(1), least).collect()}
    want = linked.sum(1) - 1
    assert abs(sum(got.values()) - want.sum()) <= 0.01 * want.sum() and all(got[i] <= want[i] for i in got)


@pytest.fixture(scope="module")
def shape_field():
    from loomline.llm import pii

    return {part: pii.fit_field(*pii.written_windows(part)) for part in (None, -1, -2, -3, -4)}


def test_all_words_are_decoded_as_in_whole_chains(shape_field):
    """Words left out are those that no field gives a kind: by a trained field and by random ones."""
    import pyarrow as pa

    from loomline.llm import pii
    from loomline.llm.textscan import Words, as_bytes

    rng = np.random.default_rng(0)
    words = ["plain", "a@b.c", "12", "(at)", "[x]", "+49", "Upper", "x_y", "4111", "é", "1.2.3.4", "www.a-b.c"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(0, 60)))) for _ in range(200)] + ["", "plain " * 6000 + "call 030 1234567"]
    data, offsets = as_bytes(pa.array(texts))
    found = Words(data, offsets, 0, len(texts), marks=False)
    features = pii.shape_features(data, found)
    fields = [shape_field[None]]
    for scale in (0.3, 1.0, 4.0):
        field = pii.ShapeField()
        field.w = rng.normal(size=field.w.shape).astype(np.float32) * scale
        field.w[:, 0] += scale
        field.moves = rng.normal(size=field.moves.shape).astype(np.float32)
        fields.append(field)
    for field in fields:
        assert (field.decode_all(features, found.row) == field.decode(features, found.row)).all()


def test_written_forms_are_found_on_held_out_rows(shape_field):
    import pyarrow as pa

    from loomline.llm import pii

    hit = total = 0
    for part in range(4):
        texts, spans = pii.written_rows(part)
        for (_, every), want in zip(pii.tag(shape_field[-part - 1], pa.array(texts)), spans, strict=True):
            total += len(want)
            hit += sum(any(a < b and e > x and k == kind for a, k, e in every) for x, kind, b in want)
    assert hit >= 0.8 * total
    texts, spans = pii.made_rows(400, 99)
    found = [any(a < b and e > x and k == kind for a, k, e in every) for (_, every), [(x, kind, b)] in zip(pii.tag(shape_field[None], pa.array(texts)), spans, strict=True)]
    assert sum(found) >= 0.85 * len(found)


def test_plain_texts_get_no_added_span(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from loomline.llm import pii

    path = "/root/testdata/sf0.01/documents.parquet"
    field = pii.train(spark.read.parquet(path))
    added = [s for base, every in pii.tag(field, pq.read_table(path).column("text").combine_chunks()) for s in set(every) - set(base)]
    assert len(added) <= 4


def test_boilerplate_texts_do_not_meet_in_pairs(spark):
    """50,000 texts of one template with too much of their own in one bucket: only those with room for a link meet others."""
    from loomline.llm import neardup

    row = F.col("id")
    members = spark.range(50_000).select(
        F.lit(1).cast("long").alias("bucket"), row.alias("rep"), F.lit(110).cast("long").alias("n"), F.when(row == 7, 0).otherwise(18).cast("long").alias("u"),
        row.alias("class"), F.lit(0).cast("long").alias("class_p"), F.lit(None).cast("long").alias("with_p"), F.array(F.lit(1).cast("long")).alias("buckets"),
    )
    assert neardup._met(members.filter("rep <> 7"), 80).count() == 0
    with_one = neardup._met(members, 80)
    room = lambda n, u: 20 * n - 180 * u
    assert room(110, 0) + room(110, 18) >= 0 > 2 * room(110, 18) and with_one.count() == 50_000 + 49_998  # 7 with all, and all outside the pivot's class but 7 with 7


def test_templates_with_own_words_are_told_apart(spark):
    """Classes of template texts, some linked and some not, by comparison of all pairs."""
    from loomline.llm import neardup

    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join(base[:60] + [f"o{i}x{j}" for j in range(14)] + base[60:]) for i in range(120)]
    texts += [" ".join(base[:60] + [f"p{i}"] + base[60:]) for i in range(6)] + [" ".join(base)] + [t + " z" for t in texts[:10]]
    texts += [" ".join(rng.permutation(base)) for _ in range(5)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    for percent in (80, 85):
        least = list(range(len(texts)))
        for _ in range(4):
            for a in range(len(texts)):
                for b in range(a):
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        least[a] = least[b] = min(least[a], least[b])
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent).collect()} == dict(enumerate(least))
