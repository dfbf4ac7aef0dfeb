"""From raw pages to dialogue: which pages to take, and their chapters, segments, guests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import normalize_whitespace, parse_timestamp, title_episode, title_guest
from loomline.operators.membership import absent

#: Marks of transcript pages.
SEGMENT_CLASS, NAME_CLASS, TIME_CLASS, TEXT_CLASS, TITLE_CLASS = "ts-segment", "ts-name", "ts-timestamp", "ts-text", "entry-title"
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


def is_transcript_page(html: Column, mark: str = SEGMENT_CLASS) -> Column:
    """Whether a page carries the mark of dialogue; false for null."""
    return F.coalesce(html.contains(mark), F.lit(False))


def page_info(pages: DataFrame, title: Column) -> DataFrame:
    """pages with title, episode, guest by a title column; null where the title does not tell."""
    clean = normalize_whitespace(title)
    return pages.withColumns({"title": clean, "episode": title_episode(clean), "guest": title_guest(clean)})


def drop_known_episodes(pages: DataFrame, known: DataFrame, order: list[str], known_filter: DataFrame | None = None) -> DataFrame:
    """Pages whose episode is not stored yet, one page per episode (the first by `order`); pages without a number all pass. known_filter: a key_filter of the stored episodes."""
    fresh = absent(pages, known, ["episode"], known_filter)
    first = F.row_number().over(Window.partitionBy("episode").orderBy(*order)) == 1
    numbered = fresh.filter("episode is not null").withColumn("_first", first).filter("_first").drop("_first")
    return numbered.unionByName(fresh.filter("episode is null"))


class _Walker(HTMLParser):
    """Chapter headings and segments of a page in document order. Open tags and what they are get counted, so a text costs no walk over all that is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # tag, what it is
        self.tags: Counter = Counter()
        self.inside: Counter = Counter()
        self.nodes: list[dict] = []
        self.segments: list[dict] = []  # open segments
        self.titles: list[list[str]] = []
        self.heading: dict | None = None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        classes = (at.get("class") or "").split()
        what = None
        if tag == "h2" and (at.get("id") or "").lower().startswith("chapter") and (at.get("id") or "")[7:].partition("_")[0].isdigit() and "_" in at["id"]:
            self.heading = {"kind": "chapter", "id": at["id"], "text": []}
            self.nodes.append(self.heading)
            what = "heading"
        elif tag == "h1" and TITLE_CLASS in (at.get("class") or ""):
            self.titles.append([])
            what = "title"
        elif tag == "div" and SEGMENT_CLASS in classes:
            segment = {"kind": "segment", "name": None, "time": None, "text": None, "href": None, "at": len(self.nodes)}
            self.segments.append(segment)
            self.nodes.append(segment)
            what = "segment"
        elif tag == "span" and self.segments:
            for name, mark in (("name", NAME_CLASS), ("time", TIME_CLASS), ("text", TEXT_CLASS)):
                if mark in classes and self.segments[-1][name] is None:
                    self.segments[-1][name] = []
                    what = name
        elif tag == "a" and self.segments and self.segments[-1]["href"] is None and self.inside["time"]:
            self.segments[-1]["href"] = at.get("href") or ""
        if tag not in _VOID:
            self.open.append((tag, what))
            self.tags[tag] += 1
            self.inside[what] += 1

    def handle_endtag(self, tag):
        while self.tags[tag]:
            t, what = self.open.pop()
            self.tags[t] -= 1
            self.inside[what] -= 1
            if what == "heading":
                self.heading = None
            elif what == "segment":
                self.segments.pop()
            if t == tag:
                return

    def handle_data(self, data):
        if self.heading is not None:
            self.heading["text"].append(data)
        if self.inside["title"]:
            self.titles[-1].append(data)
        if self.segments:
            for name in ("name", "time", "text"):
                if self.inside[name]:
                    self.segments[-1][name].append(data)


def _flat(parts: list[str] | None) -> str:
    return " ".join("".join(parts).split()) if parts else ""


def walk_page(html: str) -> list[tuple]:
    """(node_pos, kind, chapter_id, speaker, time_text, href, text) of one page: `title`, `chapter` and `segment` nodes."""
    walker = _Walker()
    walker.feed(html)
    walker.close()
    rows = [(-1, "title", None, None, None, None, _flat(t)) for t in walker.titles[-1:]]
    for place, node in enumerate(walker.nodes):
        if node["kind"] == "chapter":
            rows.append((place, "chapter", node["id"], None, None, None, _flat(node["text"])))
        elif node["text"] is not None:
            rows.append((place, "segment", None, _flat(node["name"]) or "Unknown", _flat(node["time"]), node["href"] or "", _flat(node["text"])))
    return rows


def parse_segments(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node_pos, kind, chapter_id, speaker, timestamp, text: a row per title, chapter heading and segment.

    The page is walked in Arrow batches by a small parser. A page that cannot be parsed gives one row of kind `reject`, never a failed task.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "node_pos", "kind", "chapter_id", "speaker", "time_text", "href", "text"]
        for batch in batches:
            rows = []
            for page, html in zip(batch[key], batch["html"], strict=True):
                try:
                    rows += [(page, *r) for r in walk_page(html or "")]
                except Exception as error:  # noqa: BLE001  any malformed page
                    rows.append((page, -2, "reject", None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=names)

    schema = f"{key} {kind}, node_pos long, kind string, chapter_id string, speaker string, time_text string, href string, text string"
    nodes = pages.select(key, "html").mapInPandas(run, schema)
    return nodes.select(key, "node_pos", "kind", "chapter_id", "speaker", parse_timestamp(F.col("time_text"), F.col("href")).alias("timestamp"), "text")


def page_segments(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node_pos, chapter_index, chapter, speaker, timestamp, text: segments with their chapters from one walk of the page, equal to assign_chapters(parse_segments(pages)) without its window and its shuffle by page.

    The walk meets headings and segments in order, so it knows the chapter at hand (0 and null before any heading). A page that cannot be parsed gives no segments; parse_segments() has it as a reject.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "node_pos", "chapter_index", "chapter", "speaker", "time_text", "href", "text"]
        for batch in batches:
            rows = []
            for page, html in zip(batch[key], batch["html"], strict=True):
                try:
                    nodes = walk_page(html or "")
                except Exception:  # noqa: BLE001  any malformed page
                    continue
                number, title = 0, None
                for place, what, _, speaker, time_text, href, text in nodes:
                    if what == "chapter":
                        number, title = number + 1, text
                    elif what == "segment":
                        rows.append((page, place, number, title, speaker, time_text, href, text))
            yield pd.DataFrame(rows, columns=names)

    schema = f"{key} {kind}, node_pos long, chapter_index long, chapter string, speaker string, time_text string, href string, text string"
    found = pages.select(key, "html").mapInPandas(run, schema)
    return found.select(key, "node_pos", "chapter_index", "chapter", "speaker", parse_timestamp(F.col("time_text"), F.col("href")).alias("timestamp"), "text")


def assign_chapters(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Segments with chapter_index (0: before any heading) and chapter title of the latest heading before them."""
    so_far = Window.partitionBy(key).orderBy("node_pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("kind") == "chapter", F.col("text"))
    placed = nodes.filter("kind in ('chapter', 'segment')").withColumn("chapter", F.last(heading, ignorenulls=True).over(so_far))
    placed = placed.withColumn("chapter_index", F.count(heading).over(so_far))
    return placed.filter("kind = 'segment'").drop("kind", "chapter_id")


def detect_guest(segments: DataFrame, host: str, fallback: DataFrame | None = None, key: str = "episode") -> DataFrame:
    """key, guest: the most frequent speaker that is not the host; ties go to the one who speaks first; else the title's guest."""
    spoken = segments.filter((F.col("speaker") != host) & (F.col("speaker") != "")).groupBy(key, "speaker").agg(F.count("*").alias("n"), F.min(F.struct("chapter_index", "pos")).alias("first"))
    best = spoken.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "speaker")).alias("b")).select(key, F.col("b.speaker").alias("guest"))
    episodes = segments.select(key).distinct()
    if fallback is None:
        return episodes.join(best, key, "left")
    titled = fallback.select(key, F.col("guest").alias("titled"))
    return episodes.join(best, key, "left").join(titled, key, "left").select(key, F.coalesce("guest", "titled").alias("guest"))


def nest_episodes(chapters: DataFrame, segments: DataFrame, guests: DataFrame) -> DataFrame:
    """episode, guest, chapters: segments under their chapters in order; empty chapters stay, segments before any heading come last as `Unknown`."""
    row = F.struct("pos", F.struct("speaker", "timestamp", "text").alias("s"))
    by_chapter = segments.groupBy("episode", "chapter_index").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    heads = chapters.select("episode", "chapter_index", "chapter")
    headless = by_chapter.filter("chapter_index = 0").select("episode", F.lit(1 << 30).alias("at"), F.lit("Unknown").alias("title"), "rows")
    headed = heads.join(by_chapter, ["episode", "chapter_index"], "left").select("episode", F.col("chapter_index").alias("at"), F.col("chapter").alias("title"), "rows")
    whole = headed.union(headless)
    listed = F.transform(F.coalesce("rows", F.array().cast("array<struct<pos:bigint,s:struct<speaker:string,timestamp:string,text:string>>>")), lambda r: r["s"])
    nested = whole.select("episode", F.struct("at", F.struct("title", listed.alias("segments")).alias("c")).alias("c"))
    nested = nested.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["c"]).alias("chapters"))
    return nested.join(guests, "episode", "left").select("episode", "guest", "chapters")


def episode_summary(episodes: DataFrame) -> DataFrame:
    """episode, guest, n_chapters (empty ones count), n_segments."""
    total = F.aggregate("chapters", F.lit(0), lambda s, c: s + F.size(c["segments"]))
    return episodes.select("episode", "guest", F.size("chapters").cast("long").alias("n_chapters"), total.cast("long").alias("n_segments"))
