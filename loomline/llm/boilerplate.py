"""Main text of web pages by two-pass block rules: stop-word density, length and link density, then the nearest decided neighbours."""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomline.llm.common import fresh, table

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for on was with as be by this are an from or have not at which but were they had his her their you we he she will would there been has can all one more when who if
    de la le les et des en un une du que qui dans est pour pas sur au par il ne se avec plus ce sont mais ou son cette nous vous aux
    der die das und den von zu mit sich ist nicht auch ein eine auf für dem im des es werden als wird bei nach sie wie oder aus dass hat
    el los las y del se por con una su para como al lo más pero sus este ya esta entre cuando muy sin sobre también fue hasta hay
    """.split()
)
#: Elements whose content is no text of the page, and elements and roles that hold no main text.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"])
HIDDEN = frozenset(["head", "template", "svg", "canvas", "object", "audio", "video", "select", "datalist", "map"])
ASIDE = frozenset(["nav", "footer", "aside", "menu", "dialog", "button", "fieldset", "search"])
ASIDE_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"])
MAIN, MAIN_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
#: Words of a class or id that name such a part; those of an article (what layouts say of an article names its neighbours); words that deny the rest of a class.
ASIDE_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners popup popups modal overlay cookie cookies consent gdpr notice notices alert alerts
    comment comments commentlist disqus respond reply replies nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets header masthead footer footers
    copyright related recommended recommendations share sharing social newsletter subscribe subscription signup login search toolbar skip
    """.split()
)
ASIDE_ARTICLES = frozenset("ad ads advert advertisement sponsored promo promotion comment comments respond reply replies related recommended".split())
DENIALS = frozenset(["has", "no", "with", "without", "not"])
#: Elements that break a line, and those that stand alone.
BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav
    ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What the start of an element ends, up to the element that bounds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_MARK = re.compile(r"""<(?:!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?P<close>>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass. Lengths are in characters of a block, densities are shares of its characters (links) or words (stop words)."""

    short: int = 70
    long: int = 200
    links: float = 0.5
    stop_low: float = 0.08
    stop_high: float = 0.16


@dataclass
class Block:
    """Text of a block, characters of it in links, and where it stands."""

    text: str
    linked: int
    aside: bool
    main: int  # number of the main element around it, 0 outside
    heading: bool
    listed: bool


class _Open:
    """Open elements. What they say is counted, so neither a text nor an end tag costs a walk over all that is open."""

    def __init__(self):
        self.stack: list[tuple[str, str | None]] = []
        self.names: Counter = Counter()
        self.inside: Counter = Counter()
        self.mains: list[tuple[int, int]] = []  # number, forms around it
        self.headings = self.seen = 0

    def push(self, name: str, what: str | None) -> None:
        self.stack.append((name, what))
        self.names[name] += 1
        self.inside[what] += 1
        self.headings += name in HEADINGS
        if what == "main":
            self.seen += 1
            self.mains.append((self.seen, self.inside["form"]))

    def pop(self) -> str:
        name, what = self.stack.pop()
        self.names[name] -= 1
        self.inside[what] -= 1
        self.headings -= name in HEADINGS
        if what == "main":
            self.mains.pop()
        return name

    def end(self, name: str) -> None:
        while self.names[name] and self.pop() != name:
            pass

    def imply(self, name: str) -> None:
        """Ends what the start of an element ends by itself."""
        while self.stack and self.stack[-1][0] == "p" and name in BLOCKS:
            self.pop()
        ends, bounds = CLOSES.get(name, (None, None))
        if ends and any(self.names[x] for x in ends):
            for at in range(len(self.stack) - 1, max(-1, len(self.stack) - 64), -1):
                if self.stack[at][0] in bounds:
                    return
                if self.stack[at][0] in ends:
                    while len(self.stack) > at:
                        self.pop()
                    return

    def aside(self) -> bool:
        """Whether text here is no main text: in an aside; in a form inside the main element or of a page without one around the form; in a header, but for headings of a main element."""
        _, forms = self.mains[-1] if self.mains else (0, 0)
        return bool(self.inside["aside"] or self.inside["form"] > forms or (self.inside["header"] and not (self.mains and self.headings)))


def _what(name: str, attrs: str) -> str | None:
    """`hidden`, `aside`, `form`, `header`, `main` or nothing, by element, role, class and id."""
    if name in HIDDEN:
        return "hidden"
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
    role = found.get("role", "").strip().lower()
    if name not in ("body", "html", "main"):
        named = set()
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = _NAME_WORDS.findall(_CAMEL.sub(" ", token).lower())
            if not DENIALS.intersection(words):
                named.update(words)
        if named & (ASIDE_ARTICLES if name == "article" else ASIDE_NAMES):
            return "header" if named & ASIDE_NAMES <= {"header", "masthead"} else "aside"
    if name in MAIN or role in MAIN_ROLES:
        return "main"
    if name in ASIDE or role in ASIDE_ROLES:
        return "aside"
    return name if name in ("form", "header") else None


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page in order. One walk over its marks; broken and unclosed marks end where browsers end them, and a text is read once however deep it lies."""
    out: list[Block] = []
    opened, link = _Open(), False
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, len(" ".join("".join(linked).split())), opened.aside(), opened.mains[-1][0] if opened.mains else 0, opened.headings > 0, opened.names["li"] > 0))
            parts, linked = [], []

    def take(text: str) -> None:
        if text and not opened.inside["hidden"]:
            text = _html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked.append(text)

    at, end = 0, len(page)
    while at < end:
        found = _MARK.search(page, at)
        if found is None:
            take(page[at:])
            break
        take(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None or not found["close"]:
            continue
        name, closing = name.lower(), bool(found["end"])
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in BLOCKS:
            flush()
        if name == "br":
            take(" ")
        elif name == "a":
            link = not closing
        elif closing:
            opened.end(name)
        elif name not in VOID:
            opened.imply(name)
            what = _what(name, found["attrs"])
            if name in BLOCKS or what:
                opened.push(name, what)
    flush()
    return out


def classify(found: list[Block], rules: Rules = Rules(), stop_words: frozenset[str] = STOP_WORDS) -> list[str]:  # noqa: B008
    """First pass: `good`, `bad`, or in doubt (`near` for a block of middling density, `short` for one too short to tell).

    Blocks of menus, notices, forms and the like are bad, as are blocks of links. In a main element, nothing else is bad by density alone:
    what is not good is in doubt. Without a main element, long text of few stop words is bad, unless the page has hardly any stop words in its long blocks, whose language
    the list then does not hold: there length alone tells.
    """
    counts = [(len(words), sum(w.strip(".,;:!?()\"'«»¿¡").lower() in stop_words for w in words)) for words in (b.text.split() for b in found)]
    told = [(n, s) for b, (n, s) in zip(found, counts, strict=True) if not b.aside and len(b.text) > rules.short]
    known = sum(s for _, s in told) >= rules.stop_low * sum(n for n, _ in told) / 2
    labels = []
    for b, (n, s) in zip(found, counts, strict=True):
        size, density, links = len(b.text), s / n, b.linked / len(b.text)
        if b.aside:
            labels.append(BAD)
        elif links > rules.links:
            labels.append(BAD if b.listed or not b.main else SHORT)
        elif size < rules.short:
            labels.append(SHORT)
        elif density >= rules.stop_high or not known:
            labels.append(GOOD if size >= rules.long or b.main else NEAR)
        elif density >= rules.stop_low:
            labels.append(NEAR)
        else:
            labels.append(NEAR if b.main else BAD)
    return labels


def settle(found: list[Block], labels: list[str]) -> list[bool]:
    """Second pass: whether each block is main text.

    A block in doubt takes the label of its nearest decided neighbours. In a main element only its own blocks count and the element's edge
    counts as good, so that it keeps all but what is bad in itself. Elsewhere both nearest must be good (the page's edge is bad), or one good for a `near` block; of two that differ, a short one takes the
    bad one's, but a heading takes the label of what follows. A page with a main element has its text there alone.
    """
    if any(b.main and label != BAD for b, label in zip(found, labels, strict=True)):
        return [bool(b.main) and label != BAD for b, label in zip(found, labels, strict=True)]
    decided = [i for i, label in enumerate(labels) if label in (GOOD, BAD)]
    out = []
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        k = bisect_left(decided, i)
        before = k > 0 and labels[decided[k - 1]] == GOOD
        after = k < len(decided) and labels[decided[k]] == GOOD
        out.append(after if b.heading else (before or after) if label == NEAR else before and after)
    if not any(out) and not decided:  # nothing tells: a page of short blocks alone is its text
        return [True] * len(found)
    return out


def main_text(page: str | None, rules: Rules = Rules(), stop_words: frozenset[str] = STOP_WORDS) -> str:  # noqa: B008
    found = blocks(page) if page else []
    keep = settle(found, classify(found, rules, stop_words))
    return "\n\n".join(b.text for b, good in zip(found, keep, strict=True) if good)


def extract(pages: DataFrame, rules: Rules = Rules(), stop_words: frozenset[str] = STOP_WORDS, html_col: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:  # noqa: B008
    """pages with their main text and its number of code points, under `names`; columns of those names are replaced.

    A null or empty page, and one without main text, has the empty text. Whole pages count, however long; a page is one string in a task. Repeated rows are extracted each;
    ties between neighbours go as settle() states. An empty table gives an empty result. Other columns pass through. No shuffle.
    """
    text, n_chars = names
    rest = pages.drop(text, n_chars)
    schema = T.StructType([*rest.schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), rules, stop_words) for page in batch.column(batch.schema.get_field_index(html_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, text, n_chars])

    return rest.mapInArrow(run, schema)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    names = fresh(pages.select("page_id", "url", "html"), "text", "n_chars")
    return extract(pages.select("page_id", "url", "html"), names=tuple(names)).drop("html")


#: The given pages hold their main text in one article element without nested parts, so SQL can cut it out; the marks and references inside it are of a few kinds.
OP12_SQL = r"""
WITH article AS (
  SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>') AS cut FROM pages
), pieces AS (
  SELECT page_id, url, unnest(cut) AS piece, unnest(range(len(cut))) AS place FROM article
), plain AS (
  SELECT page_id, url, place, trim(regexp_replace(regexp_replace(regexp_replace(piece, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS piece FROM pieces
), joined AS (
  SELECT page_id, url, coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY place) FILTER (piece <> ''), '') AS text FROM plain GROUP BY page_id, url
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""
