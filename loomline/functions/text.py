"""Column expressions on text: words, tokens, clocks, names, addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that file names may not hold, and patterns of titles and clocks.
ILLEGAL_IN_NAMES = r'[<>:"/\\|?*\x00-\x1f]'
TITLE_NUMBER = r"Podcast #(\d+)"
TITLE_GUEST = r"Transcript for\s+(.+?):"
CLOCK_IN_TEXT = r"\((\d{2}):(\d{2}):(\d{2})\)"
SECONDS_IN_LINK = r"[?&;]t=(\d+)"


def normalize_whitespace(text: Column) -> Column:
    """Runs of any white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def tokenize(text: Column) -> Column:
    """Lower-case terms of letters, digits and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"))


def seconds_to_clock(seconds: Column) -> Column:
    """HH:MM:SS; hours may have more digits."""
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def clock_to_seconds(clock: Column) -> Column:
    """Seconds of HH:MM:SS; null for anything that is not three numbers."""
    parts = F.split(clock, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return F.when(F.size(parts) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def parse_timestamp(text: Column, href: Column) -> Column:
    """The clock in brackets in a text, else the seconds in a link, else null."""
    found = F.regexp_extract(text, CLOCK_IN_TEXT, 0)
    clock = F.when(found != "", F.substring(found, 2, 8))
    linked = F.regexp_extract(href, SECONDS_IN_LINK, 1).try_cast("long")
    return F.coalesce(clock, F.when(linked.isNotNull(), seconds_to_clock(linked)))


def safe_filename(text: Column) -> Column:
    """Characters that file names may not hold become `-`; trimmed, without dots at the end; `unknown` if nothing is left."""
    name = F.regexp_replace(text, ILLEGAL_IN_NAMES, "-")
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"\.+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def candidate_urls(url: Column, site: str = "https://example.com") -> Column:
    """Addresses to try in order: the page of the first path part with `-transcript`, then the plain one; the address itself if there is no path."""
    slug = F.element_at(F.split(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+", ""), "/"), 1)
    base = F.concat(F.lit(site + "/"), slug)
    plain = F.concat(base, F.lit("/"))
    return F.when(slug == "", F.array(url)).when(slug.endswith("-transcript"), F.array(plain)).otherwise(F.array(F.concat(base, F.lit("-transcript/")), plain))


def title_episode(title: Column) -> Column:
    return F.regexp_extract(title, TITLE_NUMBER, 1).try_cast("int")


def title_guest(title: Column) -> Column:
    guest = F.trim(F.regexp_extract(title, TITLE_GUEST, 1))
    return F.when(guest != "", guest)


def route_provider(asked: Column, model: Column, default: str = "openai") -> Column:
    """The provider asked for, else the one that the model's name tells, else the default."""
    named = F.when(F.lower(model).contains("deepseek"), "deepseek").otherwise(default)
    return F.coalesce(F.when(asked != "", asked), named)
