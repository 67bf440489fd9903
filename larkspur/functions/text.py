"""Text, link and host columns: Column in, Column out."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether text contains one of the phrases."""
    found = text.contains(phrases[0])
    for phrase in phrases[1:]:
        found = found | text.contains(phrase)
    return found


def any_match(text: Column, patterns: list[str], flags: str = "") -> Column:
    """Whether one of the patterns is found; one pass over the text."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities resolved, then Unicode form NFKC: neither is built in."""
    return text.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


def squeezed(text: Column) -> Column:
    """Without zero-width marks, white space runs as one space, trimmed.  Null: empty."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), fixed.ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """The full normal form; use squeezed() where inputs are known to be NFKC without entities."""
    return squeezed(unescaped(F.coalesce(text, F.lit(""))))


def joined_parts(*parts: Column) -> Column:
    """Parts that aren't empty, one a line."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def chat_label(title: Column, username: Column, full_name: Column, first_name: Column) -> Column:
    """The first name of a chat that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (title, username, full_name, first_name)))


def story_line(has_story: Column, source: Column) -> Column:
    """What stands for a forwarded story in a message's text, null without one."""
    line = F.lit("Forwarded Telegram story")
    return F.when(has_story, F.coalesce(F.concat(line, F.lit(" from "), F.nullif(source, F.lit(""))), line))


def text_hash(text: Column) -> Column:
    return F.sha2(F.lower(text), 256)


def excerpt(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last one then replaced by three dots; nothing: a dash."""
    return F.when(F.coalesce(text, F.lit("")) == "", "-").when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("...")))


def masked(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "not configured").when(F.length(text) <= 18, "***configured***").otherwise(F.concat(F.substring(text, 1, 10), F.lit("..."), F.substring(text, -6, 6)))


def deobfuscated(text: Column) -> Column:
    """Lower case, look-alike digits and signs as letters, everything else as single spaces."""
    clean = F.regexp_replace(F.lower(text), fixed.ZERO_WIDTH, "")
    return F.regexp_replace(F.translate(clean, fixed.LEET_FROM, fixed.LEET_TO), "[^a-z0-9+]+", " ")


def compacted(deobfuscated_text: Column) -> Column:
    return F.replace(deobfuscated_text, F.lit(" "), F.lit(""))


def first_of_each(values: Column) -> Column:
    """Without empty values and without repeats that differ in case only; the first of each stays, in order."""
    start = F.array().cast("array<string>")
    kept = lambda done, x: F.when((x == "") | F.exists(done, lambda y: F.lower(y) == F.lower(x)), done).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(values, start, kept)


def sliced(text: Column, offset: Column, length: Column, unit: str = "character") -> Column:
    """length units of text from offset on, counted from 0.

    unit: "character", whatever its plane, or "utf16", for which a character beyond the basic plane counts twice, as
    messaging services count.
    """
    if unit == "character":
        return F.substring(text, offset + 1, length)
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * offset + 1, 2 * length), "UTF-16BE")


def entity_urls(text: Column, entities: Column, unit: str = "character") -> Column:
    """URLs that entities, array<struct<type, offset, length, url>>, mark in a text or hide behind it; in their order."""
    of = lambda e: F.when(e["type"] == "url", sliced(text, F.coalesce(e["offset"], F.lit(0)), F.coalesce(e["length"], F.lit(0)), unit)).when(e["type"] == "text_link", e["url"])
    return F.array_compact(F.transform(F.coalesce(entities, F.array().cast("array<struct<type:string,offset:int,length:int,url:string>>")), of))


def urls(text: Column, marked: Column | None = None) -> Column:
    """URLs in text, then those that are marked (entity_urls), each once."""
    found = F.regexp_extract_all(text, F.lit("(?iU)" + fixed.URL), F.lit(1))
    found = F.transform(found, lambda u: F.regexp_replace(u, fixed.AFTER_LINK, ""))
    return first_of_each(F.transform(found if marked is None else F.concat(found, marked), lambda u: F.trim(u)))


def host(url: Column) -> Column:
    """Host in lower case without user, port, leading www. and last dots; null if there is none."""
    rest = F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(name), r"^www\.", ""), r"\.+$", ""), F.lit(""))


def hosts(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, host), lambda h: h.isNotNull()))


def is_chat_link(link: Column) -> Column:
    return F.lower(link).contains("t.me/") | F.lower(link).contains("telegram.me/")


def chat_links(text: Column, found: Column) -> Column:
    direct = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + fixed.CHAT_LINK), F.lit(1)), lambda u: F.regexp_replace(u, fixed.AFTER_LINK, ""))
    return first_of_each(F.concat(direct, F.filter(found, is_chat_link)))


def odd_characters(text: Column) -> Column:
    """Format, private-use and surrogate characters, and marks and symbols that aren't ASCII."""
    return F.regexp_count(text, F.lit(r"[\p{Cf}\p{Co}\p{Cs}]|(?=[^\x00-\x7F])[\p{M}\p{S}]"))


def zero_width_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(fixed.ZERO_WIDTH))


def without_secrets(fields: Column) -> Column:
    """A map without keys that name a token."""
    return F.map_filter(fields, lambda k, v: ~F.lower(k).contains("token"))


def search_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/?search="), F.url_encode(query))


def item_url(base: Column, slug: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/show/"), slug)


def display_title(title: Column, episode: Column, category: Column, year: Column) -> Column:
    series = (category != "movie") & (F.coalesce(episode, F.lit("")) != "")
    return F.when(series, F.concat(title, F.lit(" - "), episode)).when(year.isNotNull() & (year != 0), F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title)


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def clean_reply(reply: Column) -> Column:
    """Without code fences, trailing blanks and empty lines in a row; at most 1200 characters."""
    value = F.regexp_replace(F.regexp_replace(reply, r"(?U)^\s+|\s+$", ""), r"(?iU)^```(?:text)?\s*", "")
    value = F.regexp_replace(value, r"(?U)\s*```$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(value, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), 1, 1200)


def keeps_urls(reply: Column, required: Column) -> Column:
    """Whether a rewritten reply has just the required URLs."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(r"(?U)(https?://[^\s<>()]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"""[.,;:!?)"']+$""", "")))
    return (F.coalesce(reply, F.lit("")) != "") & (F.size(F.array_except(required, found)) == 0) & (F.size(F.array_except(found, required)) == 0)
