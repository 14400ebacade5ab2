"""Text cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"http[^\t\n\f\r ]+|www\.[^\t\n\f\r ]+"
TAG = r"<[^\n]*?>"
SYMBOL = r"[^a-z0-9\t\n\f\r :\-/_%\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{200D}\x{FE0F}]"
EMPTY_WORDS = ("[deleted]", "[removed]", "", "null", "none")


def replace_first(text: Column, pattern: str, by: str = "") -> Column:
    """Only the first match replaced; `by` is literal text without $ or backslash."""
    return F.regexp_replace(text, rf"^((?s:.*?))(?:{pattern})", "$1" + by)


def full_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def clean_text(text: Column) -> Column:
    """Without the first URL and then the first tag; later ones stay."""
    return replace_first(replace_first(text, URL), TAG)


def clean_text_lower(text: Column) -> Column:
    """Lower case, without the first URL and tag, the first foreign symbol a space."""
    return replace_first(replace_first(replace_first(F.lower(text), URL), TAG), SYMBOL, " ")


def has_content(text: Column) -> Column:
    """Not null, blank-free comparison: surrounding spaces count as content."""
    return ~F.lower(F.coalesce(text, F.lit(""))).isin(*EMPTY_WORDS)


def has_content_strict(text: Column) -> Column:
    """As has_content, but white space around the text doesn't count."""
    return ~F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")).isin(*EMPTY_WORDS)


def normalized_words(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Lower-case letters only, every URL and tag gone, stop words dropped, single spaces."""
    t = F.lower(text)
    for pattern in (r"http\S+|www\.\S+", r"<[^\n]*?>", r"[^a-z\s]"):
        t = F.regexp_replace(t, pattern, "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    stop = list(stopwords)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return F.array_join(words, " ")


def basic_clean(text: Column) -> Column:
    """URLs become [URL], &amp; an ampersand, deletion marks go, white space is squeezed; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"http\S+", "[URL]")
    t = F.regexp_replace(F.replace(t, F.lit("&amp;"), F.lit("&")), r"\[deleted\]|\[removed\]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_comments(comments: Column, n: int = 10, stopwords: Iterable[str] = ()) -> Column:
    """The first n comments, normalized; null becomes an empty list."""
    stop = tuple(stopwords)
    return F.transform(F.slice(F.coalesce(comments, F.array().cast("array<string>")), 1, n), lambda c: normalized_words(c, stop))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def shorten(text: Column, most: int = 140) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def escape_pattern(keyword: Column) -> Column:
    """A keyword as a pattern that matches it literally."""
    return F.regexp_replace(keyword, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether any term occurs in the lower-cased text, at word bounds or not."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for term in terms:
        found = found | low.contains(term.lower())
    return found


def render_prompt(template: str, text: Column, slot: str = "{{ post_text }}") -> Column:
    """The template with its slot filled by the trimmed text."""
    return F.replace(F.lit(template), F.lit(slot), F.trim(F.coalesce(text, F.lit(""))))
