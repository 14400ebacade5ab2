"""Keyword matching inside the row: words are looked up in a set, instead of a regular expression per pair of text and keyword.

A text is cut into words once. Only where a word begins some keyword are runs of words put together and
looked up. What a row holds stays in the row: nothing is exploded, joined or shuffled to match.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import among, number_map, string_array, string_map
from .lexicon import SUFFIXES, normalized, sized, with_suffixes

MOST = 100_000  # keywords that are looked up as literals; a larger lexicon is joined
ALIKE = ("ſıςµϐϑϕϖϰϱϵ", "siσμβθφπκρε")  # lower-case letters that patterns without regard to case take for others


def _grams(n: int):
    def of(words: Column) -> Column:
        last = F.size(words) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return of


def spaced_grams(text: Column, most: int = 3) -> Column:
    """Distinct runs of 1 to `most` words between white space; words of a run stand in one line, one space apart."""
    lines = F.transform(F.split(text, r"[\t\n\f\r]"), lambda line: F.split(line, " "))
    per_size = [F.flatten(F.transform(lines, _grams(n))) for n in range(1, most + 1)]
    return F.array_distinct(F.filter(F.concat(*per_size), lambda g: g != ""))


def _found(parts: Column, forms: Mapping[str, Sequence[str]], joint: str) -> Column:
    """The forms, each given with its pieces, that stand in an array of pieces. Runs are put together only where their first piece is."""
    single = sorted(f for f, pieces in forms.items() if len(pieces) == 1)
    several = {f: pieces for f, pieces in forms.items() if len(pieces) > 1}
    found = [F.filter(parts, lambda p: among(p, single))] if single else []
    if several:
        starts, sizes, names = sorted({p[0] for p in several.values()}), sorted({len(p) for p in several.values()}), sorted(several)
        places = F.when(F.size(parts) > 1, F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: among(F.get(parts, i - 1), starts))).otherwise(F.array().cast("array<int>"))
        runs = F.flatten(F.transform(places, lambda i: F.array(*(F.array_join(F.slice(parts, i, n), joint) for n in sizes))))
        found.append(F.filter(runs, lambda r: among(r, names)))
    return F.concat(*found)


def spaced_hits(text: Column, keywords: Iterable[str]) -> Column:
    """The distinct keywords (of words one space apart) that stand in the text between white space; null text gives null."""
    forms = {k: k.split(" ") for k in sorted(set(keywords))}
    if not forms:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    lines = F.transform(F.split(text, r"[\t\n\f\r]"), lambda line: F.split(line, " "))
    return F.array_distinct(F.flatten(F.transform(lines, lambda words: _found(words, forms, " "))))


def longest(lexicon: DataFrame) -> int:
    """Words of the longest keyword. A lexicon is a small table."""
    return lexicon.agg(F.max(F.size(F.split("keyword", " ")))).first()[0] or 1


def small_lexicon(lexicon: DataFrame) -> list[tuple[str, str]] | None:
    """The distinct (category, keyword) of a lexicon of at most MOST, in order; None of a larger one."""
    rows = normalized(lexicon).where("keyword != ''").distinct().limit(MOST + 1).collect()
    return sorted((r.category, r.keyword) for r in rows) if len(rows) <= MOST else None


def category_map(pairs: Sequence[tuple[str, str]]) -> Column:
    """A literal map from keyword to its categories."""
    lists: dict[str, list[str]] = {}
    for category, keyword in pairs:
        lists.setdefault(keyword, []).append(category)
    return string_map(lists)


def match_keywords(posts: DataFrame, lexicon: DataFrame, text_col: str = "clean_text_lc", most: int | None = None) -> DataFrame:
    """posts joined with every (category, keyword) that stands in the text between white space; a row a pair."""
    pairs = small_lexicon(lexicon)
    if pairs is None:
        words = normalized(lexicon).where("keyword != ''").distinct()
        grams = posts.withColumn("gram", F.explode(spaced_grams(F.col(text_col), most or longest(words))))
        return grams.join(words, grams.gram == words.keyword).drop("gram")
    if not pairs:
        return posts.where("false").withColumns({"category": F.lit(""), "keyword": F.lit("")})
    hits = posts.withColumn("keyword", F.explode(spaced_hits(F.col(text_col), (k for _, k in pairs))))
    both = hits.withColumn("category", F.explode(F.try_element_at(category_map(pairs), F.col("keyword"))))
    return both.select(*posts.columns, "category", "keyword")


def match_keywords_by_pattern(posts: DataFrame, lexicon: DataFrame, text_col: str = "clean_text_lc") -> DataFrame:
    """The same rows by a regular expression for each pair: for tests, not for use."""
    words = normalized(lexicon).where("keyword != ''").distinct()
    on = F.expr(f"rlike(concat(' ', `{text_col}`, ' '), concat('(^|[\\\\t\\\\n\\\\f\\\\r ])\\\\Q', keyword, '\\\\E([\\\\t\\\\n\\\\f\\\\r ]|$)'))")
    return posts.join(sized(words), on)


def known_forms(keywords: DataFrame) -> list[str] | None:
    """The keywords with all known endings; None of more than MOST."""
    forms = with_suffixes(keywords.select(F.lower("keyword").alias("keyword")).where("keyword != ''")).select("form").distinct().limit(MOST + 1).collect()
    return sorted(r.form for r in forms) if len(forms) <= MOST else None


def with_any_keyword(posts: DataFrame, keywords: DataFrame, text_col: str = "clean_text_lc", most: int | None = None) -> DataFrame:
    """Posts with at least one keyword, or a keyword with one of the known endings, between white space."""
    forms = known_forms(keywords)
    if forms is None:
        many = with_suffixes(keywords.select(F.lower("keyword").alias("keyword")).where("keyword != ''")).select("form").distinct()
        row = posts.withColumn("_row", F.expr("uuid()"))
        grams = row.select("_row", F.explode(spaced_grams(F.col(text_col), most or longest(many.toDF("keyword")))).alias("gram"))
        return row.join(grams.join(many, grams.gram == many.form).select("_row").distinct(), "_row", "left_semi").drop("_row")
    return posts.where(F.size(spaced_hits(F.col(text_col), forms)) > 0)


def strict_pattern(keyword: str, exact: tuple = ("copilot", "dalle")) -> str:
    ending = "" if keyword in exact else "(?:al|ed|es|ical|s|y)?"
    return rf"(?iU)\b\Q{keyword}\E{ending}\b"


def _pieces(keyword: str) -> list[str]:
    """Runs of word characters and what is between them."""
    import regex

    return regex.findall(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]+|[^\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]+", keyword)


def _alike(text: str) -> str:
    return text.translate(str.maketrans(*ALIKE))


def strict_places(text: Column, keywords: Sequence[str], exact: Sequence[str] = ("copilot", "dalle")) -> Column:
    """The places in `keywords` (from 0, ascending) of those that stand in the lower-case text at word bounds, with or without a known ending.

    Keywords that begin and end with a word character are runs of the text's words and gaps, and are looked
    up; only the others need a pattern each.
    """
    forms: dict[str, list[int]] = {}
    plain, patterns = F.translate(text, *ALIKE), []
    for at, keyword in enumerate(keywords):
        low = keyword.lower()
        pieces = _pieces(low)
        if not pieces:
            continue
        if any(len(_pieces("a" + p)) > 1 for p in (pieces[0][0], pieces[-1][-1])):
            patterns.append(F.when(plain.contains(_alike(low)) & text.rlike(strict_pattern(low, exact)), F.lit(at)))
            continue
        for ending in SUFFIXES if low not in exact else ("",):
            forms.setdefault(_alike(low + ending), []).append(at)
    found = [F.filter(F.array(*patterns), lambda i: i.isNotNull())] if patterns else []
    if forms:
        table = number_map(forms)

        def hits(parts: Column) -> Column:
            return F.flatten(F.transform(F.array_distinct(_found(parts, {f: _pieces(f) for f in forms}, "")), lambda g: F.try_element_at(table, g)))

        # The pieces are made once: a lambda over an array of one item names them.
        parts = F.regexp_extract_all(plain, F.lit(r"(?U)\w+|\W+"), F.lit(0))
        found.append(F.flatten(F.transform(F.array(parts), hits)))
    if not found:
        return F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(*found)))


def strict_matches(text: Column, keywords: Sequence[str], exact: Sequence[str] = ("copilot", "dalle")) -> Column:
    """The keywords that stand in the text at word bounds, with or without a known ending, in the order given."""
    if not keywords:
        return F.array().cast("array<string>")
    names = string_array(keywords)
    return F.transform(strict_places(text, keywords, exact), lambda i: F.get(names, i))


def strict_categories(text: Column, lexicon: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """(categories, keywords) by strict matching of a lexicon {category: keywords}."""
    per = {c: strict_matches(text, list(words)) for c, words in lexicon.items()}
    none = F.array().cast("array<string>")
    types = F.filter(F.array(*(F.when(F.size(m) > 0, F.lit(c)) for c, m in per.items())), lambda c: c.isNotNull()) if per else none
    return types, reduce(lambda a, b: F.concat(a, b), per.values(), none)


def strict_hits(text: Column, lexicon: Mapping[str, Sequence[str]], more: Sequence[str]) -> Column:
    """struct(types, words, more) in one pass: categories and keywords of the lexicon, and which of the words in `more`, stand in the text."""
    owners = [*((k, c) for c, words in lexicon.items() for k in words), *((k, None) for k in more)]
    none = F.array().cast("array<string>")
    if not owners:
        return F.struct(none.alias("types"), none.alias("words"), none.alias("more"))
    names, kinds = string_array([k for k, _ in owners]), string_array([c for _, c in owners])
    cut = sum(c is not None for _, c in owners)

    def parts(places: Column) -> Column:
        mine, others = F.filter(places, lambda i: i < cut), F.filter(places, lambda i: i >= cut)
        word = lambda i: F.get(names, i)
        return F.struct(F.array_distinct(F.transform(mine, lambda i: F.get(kinds, i))).alias("types"), F.transform(mine, word).alias("words"), F.transform(others, word).alias("more"))

    return F.get(F.transform(F.array(strict_places(text, [k for k, _ in owners])), parts), F.lit(0))
