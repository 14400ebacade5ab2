"""List, JSON and date values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _items(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def parse_list(text: Column) -> Column:
    """A list from "[...]" with quoted or bare items, or from comma-separated text; blank, nan, none and null are empty."""
    s = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_replace(s, r"^\[|\]$", "")
    quoted = F.regexp_extract_all(inner, F.lit(r"""'([^']*)'|"([^"]*)"|([^,\s'"][^,'"]*)"""), F.lit(0))
    listed = _items(F.transform(quoted, lambda x: F.regexp_replace(F.trim(x), r"""^['"]|['"]$""", "")))
    none = F.array().cast("array<string>")
    return F.when((s == "") | F.lower(s).isin("nan", "none", "null"), none).when(s.rlike(r"(?s)^\[.*\]$"), listed).otherwise(_items(F.split(s, r",\s*")))


def join_list(items: Column) -> Column:
    return F.array_join(items, ", ")


def or_empty(items: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(items, F.array().cast(kind))


def length(items: Column) -> Column:
    """0 for null."""
    return F.coalesce(F.size(or_empty(items)), F.lit(0))


def primary(items: Column) -> Column:
    """The first item, or null."""
    return F.try_element_at(items, F.lit(1))


def parse_scores(json: Column) -> Column:
    """[["label", 0.5], ...] as an array of (label, score)."""
    pairs = F.from_json(json, "array<array<string>>")
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("label"), F.get(p, F.lit(1)).cast("double").alias("score")))


def by_score(scores: Column) -> Column:
    """(label, score) structs, highest score first; of equals the first label."""
    return F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))


def above(scores: Column, least: float = 0.4) -> Column:
    return F.filter(scores, lambda s: s["score"] > least)


def flatten_lists(lists: Column) -> Column:
    return F.flatten(F.coalesce(lists, F.array().cast("array<array<string>>")))


def timestamp(text: Column, epoch: Column) -> Column:
    """From a written date or, failing that, epoch seconds; null if neither can be read."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(epoch.try_cast("double")))


def month(ts: Column) -> Column:
    return F.date_format(F.date_trunc("month", ts), "yyyy-MM")
