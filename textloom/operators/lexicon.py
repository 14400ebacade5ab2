"""Keyword lexicons and group maps as small DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("", "al", "ed", "es", "ical", "s", "y")


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def from_mapping(spark: SparkSession, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """(category, keyword), trimmed, lower-case, blanks dropped, repeats kept."""
    rows = [(c, k) for c, words in lists.items() for k in words]
    raw = spark.createDataFrame(rows, "category string, keyword string")
    return raw.select(_norm(F.col("category")).alias("category"), _norm(F.col("keyword")).alias("keyword")).where("keyword != '' and category != ''")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] = ("category", "keyword")) -> DataFrame:
    """A dimension table; all columns are strings."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns))


def normalized(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(_norm(F.col("category")).alias("category"), _norm(F.col("keyword")).alias("keyword"))


def by_category(lexicon: DataFrame) -> DataFrame:
    """(category, keywords): distinct and sorted."""
    return normalized(lexicon).where("keyword != '' and category != ''").groupBy("category").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))


def with_suffixes(keywords: DataFrame, exact: Sequence[str] = ()) -> DataFrame:
    """(keyword, form): every keyword with the endings that still count as it; those in `exact` only as they are."""
    form = F.explode(F.array(*map(F.lit, SUFFIXES)))
    some = keywords.select("keyword", form.alias("ending"))
    if exact:
        some = some.where(~F.col("keyword").isin(*exact) | (F.col("ending") == ""))
    return some.select("keyword", F.concat("keyword", "ending").alias("form")).distinct()


def sized(dim: DataFrame, most: int = 100_000) -> DataFrame:
    """dim, to be broadcast if it has at most `most` rows; otherwise Spark chooses the join."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim
