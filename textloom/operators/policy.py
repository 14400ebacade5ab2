"""Which posts a group keeps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = "twoxchromosomes"
OPEN_GROUPS = ("technical", "creative_ai_communities", "critical_discussion")


def keep_matched(subreddit: Column, group: Column, n_types: Column, n_keywords: Column, group_match: str = "exact") -> Column:
    """After keyword matching: open groups need a type, general and the special community two keywords. group_match "ci" ignores case."""
    g = F.lower(group) if group_match == "ci" else group
    return F.when(F.lower(subreddit) == SPECIAL, n_keywords >= 2).when(g.isin(*OPEN_GROUPS), n_types > 0).when(g == "general_reddit", n_keywords >= 2).otherwise(F.lit(False))


def keep_strict(subreddit: Column, group: Column, has_bias: Column, has_ai: Column) -> Column:
    """After strict matching; groups are compared in lower case, and a missing one keeps nothing."""
    g = F.lower(F.coalesce(group, F.lit("unknown")))
    return F.when(g.isin("technical", "creative_ai_communities"), has_bias).when(g == "critical_discussion", F.when(F.lower(subreddit) == SPECIAL, has_bias & has_ai).otherwise(has_bias)).when(g == "general_reddit", has_bias & has_ai).otherwise(F.lit(False))


def valid_id(c: Column) -> Column:
    """Not null, empty or nan."""
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin("", "nan")
