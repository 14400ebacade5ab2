"""The two filtering stages: keyword matching with group policies, and the strict recheck."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lists import or_empty
from ..functions.literals import among
from ..operators import match, policy, summary
from ..operators.lexicon import sized

FROM, TO = 1640995200, 1735689599  # 2022 to 2024, both ends included


def clean_posts(raw: DataFrame) -> DataFrame:
    """raw(id, subreddit, title, selftext, created_utc): dated, non-empty posts with their cleaned texts."""
    whole = T.full_text(F.col("title"), F.col("selftext"))
    posts = raw.where(F.col("created_utc").between(FROM, TO) & (T.has_content(F.col("title")) | T.has_content(F.col("selftext"))))
    return posts.withColumn("full_text", whole).withColumns({"clean_text": T.clean_text(F.col("full_text")), "clean_text_lc": T.clean_text_lower(F.col("full_text"))})


def with_groups(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(subreddit, group): a dimension table, joined without regard to case."""
    g = sized(groups.select(F.lower("subreddit").alias("sub_lc"), F.col("group").alias("subreddit_group")))
    return posts.join(g, F.lower(posts.subreddit) == g.sub_lc, "left").drop("sub_lc")


KEYS = ["id", "subreddit", "subreddit_group"]
TEXTS = ["clean_text", "clean_text_lc", "full_text"]


def filtered_posts(raw: DataFrame, groups: DataFrame, lexicon: DataFrame, ai_keywords: DataFrame, group_match: str = "exact") -> DataFrame:
    """Posts with a keyword between white space and an AI keyword, kept by their group's policy; lists are sorted, equal posts appear once.

    Lists are made inside the row. Only rows that are kept are shuffled, to find equal ones, by a 128-bit hash
    of their texts; the texts go along only if they are asked for.
    """
    pairs, forms = match.small_lexicon(lexicon), match.known_forms(ai_keywords)
    posts = clean_posts(raw)
    if pairs is None or forms is None:
        return _filtered_by_join(posts, groups, lexicon, ai_keywords, group_match)
    words = sorted({k for _, k in pairs})
    none = F.array().cast("array<string>")

    def lists(hits: Column) -> Column:
        own = F.filter(hits, lambda h: among(h, words)) if words else none
        types = F.flatten(F.transform(own, lambda h: F.try_element_at(match.category_map(pairs), h))) if words else none
        return F.struct(F.sort_array(F.array_distinct(types)).alias("matched_bias_types"), F.sort_array(own).alias("matched_keywords"), F.exists(hits, lambda h: among(h, forms)).alias("ai") if forms else F.lit(False).alias("ai"))

    # inline keeps the lists from being worked out again in each filter over them.
    hits = F.transform(F.array(match.spaced_hits(F.col("clean_text_lc"), {*words, *forms})), lists)
    found = posts.select("id", "subreddit", *TEXTS, F.inline(hits)).where(F.col("ai") & (F.size("matched_keywords") > 0))
    found = with_groups(found, groups)
    kept = found.where(policy.keep_matched(F.col("subreddit"), F.col("subreddit_group"), F.size("matched_bias_types"), F.size("matched_keywords"), group_match))
    same = [F.xxhash64(F.lit(i), *TEXTS).alias(f"_h{i}") for i in range(2)]
    once = kept.select("*", *same).groupBy(*KEYS, "_h0", "_h1").agg(*(F.first(c).alias(c) for c in (*TEXTS, "matched_bias_types", "matched_keywords")))
    return once.select(*KEYS, *TEXTS, "matched_bias_types", "matched_keywords")


def _filtered_by_join(posts: DataFrame, groups: DataFrame, lexicon: DataFrame, ai_keywords: DataFrame, group_match: str) -> DataFrame:
    """The same for lexicons too large for literals."""
    hits = match.match_keywords(with_groups(match.with_any_keyword(posts, ai_keywords), groups), lexicon)
    found = hits.groupBy(*KEYS, *TEXTS).agg(F.sort_array(F.collect_set("category")).alias("matched_bias_types"), F.sort_array(F.collect_set("keyword")).alias("matched_keywords"))
    return found.where(policy.keep_matched(F.col("subreddit"), F.col("subreddit_group"), F.size("matched_bias_types"), F.size("matched_keywords"), group_match))


def strict_posts(posts: DataFrame, lexicon: dict[str, list[str]], ai_keywords: list[str], order: str | None = None) -> DataFrame:
    """The strict recheck. lexicon {category: keywords}; order: a column that tells rows of one id apart, the last of which stays."""
    low = F.lower(F.coalesce("clean_text_lc", F.lit("")))
    hits = F.array(match.strict_hits(low, lexicon, ai_keywords))
    found = posts.where(policy.valid_id(F.col("id"))).select("*", F.inline(hits).alias("re_types", "re_words", "re_ai"))
    kept = found.where(policy.keep_strict(F.col("subreddit"), F.col("subreddit_group"), F.size("re_words") > 0, F.size("re_ai") > 0))
    if order:
        kept = summary.keep_last(kept, "id", order)
    prior_types, prior_words = or_empty(F.col("matched_bias_types")), or_empty(F.col("matched_keywords"))
    return kept.select(
        F.col("id").cast("string").alias("id"), "subreddit", F.lower("subreddit_group").alias("subreddit_group"), F.coalesce("clean_text", F.lit("")).alias("clean_text"), F.coalesce("clean_text_lc", F.lit("")).alias("clean_text_lc"),
        F.array_sort(F.array_distinct(F.when(F.size("re_types") > 0, F.col("re_types")).otherwise(prior_types))).alias("matched_bias_types"),
        F.array_sort(F.array_distinct(F.concat("re_words", "re_ai", prior_words))).alias("matched_keywords"),
    )


CLEAN = {c: "string" for c in ("id", "subreddit", "title", "selftext")} | {"comments": "array<string>", "top_comments": "array<string>", "full_text": "string", "clean_text": "string", "score": "int", "num_comments": "int", "upvote_ratio": "double", "flair": "string", "created_utc": "double"}


def with_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Just these columns in this order; those that df lacks are nulls of the given type."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()))


def clean_dataset(posts: DataFrame, stopwords: Iterable[str] = (), most_comments: int = 10) -> DataFrame:
    """Crawled posts with content in title or body, their texts normalized, in the thirteen columns of CLEAN."""
    stop = tuple(stopwords)
    kept = posts.where(T.has_content_strict(F.col("title")) | T.has_content_strict(F.col("selftext")))
    kept = kept.withColumn("full_text", T.full_text(F.col("title"), F.col("selftext")))
    comments = F.col("comments") if "comments" in posts.columns else F.lit(None).cast("array<string>")
    kept = kept.withColumns({"clean_text": T.normalized_words(F.col("full_text"), stop), "top_comments": T.clean_comments(comments, most_comments, stop)})
    return with_columns(kept, CLEAN)
