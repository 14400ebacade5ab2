"""Paged crawls of new posts through a function that fetches one page; a source a task."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summary import keep_first

Page = tuple[list[dict], str | None]
#: What a post has if the page lacks it; id has no default.
DEFAULTS = {"title": "", "selftext": "", "created_utc": 0, "score": 0, "num_comments": 0, "upvote_ratio": 0}


def pages(fetch: Callable[[str | None, int], Page], most: int, size: int = 100, tries: int = 3, wait: float = 10.0, busy: type[Exception] = ConnectionError, whole_pages: bool = False) -> list[dict]:
    """At most `most` posts, newest first, following cursors; a busy server is tried again.

    whole_pages: every page is asked for in full and kept, so the last may run past `most`.
    """
    out: list[dict] = []
    cursor: str | None = None
    while len(out) < most:
        for left in range(tries - 1, -1, -1):
            try:
                got, cursor = fetch(cursor, size if whole_pages else min(size, most - len(out)))
                break
            except busy:
                if not left:
                    raise
                time.sleep(wait)
        out += got
        if not got or cursor is None:
            break
    return out if whole_pages else out[:most]


def listing(document: dict) -> Page:
    """The posts and the cursor of a listing, as `new.json` gives it."""
    data = document["data"]
    return [child["data"] for child in data["children"]], data.get("after") or None


def checked(post: dict, fields: Iterable[str]) -> dict:
    """Just the fields of a post, all of which it must have."""
    return {f: post[f] for f in fields}


def completed(post: dict, name: str) -> dict:
    """A post with what it lacks filled in; without an id it is an error."""
    return {"id": post["id"], **{f: post.get(f, v) for f, v in DEFAULTS.items()}, "subreddit": post.get("subreddit", name)}


def crawl(spark: SparkSession, names: Iterable[str], fetch_of: Callable[[str], Callable[[str | None, int], Page]], most: int, schema: str, out: str, whole_pages: bool = False, **paging) -> tuple[DataFrame, DataFrame]:
    """Posts of all names, the first of each id; and (source, error) of the names that failed.

    Each name is fetched in a task and lands in a folder of its own under out, which is read back, so nothing is
    fetched twice by later reads. One name's failure doesn't end the crawl; what it had fetched isn't kept.
    """
    names = sorted(set(names))

    def fetched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["source"]:
                try:
                    posts = pages(fetch_of(name), most, whole_pages=whole_pages, **paging)
                    rows = [(name, i, json.dumps(p), None) for i, p in enumerate(posts)]
                except Exception as e:
                    rows = [(name, -1, None, str(e))]
                yield pd.DataFrame(rows, columns=["source", "ordinal", "post", "error"]).astype({"ordinal": "int64"})

    asked = spark.createDataFrame([(n,) for n in names], "source string").repartitionByRange(max(1, len(names)), "source")
    asked.mapInPandas(fetched, "source string, ordinal long, post string, error string").write.partitionBy("source").parquet(out)
    got = spark.read.schema("ordinal long, post string, error string, source string").parquet(out)
    posts = got.where("error is null").select("source", "ordinal", F.from_json("post", schema).alias("p")).select(F.struct("source", "ordinal").alias("ordinal"), "p.*")
    return keep_first(posts, "id", "ordinal").drop("ordinal"), got.where("error is not null").select("source", "error")
