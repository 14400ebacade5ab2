"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller, and its own) neighbours are tied to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = both.join(least, "a")
    if large:
        out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, work: Work) -> DataFrame:
    """edges(a, b), both of one type that can be ordered, not null -> (node, component): the least node it is connected with.

    Only nodes of some edge with a != b appear; repeated and reversed edges count once; no edges, no rows.
    A logarithmic number of rounds, each written to the shared folder.
    """
    now = work.table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = [F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))]
    before = now.agg(*digest).first()
    while before[0]:
        then = now
        now = work.table(_star(_star(then, True), False), "edges")
        after = now.agg(*digest).first()
        work.drop(then)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
