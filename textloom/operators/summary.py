"""Counts, shares, rankings and examples over matched posts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from .lexicon import sized


def rows_per(df: DataFrame, key: str) -> DataFrame:
    """(key, rows); a null key is counted."""
    return df.groupBy(key).agg(F.count("*").alias("rows"))


def counts_of_items(df: DataFrame, key: str, items: str, name: str) -> DataFrame:
    """(key, name, cnt) over an array column; blank items and null keys are left out."""
    return df.select(key, F.explode(items).alias(name)).where(f"trim({name}) != '' and `{key}` is not null").groupBy(key, name).agg(F.count("*").alias("cnt"))


def top_items(df: DataFrame, items: str, name: str, n: int) -> DataFrame:
    """The n commonest items of an array column; of equals the first by name."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), name).limit(n)


def top_keywords_with_category(df: DataFrame, lexicon: DataFrame, n: int = 20) -> DataFrame:
    """Keyword counts after a join with the raw lexicon: its repeats multiply the counts."""
    used = df.select(F.explode("matched_keywords").alias("kw"))
    j = used.join(sized(lexicon), F.lower("kw") == F.lower("keyword"))
    return j.groupBy("category", "keyword").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "category", "keyword").limit(n)


def ranked(df: DataFrame, key: str, by: str, name: str, k: int) -> DataFrame:
    """The k rows of each key with the highest `by`; of equals the first by name."""
    w = Window.partitionBy(key).orderBy(F.desc(by), name)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def monthly(df: DataFrame, key: str, ts: Column) -> DataFrame:
    """(key, month, cnt); rows without a time are left out."""
    return df.select(key, F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month")).where(f"month is not null and `{key}` is not null").groupBy(key, "month").agg(F.count("*").alias("cnt"))


def examples(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each combination of keys in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)


def pivot_counts(counts: DataFrame, key: str, name: str, values: Sequence[str], cnt: str = "cnt") -> DataFrame:
    return counts.groupBy(key).pivot(name, list(values)).agg(F.sum(cnt)).na.fill(0)


def row_percent(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Each row in percent of its total; 0 where the total is."""
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return table.select(key, *(F.when(total > 0, F.col(f"`{v}`") * 100.0 / total).otherwise(0.0).alias(v) for v in values))


def concentration(counts: DataFrame, key: str, cnt: str = "cnt") -> DataFrame:
    """(key, hhi): the sum of squared shares."""
    total = F.sum(cnt).over(Window.partitionBy(key))
    return counts.withColumn("share", F.col(cnt) / total).groupBy(key).agg(F.sum(F.pow("share", F.lit(2))).alias("hhi"))


def share_of_total(counts: DataFrame, cnt: str = "cnt", digits: int = 2) -> DataFrame:
    """With the percent of the grand total, half to even. The total is joined as one row, not a window over everything."""
    total = counts.agg(F.sum(cnt).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share_pct", F.when(F.col("total") > 0, F.bround(F.col(cnt) * 100.0 / F.col("total"), digits)).otherwise(0.0)).drop("total")


def top_shares(counts: DataFrame, key: str, name: str, k: int = 5) -> DataFrame:
    """The k largest shares of each key in percent, to one digit; of equals the first by name."""
    total = F.sum("cnt").over(Window.partitionBy(key))
    return ranked(counts.withColumn("share", F.col("cnt") * 100.0 / total), key, "share", name, k).select(key, name, F.bround("share", 1).alias("share_pct"))


def filter_rate(kept: Column, total: Column) -> Column:
    return F.when(total > 0, kept * 100.0 / total).otherwise(0.0)


def spread(counts: DataFrame, key: str, cnt: str) -> DataFrame:
    """One row: number of keys, largest, smallest and mean count, and whose they are; a null key is "unknown"."""
    c = counts.withColumn(key, F.coalesce(key, F.lit("unknown")))
    top, low = F.max(F.struct(F.col(cnt), F.col(key))), F.min(F.struct(F.col(cnt), F.col(key)))
    return c.agg(F.count("*").alias("keys"), top[cnt].alias("most"), top[key].alias("most_key"), low[cnt].alias("least"), low[key].alias("least_key"), F.avg(cnt).alias("mean"))


def head(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a stated order: a top-n in each task, then of their results."""
    return df.orderBy(*order).limit(n)


def histogram(values: DataFrame, column: str, bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, cnt) of equal bins; the top edge belongs to the last."""
    b = F.least(F.floor((F.col(column) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("cnt"))


def keep_last(df: DataFrame, key: str, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Of each key the row that comes last in order, placed where the key first appears; of equals the first by ties, or any."""
    w = Window.partitionBy(key)
    turn = F.row_number().over(w.orderBy(F.desc(order), *ties))
    return df.withColumns({"first_at": F.min(order).over(w), "turn": turn}).where("turn = 1").drop("turn")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("turn = 1").drop("turn")


def lookup(table: DataFrame, keys: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The rows of table for the keys, in their order (key, at). A key that table lacks fails the query, or gives nulls if not strict."""
    if not strict:
        return keys.join(table, key, "left").orderBy("at")
    found = "_found"
    j = keys.join(table.withColumn(found, F.lit(True)), key, "left")
    # The error stands in a column that is used, so that no optimizer leaves it out.
    checked = F.when(F.col(found), F.col("at")).otherwise(F.raise_error(F.concat(F.lit("no such key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("long"))
    return j.withColumn("at", checked).drop(found).orderBy("at")


def with_concentration(table: DataFrame, counts: DataFrame, key: str, cnt: str = "cnt") -> DataFrame:
    """table with hhi of its key's counts; keys without counts get null."""
    return table.join(concentration(counts, key, cnt), key, "left")


def mapped(df: DataFrame, column: str, mapping: Mapping[str, str], name: str) -> DataFrame:
    """df with the value that mapping has for a column; null for what it lacks."""
    if not mapping:
        return df.withColumn(name, F.lit(None).cast("string"))
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return df.withColumn(name, F.try_element_at(table, F.col(column).cast("string")))


def lengths_by(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, docs, least, q1, median, q3, most): words of the texts by key, a null key left out; quartiles interpolated."""
    n = df.where(F.col(key).isNotNull()).select(key, word_count(F.col(text_col)).alias("n"))
    q = [F.percentile("n", F.lit(p)).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return n.groupBy(key).agg(F.count("*").alias("docs"), F.min("n").alias("least"), *q, F.max("n").alias("most"))


def confidence(values: DataFrame, probabilities: str, bins: int = 30) -> DataFrame:
    """(bin, cnt) of each row's highest probability."""
    return histogram(values.select(F.array_max(probabilities).alias("p")), "p", bins)


def top_comments(comments: Column, n: int = 5) -> Column:
    """Bodies of the n best scored of the root-level comments (body, score, is_root); of equals the earlier."""
    root = F.filter(comments, lambda c: c["is_root"])
    placed = F.transform(root, lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c["body"].alias("body")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda c: c["body"])


def first_bodies(comments: Column, n: int = 10) -> Column:
    return F.transform(F.slice(comments, 1, n), lambda c: c["body"])


def pairs(df: DataFrame, key: str, name: str) -> DataFrame:
    """(a, b, cnt): how often two items, a < b, share a key."""
    x, y = df.select(key, F.col(name).alias("a")), df.select(key, F.col(name).alias("b"))
    return x.join(y, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("cnt"))
