"""Topics: clusters of embeddings with an outlier class, their words and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import among


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assign_topics(docs: DataFrame, vector: str = "embedding", k: int = 10, outlier: float = 0.95, seed: int = 7) -> DataFrame:
    """docs with topic and topic_probability. The share 1 - outlier that lies furthest from its centre is topic -1; probability is 1 / (1 + distance)."""
    data = docs.withColumn("v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="topic").fit(data)
    spark = docs.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, centre array<double>")
    placed = model.transform(data).join(F.broadcast(centres) if k <= 10_000 else centres, "topic").withColumn("distance", F.sqrt(squared_distance(vector_to_array("v"), F.col("centre"))))
    cut = placed.approxQuantile("distance", [outlier], 0.001)
    far = F.col("distance") > (cut[0] if cut else 0.0)
    return placed.withColumns({"topic": F.when(far, -1).otherwise(F.col("topic")), "topic_probability": 1 / (1 + F.col("distance"))}).drop("v", "centre", "distance")


#: Words that say little in posts on generated images, besides the language's own stop words.
WEAK_WORDS = tuple(sorted(
    "actually ai api attention automatic1111 better character checkpoint ckpt comfyui cuda dalle dont even feel get good human diffusers epoch error im image images just know layer like loss make midjourney "
    "mj model models movie movies need new openai param people post prompt prompts really resnets rtx sd sdxl see seen setup thing think time tokenizer torch train training transformer use used using want weight yaml".split()
))


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Runs of two or more word characters of the lower-cased text, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(words, lambda w: ~among(w, list(stopwords))) if stopwords else words


def vocabulary(docs: DataFrame, text_col: str = "clean_text", min_df: int = 2, stopwords: Sequence[str] = ()) -> DataFrame:
    """(word, df): words of at least min_df documents, and of how many."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col), stopwords))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def word_counts(docs: DataFrame, id_col: str, text_col: str = "clean_text", min_df: int = 2, stopwords: Sequence[str] = ()) -> DataFrame:
    """(id, word, n): the document-term matrix as its non-zero cells, over the vocabulary."""
    cells = docs.select(id_col, F.explode(tokens(F.col(text_col), stopwords)).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    return cells.join(cells.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).select("word"), "word", "left_semi").select(id_col, "word", "n")


def topic_words(docs: DataFrame, text_col: str = "clean_text", n: int = 10, min_df: int = 2, stopwords: Sequence[str] = ()) -> DataFrame:
    """(topic, word, score, rank): class-based TF-IDF over words of at least min_df documents."""
    # Counted within the document first, so a word travels once a document.
    cells = docs.select("topic", F.explode(F.map_entries(_counts(tokens(F.col(text_col), stopwords)))).alias("e"))
    tf = cells.groupBy("topic", F.col("e.key").alias("word")).agg(F.sum("e.value").alias("tf"), F.count("*").alias("df"))
    # Over the word's window the texts are read for it once; and the mean asks for both columns, so that it shares the exchange of tf.
    per_word = Window.partitionBy("word")
    frequent = tf.withColumns({"f": F.sum("tf").over(per_word), "d": F.sum("df").over(per_word)}).where(F.col("d") >= min_df)
    mean = tf.groupBy("topic").agg(F.sum("tf").alias("t"), F.sum("df").alias("d")).where("d > 0").agg(F.avg("t").alias("a"))
    scored = frequent.crossJoin(F.broadcast(mean)).withColumn("score", F.col("tf") * F.log1p(F.col("a") / F.col("f")))
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("topic", "word", "score", "rank")


def _counts(words: Column) -> Column:
    """How often each item occurs, from the sorted array: its runs' lengths."""

    def of(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(places), lambda b: F.map_from_arrays(F.transform(b, lambda i: F.get(s, i)), F.transform(b, lambda i, j: (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("long"))))

    counted = F.get(F.get(F.transform(F.array(F.sort_array(words)), of), F.lit(0)), F.lit(0))
    return F.when(F.size(words) > 0, counted)


def topic_info(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(topic, count, avg_probability, representative_words)."""
    names = words.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("representative_words"))
    return docs.groupBy("topic").agg(F.count("*").alias("count"), F.avg("topic_probability").alias("avg_probability")).join(names, "topic", "left")


def attach(docs: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """A left join; repeated keys of the metadata repeat rows."""
    return docs.join(metadata, key, "left")


def word_pairs(words: DataFrame) -> DataFrame:
    """(topic, a, b): all pairs of a topic's words."""
    listed = words.where("topic is not null").groupBy("topic").agg(F.collect_list("word").alias("b"))  # not joined with itself, so words are worked out once
    return listed.select("topic", F.explode("b").alias("a"), "b").select("topic", "a", F.explode("b").alias("b")).where("a < b")
