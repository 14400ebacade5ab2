"""Batch scoring by models that the caller supplies, in Arrow batches on the executors."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import parse_output

log = logging.getLogger(__name__)


LOAD_FAILED = "Model load failed"


def _answers(model: Callable, texts: list[str]) -> list:
    """The model's answers; one for each text, or a ValueError."""
    got = list(model(texts))
    if len(got) != len(texts):
        raise ValueError(f"{len(got)} answers to {len(texts)} texts")
    return got


def classify(posts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], text_col: str = "clean_text", batch: int = 16) -> DataFrame:
    """posts with raw_output, pred_label and llm_reasoning.

    load makes the model once a task. If it fails, every row is "no"; if a batch fails, or gets too few or too
    many answers, that batch's rows are. Their raw_output is empty, the reasoning says what happened, and no
    error text is ever read as a model's answer. A blank answer counts as [EMPTY_OUTPUT].
    """

    @F.arrow_udf("raw string, why string")
    def generate(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = None
        try:
            model = load()
        except Exception:
            log.exception("no model")
        for texts in parts:
            raw: list[str] = []
            why: list[str | None] = []
            for at in range(0, len(texts), batch):  # no more texts at once are made Python's
                if model is None:
                    raw, why = [""] * len(texts), [LOAD_FAILED] * len(texts)
                    break
                some = ["" if t is None else t for t in texts.slice(at, batch).to_pylist()]
                try:
                    raw += [str(x).strip() or "[EMPTY_OUTPUT]" if x is not None else "[EMPTY_OUTPUT]" for x in _answers(model, some)]
                    why += [None] * len(some)
                except Exception as e:
                    raw += [""] * len(some)
                    why += [f"Postprocessing failed: {e}"] * len(some)
            yield pa.StructArray.from_arrays([pa.array(raw, pa.string()), pa.array(why, pa.string())], names=["raw", "why"])

    made, parsed = fresh_name(posts, "made"), fresh_name(posts, "parsed")
    scored = posts.withColumn(made, generate(F.col(text_col)))
    read = scored.withColumn(parsed, F.when(F.col(made)["why"].isNull(), parse_output(F.col(made)["raw"])))
    out = {"raw_output": F.col(made)["raw"], "pred_label": F.coalesce(F.col(parsed)["label"], F.lit("no")), "llm_reasoning": F.coalesce(F.col(made)["why"], F.col(parsed)["reasoning"])}
    return read.withColumns(out).drop(made, parsed)


def fresh_name(df: DataFrame, stem: str) -> str:
    while stem in df.columns:
        stem += "_"
    return stem


def classify_one(spark: SparkSession, text: str, load: Callable, subreddit: str = "unknown", post_id: str = "unknown") -> dict:
    """One post by the same contract, as a dict."""
    one = spark.createDataFrame([(post_id, subreddit, text)], "id string, subreddit string, clean_text string")
    return classify(one, load).first().asDict()


def emotions(text: Column, load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], batch: int = 32) -> Column:
    """All (label, score) of each text, highest first; a blank text has none, and one whose batch failed is null."""

    @F.arrow_udf("array<struct<label:string,score:double>>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

        def scored(some: list[str]) -> list:
            try:
                return [sorted(({"label": a, "score": float(b)} for a, b in x), key=lambda d: (-d["score"], d["label"])) for x in _answers(model, some)]
            except Exception:
                log.exception("a batch failed")
                return [None] * len(some)

        for texts in parts:
            out: list = [[] for _ in range(len(texts))]
            held: list[tuple[int, str]] = []  # texts that aren't blank, up to a batch

            def flush() -> None:
                for (i, _), x in zip(held, scored([t for _, t in held]), strict=True):
                    out[i] = x
                held.clear()

            for i, text in enumerate(texts):
                t = text.as_py()
                if t is not None and t.strip():
                    held.append((i, t))
                    if len(held) == batch:
                        flush()
            if held:
                flush()
            yield pa.array(out, kind)

    return score(text)


def comment_emotions(df: DataFrame, id_col: str, comments: str, load: Callable, batch: int = 32) -> DataFrame:
    """(id, scores): for each comment in its order its emotions; blank comments have none."""
    one = df.select(id_col, F.posexplode_outer(comments).alias("at", "comment"))
    return one.withColumn("e", emotions(F.col("comment"), load, batch)).groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "e")))), lambda s: s["e"]).alias("scores"))


def split_labels(df: DataFrame, label: str = "pred_label") -> tuple[DataFrame, DataFrame]:
    """(yes, no)."""
    return df.where(F.col(label) == "yes"), df.where(F.col(label) == "no")


def label_distribution(df: DataFrame, label: str = "pred_label") -> DataFrame:
    from .summary import share_of_total

    return share_of_total(df.groupBy(label).agg(F.count("*").alias("cnt")))


def _parted(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(F.coalesce(ok, F.lit(False))), df.where(~F.coalesce(ok, F.lit(False)))


def valid_classifications(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): a record needs id, subreddit, text and a label of yes or no."""
    return _parted(df, F.col("id").isNotNull() & F.col("subreddit").isNotNull() & F.col("clean_text").isNotNull() & F.col("pred_label").isin("yes", "no"))


def valid_filtered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) after the strict stage: a record needs id, subreddit, both texts and both lists; the group may be null."""
    ok = F.lit(True)
    for c in ("id", "subreddit", "clean_text", "clean_text_lc", "matched_bias_types", "matched_keywords"):
        ok = ok & F.col(c).isNotNull()
    return _parted(df, ok)


def non_blank(df: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """Rows whose text has something but white space."""
    return df.where(F.col(text_col).rlike(r"\S"))


def suggested_batch(free_gb: float, per_item_gb: float = 0.5, most: int = 32) -> int:
    """A power of two that fits the memory."""
    n = 1
    while n * 2 <= most and n * 2 * per_item_gb <= free_gb:
        n *= 2
    return n
