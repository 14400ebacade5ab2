"""The operators of this subpackage applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, warc
from .chaining import shared_passages
from .decontaminate import contaminated
from .licenses import scan_licenses
from .mixing import sample_sources
from .near_dedup import near_duplicates
from .packing import assign_shards
from .quality import divergence_scores
from .token_codes import token_codes

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rule keeps, with their scores."""
    return divergence_scores(table(spark, sf_dir, "documents")).where("keep")


def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def op5_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_warc(table(spark, sf_dir, "pages"))


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_sources(table(spark, sf_dir, "documents"))


def op7_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths; a document's is source/lang/shelf/doc_id.txt, with 16 ids in a row to a shelf."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 16), F.concat("doc_id", F.lit(".txt")))))


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_codes, op2_chat_formatting, op3_divergence_rules, op4_collinear_chaining, op5_warc_reader, op6_cube_mixing, op7_positional_decontamination, op8_license_scan, op9_tensored_minhash, op10_best_fit_shards)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.CHAT_SQL, "op5_warc_reader": warc.WARC_SQL}
