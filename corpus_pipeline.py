"""From raw documents to token codes: five stages, each on all that the one before kept.

Ids may be of any type that can be ordered. Columns beyond doc_id, text, lang and source go along up to the last
stage, whatever they are named. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontaminate import without_contaminated
from textloom.llm.mixing import mixed
from textloom.llm.near_dedup import without_near_duplicates
from textloom.llm.quality import keep_by_divergence
from textloom.llm.queries import PATTERN, RANKS, table
from textloom.llm.token_codes import token_codes
from textloom.llm.work import Work


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms are near their language's. Null, empty and short texts stay; a null language is one of its own; repeated rows fare alike."""
    return keep_by_divergence(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, repeated rows included: that of least id, then least text. Rows of null id, and of null or empty text, stay."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows of null id, and of null or empty text, stay; an empty benchmark takes nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, evened out over sources; a null source is one of its own, and the rows of null id of a source go or stay together."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as directly addressable codes, a row a row; a null text has null codes."""
    return token_codes(docs, RANKS, PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back by the next."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
