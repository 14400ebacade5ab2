"""Tables that cut lineage. They live in the shared folder the cluster names, so a lost executor costs no data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return sc.getCheckpointDir().rstrip("/")


class Work:
    """A folder of intermediate Parquet tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        """df, written and read back; options are the writer's."""
        p = self.path(name)
        df.write.options(**options).parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._textloom_path = p
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._textloom_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column, as DDL."""
    return df.select(col(name)).schema[0].dataType.simpleString()


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text string), under fixed names, whatever else docs carries; ids keep their type."""
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id isn't in the one column of ids, with their columns; rows of null id stay.

    ids are written first, so that Spark knows their size: it broadcasts them if they are few, and only
    otherwise shuffles df.
    """
    gone = fresh(df, "gone")
    few = Work(df.sparkSession, "gone").table(ids.toDF(gone), "ids")
    return df.join(few, col(id_col) == F.col(gone), "left_anti").select(*(col(c) for c in df.columns))
