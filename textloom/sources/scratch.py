"""Folders for files that a query makes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in a temporary one only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
