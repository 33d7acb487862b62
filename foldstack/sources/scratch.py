"""Shared storage for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, made known to Spark if it is not yet.

    Only a local session without the setting gets a temporary folder; a cluster must name one
    that every executor can reach.
    """
    context = spark.sparkContext
    known = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder all executors share")
        known = tempfile.mkdtemp(prefix="foldstack-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, uri: str) -> bool:
    """One metadata call, however many files lie below ``uri``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
