"""Working folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class NoSharedFolder(RuntimeError):
    pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` or the context's checkpoint folder. Where both are unset, a local master gets a folder of our own; on a cluster,
    where each executor would write to its own disk, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
