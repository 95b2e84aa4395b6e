"""Where streams keep their progress."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and Spark is one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meterstone-")
    return f"{found.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
