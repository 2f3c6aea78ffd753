"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL_SHARED = "/tmp/graphquarry-shared"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, from ``spark.checkpoint.dir``; a local one only where all is one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = LOCAL_SHARED
    return f"{top.rstrip('/')}/graphquarry/{uuid.uuid4().hex}"
