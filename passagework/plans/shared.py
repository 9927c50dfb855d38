"""A folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, under a temporary folder on a local master, and an error elsewhere."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="passagework-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
