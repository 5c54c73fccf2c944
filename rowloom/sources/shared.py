"""A folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='rowloom-')}"
    return f"{base.rstrip('/')}/rowloom-{name}-{uuid.uuid4().hex}"
