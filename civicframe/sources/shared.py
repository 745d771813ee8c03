"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the session names; in one of our own only where it names none and has no other machines."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="civicframe-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"
