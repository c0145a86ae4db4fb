"""Folders for tables that a job writes for itself and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names. Only a local master may do without that setting."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        shared = os.path.join(tempfile.gettempdir(), "lineloom", sc.applicationId)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
