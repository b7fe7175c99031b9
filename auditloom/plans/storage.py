"""The folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; only in local mode, if that is unset, below a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
