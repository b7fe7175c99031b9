"""Intermediate tables in the cluster's shared folder.

Iterative operators cut their lineage by writing Parquet under ``spark.checkpoint.dir`` and reading
it again: unlike local checkpoints these tables outlive the executors that wrote them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Set while an intermediate table is written: its shuffle files go as soon as it is complete.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Small shuffle partitions are put together to files of about so many bytes at least.
_FILE_BYTES, _ADVISORY = 14 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: On a mounted folder a table's files need no checksum files beside them: Parquet's pages have their own, which readers verify.
_MOUNTED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from the session's ``spark.checkpoint.dir``. Only in local mode, where one process does all, a
    temporary folder is made and set if that is unset; a cluster has to name its folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """A folder of intermediate tables, removed when the session ends; ``drop`` removes one earlier."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def table(self, frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """``frame`` written as Parquet and read again, without its lineage."""
        path = f"{self.path}/{name}"
        plain = path.startswith("file:") or "://" not in path
        own = self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(self.spark.conf.get(_ADVISORY))
        with settings(self.spark, _WRITING | {_ADVISORY: str(max(own, _FILE_BYTES))}):
            frame.write.mode("overwrite").options(**(_MOUNTED if plain else {})).parquet(path, compression=compression)
        return self.spark.read.schema(frame.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.path}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before
            return
