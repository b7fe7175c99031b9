"""Python workers find this package where the driver has it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reach(spark: SparkSession) -> None:
    """Put the package's folder on the path of the workers that are started from now on.

    That serves sessions whose machines see this folder; elsewhere the package is shipped, by
    ``--py-files`` or as an installed one.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
