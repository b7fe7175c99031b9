"""How many partitions a shuffle gets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Estimates beyond this are the optimizer's word for "unknown".
_UNKNOWN = 1 << 55


def plan_bytes(frame: DataFrame) -> int:
    """The optimizer's estimate of a frame's size, 0 where it has none."""
    estimate = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < _UNKNOWN else 0


def shuffle_partitions(frame: DataFrame, each: int = 128 << 20) -> int:
    """The session's number of shuffle partitions, or more where those would exceed ``each`` bytes."""
    own = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(math.ceil(plan_bytes(frame) / each), 200_000))
