"""Columns that an operator passes through, whatever they are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sheltered(frame: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``frame`` with all columns but ``own`` under names that clash with nothing, and what names them back."""
    inner = [n if n in own else f"passed_through_{i}" for i, n in enumerate(frame.columns)]
    outer = list(zip(inner, frame.columns, strict=True))
    return frame.toDF(*inner), lambda done: done.select(*[F.col(f"`{a}`").alias(b) for a, b in outer])
