"""Where streams go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def to_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet: all that is there now, or again and again.

    The checkpoint has the source's offsets and the sink's log of batches, so a batch that is run again
    after a failure is written once.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def once_per_line(lines: DataFrame) -> DataFrame:
    """Lines without those that a replayed frame has brought again; a line is its log, frame and number."""
    return lines.dropDuplicates(["path", "frame_start", "line_no"])
