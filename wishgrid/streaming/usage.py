"""Call-log metrics per window of time, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishgrid.operators.usage import COUNTS, count_columns, share_columns


def usage_report_stream(
    log: DataFrame, width: str = "1 day", delay: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Tumbling (or sliding) windows over a streaming log; rows later than ``delay`` are dropped."""
    span = F.window("occurred_at", width, slide) if slide else F.window("occurred_at", width)
    counted = log.withWatermark("occurred_at", delay).groupBy(span).agg(*count_columns())
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *COUNTS,
        *share_columns(),
    )
