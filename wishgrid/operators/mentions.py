"""Which of several mentions counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(mentions: DataFrame) -> DataFrame:
    """First non-NULL value by position. ``mentions(query_id, pos, value)``."""
    return mentions.groupBy("query_id").agg(
        F.expr("min_by(value, pos) filter (where value is not null)").alias("first_value")
    )


def last_mention(mentions: DataFrame) -> DataFrame:
    """Side of the last mention. ``mentions(query_id, pos, side)``."""
    return mentions.groupBy("query_id").agg(F.max_by("side", "pos").alias("last_side"))
