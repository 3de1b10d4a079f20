"""Call-log rows of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_LOG = (
    "event_id bigint, occurred_at timestamp, had_poi_or_center boolean,"
    " fully_resolved_deterministically boolean, cache_hit boolean, ai_called boolean,"
    " criteria_changed_by_ai boolean, ai_failed boolean"
)


def last_days(log: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``; all rows when ``days`` is None.

    The bound is a constant, so it reaches the scan as a pushed filter or a partition filter.
    """
    if days is None:
        return log
    kind = log.schema["occurred_at"].dataType.simpleString()
    bound = f"cast('{as_of}' as {kind}) - make_dt_interval({int(days)})"
    return log.where(f"occurred_at >= {bound}")


def read_call_log(
    spark: SparkSession, path: str, as_of: str, days: int | None = None
) -> DataFrame:
    """A log stored by day (``day=yyyy-MM-dd`` folders) prunes whole folders."""
    log = spark.read.schema(CALL_LOG + ", day date").parquet(path)
    if days is not None:
        log = log.where(F.expr(f"day >= cast(cast('{as_of}' as timestamp) - make_dt_interval({int(days)}) as date)"))
    return last_days(log, as_of, days)


def write_call_log(log: DataFrame, path: str) -> None:
    """Append rows to the day folders they belong to."""
    day = log.withColumn("day", F.to_date("occurred_at"))
    day.repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(8))).write.mode("append").partitionBy(
        "day"
    ).parquet(path)
