"""Streamed forms of the append-only inputs, replayed from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishgrid.operators import usage
from wishgrid.queries.base import table, with_sql
from wishgrid.queries.facts import K, SQL_COUNTS, SQL_FOLDED, SQL_LOG, SQL_OBS, SQL_SHARES, SQL_STAMP, _stamped
from wishgrid.queries.registry import query
from wishgrid.session import scratch_path
from wishgrid.streaming.facts import fold_facts_stream, folded_facts
from wishgrid.streaming.usage import usage_report_stream

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(f"{sf}/events.parquet*")


@query(
    "t1_usage_report_stream",
    with_sql(
        SQL_LOG,
        f"counted AS (SELECT date_trunc('day', occurred_at) AS window_start, {SQL_COUNTS} FROM log GROUP BY 1)",
    )
    + f"""SELECT *, {SQL_SHARES} FROM (SELECT * REPLACE (strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start) FROM counted
 WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""",
)
def t1_usage_report_stream(spark, sf):
    log = event_stream(spark, sf).selectExpr(
        # The table holds wall-clock times; they are read as UTC so that days do not depend on the session.
        "cast(concat(cast(ts as string), 'Z') as timestamp) as occurred_at", f"{K} % 3 <> 0 as had_poi_or_center", f"{K} % 5 < 2 as fully_resolved_deterministically",
        f"{K} % 7 = 1 as cache_hit", f"{K} % 4 = 0 as ai_called", f"({K} % 8 = 0 or {K} % 6 = 1) as criteria_changed_by_ai",
        "event_type = 'error' as ai_failed",
    )
    out = scratch_path(spark, "usage-stream")
    job = (
        usage_report_stream(log, "1 day", "1 hour")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "usage-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    done = spark.read.parquet(out).drop("window_end").withColumn(
        "window_start", F.expr("to_utc_timestamp(window_start, current_timezone())")
    )
    return _stamped(done, "window_start").select("window_start", *usage.COUNTS, *usage.SHARES)


@query(
    "t2_fold_facts_stream",
    with_sql(SQL_OBS, SQL_FOLDED)
    + f"""SELECT subject_type, subject_id, fact_type, fact_value, source, round(confidence, 4) AS confidence, observed_count, conflicts,
 {SQL_STAMP.format('first_seen_at')}, {SQL_STAMP.format('last_confirmed_at')} FROM folded""",
)
def t2_fold_facts_stream(spark, sf):
    """The events come in two batches that share all days, so half of the rows come late."""
    dealt = scratch_path(spark, "facts-input")
    halves = table(spark, sf, "events").withColumn("half", F.expr("xxhash64(event_id) < 0"))
    for half in ("half", "not half"):
        halves.where(half).drop("half").coalesce(1).write.mode("append").parquet(dealt)
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(dealt)
    rows = arriving.selectExpr(
        "'user' as subject_type", "cast(user_id as string) as subject_id", "event_type as fact_type",
        f"concat('{{\"v\":', {K} % 2, '}}') as fact_value",
        "case when value > 400 then 'promoted' else 'ai_inference' end as source", "value / 500 as confidence",
        "cast(ts as timestamp) as observed_at", "event_id as event_order",
    )
    state = scratch_path(spark, "facts-state")
    job = (
        fold_facts_stream(rows, state)
        .option("checkpointLocation", scratch_path(spark, "facts-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    folded = folded_facts(spark, state)
    return _stamped(folded.withColumn("confidence", F.round("confidence", 4)), "first_seen_at", "last_confirmed_at")
