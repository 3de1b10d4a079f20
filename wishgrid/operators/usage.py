"""Call-log rows and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
GATE_WINDOW = 500
GATE_MIN_RESOLVED_PCT = 90.0
GATE_MAX_NEEDLESS_PCT = 5.0
BREAKER_THRESHOLD = 2
BREAKER_COOLDOWN_S = 60

COUNTS = {
    "total": "true",
    "had_poi_or_center": "had_poi_or_center",
    "fully_resolved_within_had": "fully_resolved_deterministically and had_poi_or_center",
    "cache_hit": "cache_hit",
    "ai_called": "ai_called",
    "criteria_changed_by_ai": "criteria_changed_by_ai",
    "criteria_changed_within_ai_called": "criteria_changed_by_ai and ai_called",
    "changed_without_poi_or_center": "criteria_changed_by_ai and not had_poi_or_center",
    "ai_failed": "coalesce(ai_failed, false)",
    "ai_attempts": "ai_called or coalesce(ai_failed, false)",
}
SHARES = {
    "pct_had_poi_or_center": ("had_poi_or_center", "total"),
    "pct_fully_resolved_within_had": ("fully_resolved_within_had", "had_poi_or_center"),
    "pct_cache_hit": ("cache_hit", "total"),
    "pct_criteria_changed_within_ai_called": ("criteria_changed_within_ai_called", "ai_called"),
    "pct_changed_without_poi_or_center": (
        "changed_without_poi_or_center",
        "criteria_changed_by_ai",
    ),
    "pct_ai_failed": ("ai_failed", "ai_attempts"),
}


def count_columns() -> list[Column]:
    return [F.expr(f"count_if({cond})").alias(name) for name, cond in COUNTS.items()]


def share_columns() -> list[Column]:
    return [
        F.expr(f"case when {whole} > 0 then bround(100.0D * {part} / {whole}, 1) else 0.0D end").alias(name)
        for name, (part, whole) in SHARES.items()
    ]


def usage_report(log: DataFrame, *by: str) -> DataFrame:
    """Ten counts and six percentages; the failure share is taken of all attempts."""
    counted = log.groupBy(*by).agg(*count_columns()) if by else log.agg(*count_columns())
    return counted.select(*by, *COUNTS, *share_columns())


def gate_readiness(log: DataFrame, n: int = GATE_WINDOW) -> DataFrame:
    """The two gate criteria over the last ``n`` rows; not ready while there are fewer."""
    last = log.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(n)
    report = usage_report(last)
    enough = F.col("total") >= n
    return report.select(
        "total",
        "pct_fully_resolved_within_had",
        "pct_changed_without_poi_or_center",
        (enough & (F.col("pct_fully_resolved_within_had") >= GATE_MIN_RESOLVED_PCT)).alias(
            "resolved_gate_ready"
        ),
        (enough & (F.col("pct_changed_without_poi_or_center") <= GATE_MAX_NEEDLESS_PCT)).alias(
            "need_gate_ready"
        ),
    )


def call_log_row(outcomes: DataFrame) -> DataFrame:
    """P20: six flags of one request from the outcomes of its steps.

    ``outcomes(query_id, n_poi, center_requested, option_called, option_changed, option_failed,
    text_called, text_changed, text_failed, resolved, cache_hit, model_called, differs)``.
    """
    return outcomes.select(
        "query_id",
        F.expr("n_poi > 0 or center_requested").alias("had_poi_or_center"),
        F.col("resolved").alias("fully_resolved_deterministically"),
        F.col("cache_hit").alias("cache_hit"),
        F.expr("text_called or option_called or model_called").alias("ai_called"),
        F.expr(
            "option_changed or text_changed or ((cache_hit or model_called) and differs)"
        ).alias("criteria_changed_by_ai"),
        F.expr("text_failed or option_failed").alias("ai_failed"),
    )


def failure_streaks(
    log: DataFrame,
    n: int = BREAKER_THRESHOLD,
    cooldown_s: int = BREAKER_COOLDOWN_S,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Runs of at least ``n`` consecutive failed calls and how long they keep the guard open.

    ``log(occurred_at, event_id, ai_failed)``. The number of successes before a failure names its
    run. It is counted inside slices of time and offset by the successes of earlier slices, so the
    whole log is never sorted in one task; only one row per slice is.
    """
    sliced = log.withColumn(
        "chunk", F.expr(f"cast(floor(unix_seconds(cast(occurred_at as timestamp)) / {chunk_seconds}) as bigint)")
    )
    totals = sliced.groupBy("chunk").agg(F.expr("count_if(not ai_failed)").alias("ok"))
    earlier = totals.select(
        "chunk",
        F.coalesce(
            F.sum("ok").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("ok_before"),
    )
    in_chunk = Window.partitionBy("chunk").orderBy("occurred_at", "event_id")
    counted = sliced.withColumn(
        "ok_inside", F.sum(F.expr("cast(not ai_failed as bigint)")).over(in_chunk)
    )
    return (
        counted.where("ai_failed")
        .join(earlier, "chunk")
        .groupBy(F.expr("ok_before + ok_inside").alias("run"))
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.min("occurred_at").alias("started_at"),
            F.max("occurred_at").alias("last_failure_at"),
        )
        .where(F.col("failures") >= n)
        .withColumn("open_until", F.expr(f"last_failure_at + make_dt_interval(0, 0, 0, {cooldown_s})"))
        .drop("run")
    )
