"""Folding of fact observations as a stream, exact for rows that come late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wishgrid.operators.facts import FACT_KEY, folded_slices, join_slices, slice_facts, with_chunk

DAY = 86400


def _read(spark: SparkSession, table: str, name: str, base: int) -> DataFrame:
    """The part ``name`` of the state since its compaction ``base``, with its ``epoch``."""
    return spark.read.parquet(f"{table}/{name}/base={base}")


def _write(df: DataFrame, table: str, name: str, base: int, epoch: int) -> None:
    """Written over when a batch is run again, so a lost driver leaves no row twice."""
    df.drop("epoch").write.mode("overwrite").parquet(f"{table}/{name}/base={base}/epoch={epoch}")


def _newest(slices: DataFrame) -> DataFrame:
    """The last version of every slice."""
    kept = [c for c in slices.columns if c not in (*FACT_KEY, "chunk", "epoch")]
    last = slices.groupBy(*FACT_KEY, "chunk").agg(F.max_by(F.struct(*kept), "epoch").alias("s"))
    return last.select(*FACT_KEY, "chunk", "s.*")


def fold_facts_stream(
    observations: DataFrame,
    table: str,
    chunk_seconds: int = DAY,
    keep_chunks: int | None = None,
    compact_every: int = 50,
    on_update: Callable[[DataFrame, int], None] | None = None,
) -> DataStreamWriter:
    """A4 over a stream of observations; ``folded_facts(table)`` equals the batch fold of all rows.

    The state is a table in the shared folder: the observations and, per fact and slice of time, what
    they add to the fold. A batch writes its rows and folds anew only the slices it touches, so rows may
    come in any order and as late as they like. ``on_update`` gets the facts of a batch as they are now.

    Every ``compact_every`` batches the state is written anew without its older versions. With
    ``keep_chunks``, observations more than that many slices older than the newest one then expire and
    the closed slices of a fact become a single row; what comes still later is not folded but kept
    in ``late_observations(table)``. Folders of older compactions (``base=``) are not read any more. The caller adds
    trigger and ``checkpointLocation`` and starts the writer.

    Null times belong to no order and are left out, as is nothing else; null values and confidences
    count as in A4. An empty batch changes nothing.
    """
    columns = [*FACT_KEY, "fact_value", "source", "confidence", "observed_at", "event_order"]

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        base = epoch // compact_every * compact_every
        horizon = _read(spark, table, "horizon", base).first().horizon if base else None
        timed = with_chunk(batch.select(*columns), chunk_seconds).where("chunk is not null")
        if horizon is not None:
            _write(timed.where(F.col("chunk") < horizon), table, "late", base, epoch)
            timed = timed.where(F.col("chunk") >= horizon)
        # Sorted, so that the files of other times are skipped by their bounds.
        _write(timed.sortWithinPartitions("chunk"), table, "rows", base, epoch)
        rows = _read(spark, table, "rows", base).where(F.col("epoch") <= epoch)
        fresh = rows.where(F.col("epoch") == epoch)
        span = fresh.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()
        touched = fresh.select(*FACT_KEY, "chunk").distinct()
        again = rows.where(F.col("chunk").between(span.lo, span.hi)).join(touched, [*FACT_KEY, "chunk"], "left_semi")
        _write(slice_facts(again.select(*columns), None, chunk_seconds), table, "slices", base, epoch)
        slices = _read(spark, table, "slices", base).where(F.col("epoch") <= epoch)
        if on_update:
            on_update(folded_slices(_newest(slices.join(touched.select(*FACT_KEY).distinct(), FACT_KEY, "left_semi"))), epoch)
        if (epoch + 1) % compact_every == 0:
            _compact(spark, table, _newest(slices), rows, horizon, keep_chunks, epoch)

    return observations.writeStream.outputMode("append").foreachBatch(step)


def _compact(
    spark: SparkSession, table: str, slices: DataFrame, rows: DataFrame, horizon: int | None, keep: int | None, epoch: int
) -> None:
    """The state after ``epoch`` as the start of a new base; the horizon is written last and makes it valid."""
    base = epoch + 1
    if keep is not None:
        newest = slices.agg(F.max("chunk")).first()[0]
        bounds = [b for b in (horizon, None if newest is None else newest - keep) if b is not None]
        horizon = max(bounds, default=None)
    if horizon is not None:
        rows = rows.where(F.col("chunk") >= horizon)
        closed = join_slices(slices.where(F.col("chunk") < horizon))
        slices = slices.where(F.col("chunk") >= horizon).unionByName(closed)
    _write(rows.sortWithinPartitions("chunk"), table, "rows", base, epoch)
    _write(slices, table, "slices", base, epoch)
    bound = spark.range(1).select(F.lit(horizon).cast("bigint").alias("horizon"))
    _write(bound, table, "horizon", base, epoch)


def _bases(spark: SparkSession, table: str, name: str) -> DataFrame | None:
    """The part ``name`` over all compactions, if there is any."""
    try:
        return spark.read.parquet(f"{table}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def folded_facts(spark: SparkSession, table: str) -> DataFrame:
    """The facts as the stream has folded them so far, from the newest compaction written to its end."""
    horizons = _bases(spark, table, "horizon")
    base = horizons.agg(F.max("base")).first()[0] if horizons is not None else 0
    return folded_slices(_newest(_read(spark, table, "slices", base)))


def late_observations(spark: SparkSession, table: str) -> DataFrame | None:
    """Observations that came after their slice had closed; None where no slice ever closed."""
    late = _bases(spark, table, "late")
    return late.drop("base", "epoch", "chunk") if late is not None else None
