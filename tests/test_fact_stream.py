"""Facts folded as a stream against the batch fold: late rows, restarts, compaction, expiry."""

import pytest
from pyspark.sql import functions as F

from wishgrid.operators.facts import fold_facts, folded_slices, join_slices, slice_facts
from wishgrid.queries.facts import observations
from wishgrid.streaming.facts import fold_facts_stream, folded_facts, late_observations

SCHEMA = (
    "subject_type string, subject_id string, fact_type string, fact_value string, source string,"
    " confidence double, observed_at timestamp, event_order bigint"
)


@pytest.fixture(scope="module")
def told(spark, sf):
    """Observations with nulls, values spelled in two ways and one fact with a third of all rows."""
    rows = observations(spark, sf).withColumn("observed_at", F.expr("cast(observed_at as timestamp)"))
    hot = "event_order % 3 = 0"
    return rows.selectExpr(
        "subject_type", f"case when {hot} then 'hot' else subject_id end as subject_id",
        f"case when {hot} then 'click' else fact_type end as fact_type",
        "case event_order % 7 when 0 then null when 1 then '{\"a\":1, \"b\":2}' when 2 then '{\"b\":2,\"a\":1}' else fact_value end as fact_value",
        "source", "nullif(round(confidence, 3), 0.5) as confidence", "observed_at", "event_order",
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def feed(spark, folder, batches, **options):
    """Every batch is a run of its own over the same checkpoint, as after a restart."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        writer = fold_facts_stream(stream, f"{folder}/state", **options)
        writer.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return folded_facts(spark, f"{folder}/state")


def test_late_rows_equal_the_batch_fold(spark, told, tmp_path):
    parts = [told.where(f"pmod(xxhash64(event_order), 3) = {k}") for k in range(3)]
    seen = {}
    folded = feed(
        spark, tmp_path, parts, compact_every=2, on_update=lambda facts, epoch: seen.update({epoch: rows_of(facts)})
    )
    whole = rows_of(fold_facts(told))
    assert rows_of(folded) == whole
    assert seen[2] == [r for r in whole if r[:3] in {x[:3] for x in seen[2]}]
    assert late_observations(spark, f"{tmp_path}/state") is None


def test_slices_expire_and_what_comes_later_is_kept_apart(spark, told, tmp_path):
    days = [r.d for r in told.selectExpr("cast(observed_at as date) as d").distinct().orderBy("d").collect()]
    cut = days[len(days) // 2]
    early = told.where(F.col("observed_at") < F.lit(cut))
    later = told.where(F.col("observed_at") >= F.lit(cut))
    held = early.where("event_order % 10 = 0")
    folded = feed(spark, tmp_path, [early.where("event_order % 10 > 0"), later, held], compact_every=2, keep_chunks=2)
    horizon = spark.read.parquet(f"{tmp_path}/state/horizon/base=2").first().horizon
    closed = F.expr(f"unix_seconds(observed_at) < {horizon} * 86400")
    late = held.where(closed)
    assert late.count() > 0
    assert rows_of(late_observations(spark, f"{tmp_path}/state").select(*told.columns)) == rows_of(late)
    assert rows_of(folded) == rows_of(fold_facts(told.exceptAll(late)))
    state = f"{tmp_path}/state"
    assert spark.read.parquet(f"{state}/rows/base=2").where(f"chunk < {horizon}").count() == 0
    kept = spark.read.parquet(f"{state}/slices/base=2").where(f"chunk < {horizon}")
    assert kept.count() == kept.select("subject_type", "subject_id", "fact_type").distinct().count() > 0


def test_slices_join_in_any_grouping(spark, told):
    slices = slice_facts(told).cache()
    middle = slices.agg(F.expr("cast(percentile_approx(chunk, 0.5) as bigint)")).first()[0]
    left, right = slices.where(f"chunk < {middle}"), slices.where(f"chunk >= {middle}")
    whole = rows_of(folded_slices(slices))
    assert rows_of(folded_slices(join_slices(left).unionByName(right))) == whole
    assert rows_of(folded_slices(left.unionByName(join_slices(right)))) == whole
    assert rows_of(fold_facts(told, chunk_seconds=3600)) == whole


def test_an_empty_batch_and_null_times(spark, tmp_path):
    one = spark.createDataFrame([("c", "1", "f", "1", "s", 0.5, None, 1)], SCHEMA)
    assert feed(spark, tmp_path, [one.limit(0), one]).collect() == []
