"""Values compared as JSON, curation that fails loudly, distances far behind a name."""

import pytest

from wishgrid.operators import catalog, facts
from wishgrid.plans.parse import parse_wishes


def test_key_order_is_no_conflict(spark):
    rows = [("c", "1", "f", v, "s", 0.5 + k / 10, f"2024-01-0{k + 1} 00:00:00", k) for k, v in enumerate(['{"v":1,"w":2}', '{"w":2, "v":1}', '{"v":2}', "no json"])]
    table = spark.createDataFrame(rows, "subject_type string, subject_id string, fact_type string, fact_value string, source string, confidence double, observed_at string, event_order int")
    two = facts.fold_facts(table.where("event_order < 2")).collect()[0]
    assert (two.conflicts, two.confidence, two.fact_value) == (0, 0.6, '{"w":2, "v":1}')
    assert facts.fold_facts(table).collect()[0].conflicts == 2


def test_curation_errors_stop_the_query(spark):
    entries = spark.createDataFrame([("A", ["a"])], "name string, aliases array<string>").withColumn("slug", catalog.F.lit("x")).withColumn("id", catalog.F.lit(None).cast("string"))
    none = spark.createDataFrame([], "duplicate string, target string, extra_alias string")
    rename = spark.createDataFrame([], "old string, new string")
    gone = spark.createDataFrame([("nobody",)], "name string")
    with pytest.raises(Exception, match="curation errors"):
        catalog.apply_curation(entries, gone, none, rename).collect()


def test_names_next_to_understood_spans(spark):
    texts = ["однушку 10 минут от метро тушинская", "Руставели 14 до 21 млн", "двушка у метро Неведомская", None]
    wishes = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    entries = spark.createDataFrame(
        [(1, "metro", "Тушинская", "tushinskaya", "7", []), (2, "complex", "Руставели 14", "rustaveli", "8", [])],
        "ord int, type string, name string, slug string, id string, aliases array<string>",
    )
    rows = {r.query_id: r for r in parse_wishes(wishes, 2026, entries).collect()}
    assert [m.name for m in rows[0].metro] == ["Тушинская"] and not rows[0].unknown_stations
    assert [m.name for m in rows[1].complexes] == ["Руставели 14"] and rows[1].price_min is None
    assert len(rows[2].unknown_stations) == 1 and len(rows) == 4
