"""Faults of the fourth round: rules that scan texts without their literals, data joined through the driver."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wishgrid.functions.spans import Rule, match_spans, needles
from wishgrid.packs import russian as ru


def _rules():
    packs = [v if isinstance(v, list) else [v] for v in vars(ru).values()]
    return [r for pack in packs for r in pack if isinstance(r, Rule)]


def test_a_match_holds_the_literals_of_its_rule():
    assert needles(r"\bот\s+(одн\w+|двух)\s+комнат\w*") == (("комнат",), ("двух", "одн"))
    assert needles(r"(?i)\bметро") == () and needles(r"\d+\s*(?:м|\d)?") == ()
    guarded = [r for r in _rules() if needles(r.pattern)]
    assert len(guarded) > 90
    wishes = (
        "2-комнатная квартира до 12 млн, кухня от 8 м2, не выше 5 этажа, БЕЗ отделки, до метро 7 минут пешком, школа и аптека"
        " в пределах 1 км, сдача до 2027 года, вторичка, рядом с мцд-3, широкий балкон, студия или двушка, бюджет 5"
    ).lower()
    met = 0
    for rule in guarded:
        for hit in re.finditer(rule.pattern, wishes):
            met += 1
            assert all(any(x in hit.group() for x in one) for one in needles(rule.pattern)), rule
    assert met > 15


def test_matches_are_found_in_one_pass(spark):
    rule = Rule("r", r"(а)?(б+)(в)?", 3)
    rows = spark.createDataFrame([(1, "хабб б абв"), (2, "xyz"), (3, ""), (4, None), (5, "б")], "id int, t string")
    text = match_spans("t", rule)
    assert text.count("regexp_replace") == 1 and "regexp_extract_all" not in text and "rlike" not in text
    got = {r.id: [(m.s, m.e, m.hit, m.g) for m in r.m] for r in rows.select("id", F.expr(text).alias("m")).collect()}
    assert got == {
        1: [(1, 4, "абб", ["а", "бб", None]), (5, 6, "б", [None, "б", None]), (7, 10, "абв", ["а", "б", "в"])],
        2: [], 3: [], 4: [], 5: [(0, 1, "б", [None, "б", None])],
    }


def test_stations_are_not_sent_through_the_driver(spark):
    from wishgrid.operators.spatial import station_points

    rows = [(i, f"n{i}", "Кольцевая / Синяя" if i % 3 else None, 55.0 if i % 7 else None, 37.0) for i in range(400)]
    stations = spark.createDataFrame(rows, "ord long, name string, line string, lat double, lon double")
    asked = spark.createDataFrame([("метро",), ("синя",), ("КОЛЬ",), ("кольц",), ("красн",)], "line_prefix string")
    out = station_points(stations, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    broadcast = [plan[i : i + 400] for i in range(len(plan)) if plan.startswith("BroadcastExchange", i)]
    assert len(broadcast) == 1 and "explode" not in broadcast[0]
    got = sorted((r.line_prefix, r.ord) for r in out.collect())
    located = [r for r in rows if r[3] is not None]
    want = [("метро", r[0]) for r in located] + [(p, r[0]) for r in located if r[2] for p in ("синя", "КОЛЬ", "кольц")]
    assert got == sorted(want)


def test_cards_of_blocks_are_audited_as_cards_one_by_one(spark):
    from wishgrid.operators.listings import axis_audit, axis_audit_of_blocks

    criteria = spark.range(60).selectExpr(
        "id as query_id", "case when id % 2 = 0 then 1 + id % 5 end as floor_min", "case when id % 3 = 0 then 2 + id % 3 end as floor_max",
        "100 * (id % 9) as price_min", "cast(null as int) as price_max", "cast(null as double) as area_min",
        "case when id % 4 = 0 then 30.5D end as area_max", "case when id % 5 = 0 then 2001 end as year_from", "cast(null as int) as year_to",
        "case when id % 6 = 0 then array(1, 3) else array() end as rooms_any",
        "case when id % 7 = 0 then array() when id % 7 = 1 then null when id % 7 = 2 then array('b1', 'b1', 'none') else array('b1', concat('b', id % 4)) end as blocks",
    ).selectExpr("*", "cast(rooms_any as array<int>) as r").drop("rooms_any").withColumnRenamed("r", "rooms_any")
    listings = spark.range(900).selectExpr(
        "id", "concat('b', case when id % 10 < 7 then 1 else id % 5 end) as block_id", "case when id % 11 > 0 then cast(id % 9 as int) end as floor",
        "id % 300 as price", "case when id % 5 <> 4 then 20.0D + id % 30 end as area", "2000 + cast(id % 3 as int) as year", "cast(id % 6 as int) as rooms",
    )
    cards = criteria.selectExpr("query_id", "explode(array_distinct(blocks)) as block_id").join(listings, "block_id")
    columns = ["query_id", "axis", "cards", "checked", "actual_min", "actual_max", "violations", "example_id", "actual_values", "verdict"]
    one_by_one = axis_audit(criteria, cards).select(*columns).collect()
    out = axis_audit_of_blocks(criteria, listings).select(*columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, one_by_one)) and len(one_by_one) > 100


def test_names_that_begin_alike_are_looked_up_whole(spark):
    from wishgrid.operators.routes import named_in_text

    names = [(i, f"Tower of the North {i:04d}", [], 55.0, 37.0) for i in range(900)]
    names += [(2000, "Mill", ["old mill", "ab"], 55.0, 37.0), (1999, "Mill", [], 55.0, 37.0), (5, "Lost", [], None, 37.0), (2001, "", [""], 55.0, 37.0)]
    catalog = spark.createDataFrame(names, "ord long, name string, aliases array<string>, lat double, lon double")
    texts = [(i, f"near TOWER OF THE NORTH {i % 1000:04d} please") for i in range(1500)]
    texts += [(9001, "the old mill, drab"), (9002, "drab"), (9003, "lost"), (9004, ""), (9005, None)]
    out = named_in_text(spark.createDataFrame(texts, "query_id long, text string"), catalog)
    want = {i: i % 1000 for i in range(1500) if i % 1000 < 900} | {9001: 1999, 9002: 2000}
    assert {r.query_id: r.ord for r in out.collect()} == want
    assert "Contains(low" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_matches_of_a_location_are_not_shuffled(spark):
    from wishgrid.operators.catalog import location_filter

    rows = [(i, f"b{i}", f"d{i % 4}", f"c{i % 3}" if i % 5 else None, "D1") for i in range(60)]
    complexes = spark.createDataFrame(rows, "ord long, place_id string, district string, county string, metro string")
    wanted = [(q, n) for q in range(40) for n in ([f"d{q % 5}", f"D{q % 5}", "c1"] if q % 2 else [None, "d1", ""])]
    out = location_filter(complexes, spark.createDataFrame(wanted, "query_id long, name string"))
    names = {q: {n.lower().replace("c", "с") for a, n in wanted if a == q and n} for q in range(40)}
    tags = {r[0]: {t.lower().replace("c", "с") for t in r[2:] if t} for r in rows}
    got = [(r.query_id, r.ord) for r in out.collect()]
    assert sorted(got) == sorted((q, o) for q in names for o in tags if names[q] & tags[o])
    assert out._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Project")


def test_every_task_has_its_part_of_the_fallback(spark):
    from wishgrid.operators.routes import origins

    criteria = spark.range(0, 200, 1, 1).withColumnRenamed("id", "query_id")
    requested = criteria.where("query_id < 10").selectExpr("query_id", "concat('n', query_id) as name")
    complexes = spark.range(0, 40, 1, 1).selectExpr(
        "id as ord", "concat('n', id) as name", "cast(array() as array<string>) as aliases", "case when id <> 3 then 55.0D end as lat", "37.0D as lon"
    )
    out = origins(criteria, requested, complexes)
    rows = [tuple(r) for r in out.collect()]
    named = {(i, i, False) for i in range(10) if i != 3}
    assert set(rows) == named | {(q, o, True) for q in [3, *range(10, 200)] for o in range(40) if o != 3} and len(rows) == len(set(rows))
    assert out.where("fallback").select(F.spark_partition_id().alias("p")).distinct().count() > 1
