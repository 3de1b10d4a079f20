"""Single-family expectations on short wishes."""

import pytest

from wishgrid.functions.text import normalize_chars
from wishgrid.operators import extract as e
from wishgrid.plans.parse import parse


@pytest.fixture(scope="module")
def parsed(spark):
    texts = list(CASES)
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    rows = parse(df, 2026, lines=["Сокольническая", "Большая кольцевая"]).collect()
    return {r["text"]: r for r in rows}


CASES = {
    "до 15 млн": {"price_max": 15_000_000, "price_min": None},
    "от 10 до 15 миллионов рублей": {"price_min": 10_000_000, "price_max": 15_000_000},
    "бюджет 15м": {"price_max": 15_000_000},
    "бабок 12 лямов": {"price_max": 12_000_000},
    "не более 25 000 000 руб": {"price_max": 25_000_000},
    "800к - 1.5м": {"price_min": 800_000, "price_max": 1_500_000},
    "студия или однушка": {"rooms": ["studio", "one"]},
    "2+ комнаты": {"rooms": ["two", "three_plus"]},
    "1, 2 и 3 комнатные квартиры": {"rooms": ["one", "two", "three_plus"]},
    "не студия": {"rooms": []},
    "от двух комнат": {"rooms": ["two", "three_plus"]},
    "площадь от 40, кухня от 8": {"area_min": 40.0, "area_kitchen_min": 8.0},
    "70-100 метров": {"area_min": 70.0, "area_max": 100.0},
    "площадь 40, площадь 60": {"area_min": 40.0, "area_dropped": ["площадь 60"]},
    "с 5 по 20 этаж": {"floor_min": 5, "floor_max": 20},
    "первый этаж": {"floor_min": 1, "floor_max": 1},
    "не первый и не последний этаж": {"not_first_floor": True, "not_last_floor": True, "last_floor": False},
    "с отделкой или без отделки": {"finish": [0]},
    "без отделки, нет, лучше с ремонтом": {"finish": [1]},
    "отделка под ключ с мебелью": {"finish": [1, 3]},
    "заселение 2026-2028": {"settlement_year_from": 2026, "settlement_year_to": 2028},
    "сдача в этом году": {"settlement_year_from": 2026, "settlement_year_to": 2026},
    "метро было в доступности 15 минут": {"time_on_foot": 15},
    "в шаговой доступности 7 минут": {"time_on_foot": 7},
    "10 минут ходьбы до метро": {"time_on_foot": 10},
    "20 минут на машине до метро": {"time_on_transport": 20},
    "внутри МКАД кольца": {"within_ring": True},
    "за МКАДом": {"within_ring": False},
    "просто квартира": {"within_ring": None, "rooms": []},
    "сначала дешевле": {"sort": "price_asc"},
    "привет": {"residual_classes": ["noise"]},
    "широкий балкон": {"residual_classes": ["lost"]},
    "школа в 15 минутах": {"poi": {("school", False): 1200}},
    "рядом вблизи до 18 минут школы и детские сады": {"poi": {("school", False): 1440, ("kindergarten", False): 1440}},
    "рядом с метро 10 минут и школа": {"poi": {("school", False): None}},
    "школа 500 м и школа 300 м": {"poi": {("school", False): 300}},
    "новый детский сад": {"poi": {("kindergarten", True): None}},
    "у любого метро": {"classes": [("метро", None)]},
    "рядом с мцд-2 не важно какой станции": {"classes": [("МЦД-2", None)]},
    "желтая ветка": {"classes": [("Калининская", None), ("Солнцевская", None)]},
    "сокольническая линия": {"classes": [("Сокольническая", None)]},
    "садовое кольцо": {"classes": []},
    "у метро Зюзино": {"unknown_stations": ["зюзино"]},
}


@pytest.mark.parametrize("text", list(CASES))
def test_wish(parsed, text):
    row = parsed[text]
    for field, want in CASES[text].items():
        if field == "poi":
            got = {(r["category"], r["only_new"]): r["max_distance_m"] for r in row["poi_requirements"]}
        elif field == "classes":
            got = [(r["line_prefix"], r["max_distance_m"]) for r in row["station_class_requirements"]]
        elif field == "residual_classes":
            got = [r["class"] for r in row["residuals"]]
        else:
            got = row[field]
        assert got == want, (text, field, got)


def test_offsets_survive_normalisation(spark):
    df = spark.createDataFrame([(1, "Ёлка PARK İx")], "query_id int, text string")
    row = df.withColumn("norm", normalize_chars("text")).first()
    assert len(row["norm"]) == len(row["text"])
    assert row["norm"].startswith("елка рark".replace("a", "а").replace("k", "к"))


def test_kept_spans_never_overlap(spark, sf):
    from wishgrid.queries import QUERIES

    rows = QUERIES["e0_arbitrate"](spark, sf).orderBy("doc_id", "s").collect()
    assert rows
    for a, b in zip(rows, rows[1:]):
        assert a["doc_id"] != b["doc_id"] or a["e"] <= b["s"]


def test_stems_skip_rings():
    assert [line for _, line in e.line_stems(["Кольцевая", "МЦД-1", "Арбатско-Покровская"])] == ["Арбатско-Покровская"]
