"""Reference catalogues, provider feeds, map elements, corpora and place caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wishgrid.functions.text import normalize_key

ENTRY_FIELDS = (
    "name string, slug string, id string, aliases array<string>, lat double, lon double,"
    " is_center boolean, category string, district string, county string, metro string, line string"
)
FIELD_NAMES = [f.split()[0] for f in ENTRY_FIELDS.split(", ")]

# Catalogue kinds and their files.
CATALOG_FILES = {
    "metro": "metro.json",
    "counties": "counties.json",
    "districts": "districts.json",
    "complexes": "complexes.json",
    "benefits": "benefits.json",
    "option_groups": "option_groups.json",
    "options": "options.json",
    "landmarks": "landmarks.json",
}

FEED = (
    "id bigint, name string, url string, metro string, district string, latitude double,"
    " longitude double, locations struct<parent: struct<name: string>,"
    " child: struct<id: bigint, name: string, url: string>>"
)

ELEMENT = (
    "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>,"
    " tags map<string, string>, members array<struct<type: string, ref: bigint, role: string>>"
)

POI_RECORD = (
    "count int, closest_distance_m double, closest_name string, closest_unnamed boolean,"
    " count_operational int, count_under_construction int, closest_under_construction_m double,"
    " schema_version int"
)


def _kind_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per catalogue file: its kind and its JSON array."""
    docs = None
    for kind, name in CATALOG_FILES.items():
        one = spark.read.option("wholetext", True).option("pathGlobFilter", name).text(folder)
        one = one.select(F.lit(kind).alias("kind"), "value")
        docs = one if docs is None else docs.unionByName(one)
    return docs


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON arrays of a folder as one table ``(kind, ord, …)``; file order is ``ord``."""
    parsed = _kind_documents(spark, folder).select(
        "kind",
        F.posexplode(
            F.from_json("value", f"array<struct<{_struct(ENTRY_FIELDS)}>>", {"mode": "FAILFAST"})
        ).alias("ord", "e"),
    )
    flat = parsed.select("kind", F.col("ord").cast("long").alias("ord"), "e.*")
    return flat.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def unknown_fields(spark: SparkSession, folder: str) -> DataFrame:
    """``(kind, ord, field)`` of every field the catalogue schema does not know."""
    raw = _kind_documents(spark, folder).select(
        "kind",
        F.posexplode(F.from_json("value", "array<map<string, string>>")).alias("ord", "e"),
    )
    known = F.array(*[F.lit(n) for n in FIELD_NAMES])
    return raw.select(
        "kind", F.col("ord").cast("long").alias("ord"), F.explode(F.map_keys("e")).alias("field")
    ).where(~F.array_contains(known, F.col("field")))


def _struct(fields: str) -> str:
    return ", ".join(f"{f.split()[0]}: {' '.join(f.split()[1:])}" for f in fields.split(", "))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """S1 for a large catalogue: JSON lines with ``kind`` and ``ord``, split over many tasks."""
    rows = (
        spark.read.schema(f"kind string, ord bigint, {ENTRY_FIELDS}").option("mode", "FAILFAST").json(path)
    )
    return rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def unknown_entry_fields(spark: SparkSession, path: str) -> DataFrame:
    """``read_entries`` counterpart of ``unknown_fields``: occurrences per unknown field."""
    known = ", ".join(f"'{n}'" for n in ["kind", "ord", *FIELD_NAMES])
    keys = spark.read.text(path).select(F.explode(F.expr("json_object_keys(value)")).alias("field"))
    return keys.where(f"field not in ({known})").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def file_order(entries: DataFrame) -> DataFrame:
    """Sort by (matching key, slug) and number in that order (increasing, not consecutive)."""
    ordered = entries.orderBy(normalize_key("name"), F.coalesce("slug", F.lit("")))
    return ordered.withColumn("ord", F.monotonically_increasing_id())


def write_catalog(entries: DataFrame, path: str) -> None:
    """JSON lines in file order; empty and NULL fields are left out."""
    slim = entries.withColumn("aliases", F.expr("case when size(aliases) > 0 then aliases end"))
    file_order(slim).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """The machine-readable rows of an audit."""
    report.write.mode("overwrite").json(path)


def read_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Provider feed, a JSON array or (``lines``) one object per line."""
    reader = spark.read.schema(FEED).option("mode", "FAILFAST").option("multiLine", not lines)
    return reader.json(path).withColumn("pos", F.monotonically_increasing_id())


def read_osm(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S3: map elements, a document with ``elements`` or (``lines``) one element per line."""
    if lines:
        return spark.read.schema(ELEMENT).option("mode", "FAILFAST").json(path)
    doc = (
        spark.read.schema(f"elements array<struct<{_struct_nested()}>>")
        .option("mode", "FAILFAST")
        .option("multiLine", True)
        .json(path)
    )
    # A document without ``elements`` is an error, not an empty result.
    checked = doc.withColumn(
        "elements", F.coalesce("elements", F.raise_error(F.lit("document has no elements")))
    )
    return checked.select(F.explode("elements").alias("e")).select("e.*")


def _struct_nested() -> str:
    return (
        "type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>,"
        " tags: map<string, string>, members: array<struct<type: string, ref: bigint, role: string>>"
    )


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One query per line without blank and ``#`` lines; ``ord`` follows the file.

    The order key is (file, start of the split, position in the split), so files are read in
    parallel.
    """
    lines = spark.read.text(path).select(
        F.struct(
            F.input_file_name().alias("file"),
            F.expr("input_file_block_start()").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ord"),
        F.trim("value").alias("text"),
    )
    kept = lines.where("text <> '' and not startswith(text, '#')")
    return kept.orderBy("ord").limit(limit) if limit is not None else kept


def poi_long(cache: DataFrame) -> DataFrame:
    """``(slug, doc)`` with ``doc`` a JSON map category -> record, as one row per record."""
    record = f"map<string, struct<{_struct(POI_RECORD)}>>"
    parsed = cache.select("slug", F.from_json("doc", record, {"mode": "FAILFAST"}).alias("m"))
    rows = parsed.select("slug", F.explode("m").alias("category", "r")).select("slug", "category", "r.*")
    return rows.withColumn("schema_version", F.coalesce("schema_version", F.lit(1))).na.fill(
        {"count_operational": 0, "count_under_construction": 0, "closest_unnamed": False}
    )


def read_poi_cache(spark: SparkSession, path: str) -> DataFrame:
    """A document slug -> category -> record."""
    doc = spark.read.option("wholetext", True).text(path)
    per_slug = doc.select(F.explode(F.from_json("value", "map<string, string>")).alias("slug", "doc"))
    return poi_long(per_slug)
