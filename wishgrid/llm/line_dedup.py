"""Repeated lines across documents: the earliest stays, the others go, with their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.llm.common import written

#: What separates lines or paragraphs.
SEPARATORS = {"line": r"\n", "paragraph": r"\n\n"}
#: White space as in Unicode.
WHITE = r"[\x09-\x0D \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), WHITE + "+", " "))


def unit_table(docs: DataFrame, unit: str = "line", least_words: int = 1) -> DataFrame:
    """doc_id, key (hash of the text), pos, len (characters), digest (null for empty units and those of fewer words)."""
    gap = SEPARATORS[unit]
    exploded = docs.where("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", gap)).alias("pos", "unit")
    )
    normal = _normal(F.col("unit"))
    enough = F.length(normal) - F.length(F.replace(normal, F.lit(" "))) >= least_words - 1
    return exploded.select(
        "doc_id", "key", "pos", F.length("unit").alias("len"), F.when(enough & (normal != ""), F.unhex(F.md5(normal))).alias("digest")
    )


def repeated_units(docs: DataFrame, unit: str = "line", least_words: int = 1) -> DataFrame:
    """documents(doc_id, text) -> doc_id, key, n_units, n_removed, chars_removed, spans, one row per row of ``docs``.

    A unit is a line (or paragraph); normalised it is lower-cased with white space made one space. Of equal units the
    first by (doc_id, place) stays, nulls first, and all others go, also within a document, however short they are.
    ``spans`` has the removed units in the original text: start (from 0, in characters) and length, neighbours not
    joined. Blank units stay; ``least_words`` above 1 keeps units of fewer words too. Null and empty texts have 0 units
    and 1; rows that repeat both doc_id and text are one document that keeps the same units in each row. Other columns
    take no part.

    Digests are counted with map-side sums, and the repeated ones are written as a table: so the join that brings them
    back to their units has two plain sides, and a hot digest can be split by Spark at run time. Blank units have no
    digest: each goes through that join under a key of its own, so they lie in no one place. Units come together per document only, for the running offset.
    """
    gap = len(SEPARATORS[unit]) // 2
    units = unit_table(docs, unit, least_words)
    firsts = (
        units.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count("*").alias("rows"))
        .where("rows > 1")
        .select("digest", "first")
    )
    firsts = written(firsts, "repeated-lines")
    own = F.struct("doc_id", "key", "pos")
    gone = F.col("first").isNotNull() & ~own.eqNullSafe(F.col("first"))
    apart = F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", "key", "pos")), 16, "0"))  # 8 bytes: no digest is equal to it
    told = units.withColumn("digest", F.coalesce("digest", apart)).join(firsts, "digest", "left")
    placed = told.select("doc_id", "key", "pos", "len", gone.alias("gone"))
    placed = placed.groupBy("doc_id", "key", "pos").agg(F.first("len").alias("len"), F.first("gone").alias("gone"))
    before = Window.partitionBy("doc_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.withColumn("start", F.coalesce(F.sum(F.col("len") + gap).over(before), F.lit(0)))
    span = F.when(F.col("gone"), F.struct(F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len")))
    found = offset.groupBy("doc_id", "key").agg(
        F.count("*").alias("n_units"),
        F.count_if("gone").alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("len"))), F.lit(0)).cast("long").alias("chars_removed"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    base = docs.select("doc_id", F.xxhash64("text").alias("key"))
    none = F.array().cast("array<struct<start:bigint,len:bigint>>")
    return base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["key"] == found["_key"]), "left").select(
        "doc_id",
        "key",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_units", "n_removed", "chars_removed")),
        F.coalesce("spans", none).alias("spans"),
    )


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and the text with the spans of ``repeated_units`` cut out of it; null stays null."""
    told = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans").distinct()
    cut = F.expr(
        "CASE WHEN size(spans) = 0 THEN text ELSE concat_ws('', transform(sequence(0, size(spans)), i -> substring(text,"
        " CASE WHEN i = 0 THEN 1 ELSE int(spans[i - 1].start + spans[i - 1].len) + 1 END,"
        " CASE WHEN i = size(spans) THEN length(text) ELSE int(spans[i].start)"
        " - CASE WHEN i = 0 THEN 0 ELSE int(spans[i - 1].start + spans[i - 1].len) END END))) END"
    )
    own = docs.select("doc_id", "text")
    return own.join(told, own["doc_id"].eqNullSafe(told["_id"]) & (F.xxhash64(own["text"]) == told["_key"])).select("doc_id", cut.alias("text"))
