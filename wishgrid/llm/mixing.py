"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of one source and one size are numbered in parts of about this many rows.
PART_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash32(value: Column) -> Column:
    """The first 32 bits of the md5 as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def _row_key() -> Column:
    """Hash of doc_id, text and source, in which a null is a value."""
    return F.xxhash64(*(c for name in ("doc_id", "text", "source") for c in (F.col(name), F.col(name).isNull())))


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """sizes(source, source_size) -> with target and rate, by water filling.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all sizes by weight; no
    target is above ``cap`` times its source's size, and what is cut is shared again by weight among the others. In
    closed form: sources are filled up in the order of cap to weight while their even share exceeds their cap.
    Sizes of 0 get a target of 0. Works on one row per source, so its unpartitioned windows see sources, not documents.
    """
    size = F.col("source_size")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ordered = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1))
    fill = Window.orderBy(size * cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = (
        fill.rowsBetween(Window.unboundedPreceding, -1),
        fill.rowsBetween(Window.currentRow, Window.unboundedFollowing),
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    level = (F.sum(size).over(whole) * share - F.coalesce(F.sum(size).over(before), F.lit(0)) * cap) / F.sum(
        "weight"
    ).over(after)
    filled = ordered.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < size * cap)
    even = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    target = F.least(size * F.lit(cap), F.coalesce(even * F.col("weight"), size * F.lit(cap)))
    return filled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(size > 0, F.col("target") / size).otherwise(F.lit(0.0))
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, row (its key), source, size, source_size, target, copies.

    Systematic sampling: a document of a source is expected ``target / source_size`` times; these expectations are
    summed along the source, one random offset per source is added, and a copy is emitted for each whole number that
    is crossed. Along the source documents lie by size, so the words taken miss the target by about one document.

    The running sum does not need the source in one task: since documents of one source have one rate, it is the rate
    times the rank, and the rank is the number of rows in all smaller (size, part) cells plus the place in the cell,
    where a part is a slice by hash of the documents of equal size. Cells are counted with map-side sums and never
    grow beyond about ``part_rows`` rows, be a source or a size as frequent as it may.

    Null and empty texts have size 0 and are taken like others; null sources are a source of their own; repeated rows
    are each a document; equal ids in a cell are interchangeable, being of one size. No rows give no rows.
    """
    base = docs.select("doc_id", _row_key().alias("row"), "source", word_count(F.col("text")).alias("size"), _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    counts = base.groupBy("source", "size").agg(F.count("*").alias("rows"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sizes, list(weights), share, cap).withColumn(
        "u", _hash32(F.concat(F.lit(seed), F.coalesce("source", F.lit("\x00")))) / F.lit(4294967296.0)
    )
    parts = counts.select(
        "source", "size", F.expr(f"(rows + {part_rows - 1}) div {part_rows}").alias("parts"), F.col("rows").alias("in_size")
    )
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("smaller", F.coalesce(F.sum("in_size").over(by_size), F.lit(0)))
    told = _join(base, parts, ["source", "size"]).withColumn("part", F.col("h") % F.col("parts"))
    in_part = told.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    by_part = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = in_part.select("source", "size", "part", F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("lower"))
    cell = Window.partitionBy("source", "size", "part").orderBy("h", "doc_id")
    ranked = _join(told.withColumn("place", F.row_number().over(cell)), cells, ["source", "size", "part"])
    ranked = _join(ranked, targets, ["source"]).withColumn("rank", F.col("smaller") + F.col("lower") + F.col("place"))
    copies = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    return ranked.select("doc_id", "row", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(other, [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))


def emit_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it, by the row's key.

    Rows equal in doc_id, text and source have one key; being of one rate, they differ by one copy at most, so their
    copies are shared out evenly again. The number among equal rows and the join need one shuffle by that key.
    """
    copies = mixed.groupBy(F.col("row").alias("_row")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows")).where("_all > 0")
    number = F.row_number().over(Window.partitionBy("_row").orderBy("doc_id"))
    own = docs.withColumn("_row", _row_key()).withColumn("_number", number)
    return (
        own.join(copies, "_row")
        .withColumn("_copies", F.expr("_all div _rows + int(_number <= _all % _rows)"))
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*docs.columns)
    )
