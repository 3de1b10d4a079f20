"""Benchmark decontamination by windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishgrid.llm.common import lower_ascii, written

WINDOW = 13
#: Distinct benchmark windows up to this number go into the tasks as a hash set; more are met by a shuffled join.
SET_WINDOWS = 200_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the lower-cased (A-Z) text; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SPLIT), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """benchmark(item_id, text) -> len, gram, hash, items (ids as strings). Items without words have no window."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    grams = item.withColumn("len", F.least(F.size("w"), F.lit(window))).select(
        "item", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> slice(w, i, len))")).alias("g")
    )
    return (
        grams.groupBy("len", F.array_join("g", " ").alias("gram"))
        .agg(F.array_compact(F.collect_set("item")).alias("items"), F.first(F.xxhash64("g")).alias("hash"))
    )


def _seed(length: int) -> tuple[int, int]:
    """Any run of ``length`` words holds, on a grid of this stride, one whole seed of this many words."""
    seed = (length + 1) // 2
    return seed, length - seed + 1


def _found(length: int, seeds: list[int], hashes: list[int]) -> str:
    """SQL text: first words (from 1) where a window may start; every position is hashed only behind a found seed."""
    seed, stride = _seed(length)
    grid = f"exists(sequence(1, size(w) - {seed - 1}, {stride}), i -> xxhash64(slice(w, i, {seed})) IN ({_longs(seeds)}))"
    every = f"filter(sequence(1, size(w) - {length - 1}), i -> xxhash64(slice(w, i, {length})) IN ({_longs(hashes)}))"
    hit = f"struct(i AS at, {length} AS len, array_join(slice(w, i, {length}), ' ') AS gram)"
    return f"CASE WHEN size(w) >= {length} THEN CASE WHEN {grid} THEN transform({every}, i -> {hit}) END END"


def _longs(values: list[int]) -> str:
    return ", ".join("(-9223372036854775807L - 1L)" if v == -(2**63) else f"{v}L" for v in sorted(values))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> doc_id, key, n_words, spans, n_hit, items.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer. ``spans`` lists the windows
    found (first word from 1, number of words), ``n_hit`` the words inside any of them, ``items`` the ids (as strings)
    whose windows occur. ``key`` is a hash of the text. One row per row of ``docs``; a repeated row is judged like its
    twin. Null or empty texts have no words; an empty benchmark finds nothing; null item ids are hit but not listed.

    The benchmark is bounded and counted first. Its windows go to the tasks as a hash set of 64-bit hashes, each
    document is scanned where it lies (no shuffle of texts) and hits are verified on the words by a join. A scan
    looks at seeds of half a window on a grid first, since every window holds one of them whole, and hashes all
    positions only of documents with a seed. Beyond ``set_windows`` windows all positions are joined by hash instead.
    """
    grams = written(item_windows(benchmark, window), "grams")
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    head = [F.col("doc_id"), F.col("key"), F.size("w").alias("n_words")]
    if grams.limit(set_windows + 1).count() <= set_windows:
        hashes: dict[int, list[int]] = {r.len: r.h for r in grams.groupBy("len").agg(F.collect_set("hash").alias("h")).collect()}
        tests = []
        for length in sorted(hashes):
            seed, _ = _seed(length)
            parts = f"transform(sequence(1, {length - seed + 1}), i -> xxhash64(slice(split(gram, ' '), i, {seed})))"
            seeds = grams.where(f"len = {length}").select(F.explode(F.expr(parts)).alias("h")).distinct().collect()
            tests.append(F.expr(_found(length, [r.h for r in seeds], hashes[length])))
        none = F.array().cast("array<struct<at:int,len:int,gram:string>>")
        found = F.flatten(F.array(*(F.coalesce(t, none) for t in tests))) if tests else none
        scanned = written(base.select(*head, found.alias("found")), "scanned")
        hits = scanned.select("doc_id", "key", F.explode("found").alias("f")).select("doc_id", "key", "f.*")
        broadcast = F.broadcast(grams.select("len", "gram", "items"))
    else:
        scanned = written(base.select(*head), "scanned")
        lengths = F.array(*(F.lit(r.len) for r in grams.select("len").distinct().collect()))
        hits = (
            base.select("doc_id", "key", "w", F.explode(lengths).alias("len"))
            .where("size(w) >= len")
            .select("doc_id", "key", "len", F.posexplode(F.expr("transform(sequence(1, size(w) - len + 1), i -> array_join(slice(w, i, len), ' '))")).alias("at", "gram"))
            .withColumn("at", F.col("at") + 1)
        )
        broadcast = grams.select("len", "gram", "items")
    verified = hits.join(broadcast, ["len", "gram"]).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.expr(
        "aggregate(spans, struct(0 AS n, 0 AS end), (a, s) -> struct("
        "a.n + greatest(0, s.at + s.len - 1 - greatest(a.end, s.at - 1)) AS n, greatest(a.end, s.at + s.len - 1) AS end)).n"
    )
    verified = verified.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "items", covered.alias("n_hit"))
    at = scanned["doc_id"].eqNullSafe(verified["_id"]) & (scanned["key"] == verified["_key"])
    return scanned.join(verified, at, "left").select(
        scanned["doc_id"],
        scanned["key"],
        F.col("n_words").cast("long").alias("n_words"),
        "spans",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """Hit at all, and in one of twenty words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (all their columns) that are not contaminated; what goes is named by (doc_id, hash of the text)."""
    bad = contamination(docs, benchmark).where(contaminated()).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key and the words of each document that lie in no found window, joined by one space (spans removed)."""
    found = contamination(docs, benchmark, window)
    told = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans").distinct()
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    kept = F.expr("filter(w, (x, i) -> NOT exists(coalesce(spans, array()), s -> i + 1 >= s.at AND i + 1 < s.at + s.len))")
    return base.join(told, base["doc_id"].eqNullSafe(told["_id"]) & (base["key"] == told["_key"]), "left").select("doc_id", "key", F.array_join(kept, " ").alias("text"))
