"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.llm.common import send_package, written

#: Words of a shingle, and the least similarity of a pair.
SHINGLE, LEAST = 5, 0.8
#: Each of BANDS keys joins ROWS sketches; a sketch is the PICKS least labelled shingles in text order. A pair of
#: similarity 0.8 shares a key but for (1 - 0.8 ** (PICKS * ROWS)) ** BANDS = 0.00003 of cases.
BANDS, ROWS, PICKS = 20, 2, 2
#: Times that the texts of a bucket meet a centre before the rest is compared.
STARS = 3
#: Buckets of more texts are compared inside tasks, in blocks of this size.
LARGE, BLOCK_TEXTS = 16, 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(20).integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.random.default_rng(21).integers(1, 2**63, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def text_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def shingles(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingles of a sequence of word hashes, in text order; no two are equal.

    Fewer words than a shingle make one of all of them; no words, none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(n, SHINGLE)
    words = words.astype(np.uint64)
    hashes = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        hashes = hashes + words[k : n - width + 1 + k] * _STEPS[k]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    order = np.argsort(hashes, kind="stable")
    equal = np.append(False, np.diff(hashes[order]) == 0)
    if equal.any():
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(equal, 0, at))
        label = np.zeros(len(order), np.uint64)
        label[order] = (at - first).astype(np.uint64)
        hashes = hashes ^ (label * _STEPS[1])
    return hashes


def band_keys(labelled: np.ndarray) -> np.ndarray:
    """The BANDS keys of a document: hashes of its sketches, ROWS at a time."""
    n, count = len(labelled), len(_ORDERS)
    picked = np.empty((count, PICKS), np.int64)
    step = max(1, (1 << 20) // n)
    for k in range(0, count, step):
        own = _ORDERS[k : k + step]
        value = labelled[None, :] * own[:, :1] + own[:, 1:]
        value ^= value >> np.uint64(32)
        rows = np.arange(len(value))
        for p in range(min(PICKS, n)):
            best = value.argmin(axis=1)
            picked[k : k + step, p] = best
            value[rows, best] = np.iinfo(np.uint64).max
        picked[k : k + step, min(PICKS, n) :] = picked[k : k + step, :1]
    picked.sort(axis=1)
    sketch = np.zeros(count, np.uint64)
    for p in range(PICKS):
        sketch = (sketch ^ labelled[picked[:, p]]) * _STEPS[p]
        sketch ^= sketch >> np.uint64(30)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ sketch[r::ROWS]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> float:
    """Shingles aligned in order, over all shingles of either document; below ``least``, any lower value will do.

    Labelled shingles occur once, so the best alignment is the longest increasing run of their common positions.
    Only positions within the band that a similarity of ``least`` leaves are aligned.
    """
    if not len(x) or not len(y) or min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    both, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    total = len(x) + len(y)
    if len(both) < least * (total - len(both)):
        return 0.0
    band = total - 2 * least * total / (1 + least)
    near = np.abs(at_x - at_y) <= band + 1
    run = at_y[near][np.argsort(at_x[near])]
    if (np.diff(run) > 0).all():
        aligned = len(run)
    else:
        tails: list[int] = []
        for v in run.tolist():
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        aligned = len(tails)
    return aligned / (total - aligned)


def sketches(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, key (hash of the text), id (digest of the words), n (shingles), keys."""
    send_package(docs.sparkSession)
    w = docs.select("doc_id", F.xxhash64("text").alias("key"), text_words(F.col("text")).alias("w"))
    sent = w.select("doc_id", "key", F.unhex(F.md5(F.array_join("w", " "))).alias("id"), F.transform("w", lambda x: F.hash(x)).alias("w"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for own in _arrays(batch.column(3)):
                found = shingles(own)
                n.append(len(found))
                keys.append(band_keys(found) if len(found) else np.zeros(0, np.int64))
            new = [pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["doc_id", "key", "id", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sent.mapInArrow(sketched, f"doc_id {kind}, key long, id binary, n int, keys array<long>")


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs(a, b), texts(id, w) -> the pairs whose alignment reaches ``least``."""
    sides = pairs.join(texts.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a"
    )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, x, keep = None, None, []
            names = batch.column(0).to_pylist()
            for name, wa, wb in zip(names, _arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
                if name != last:
                    last, x = name, shingles(wa)
                keep.append(similarity(x, shingles(wb), least) >= least)
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "wa", "wb").mapInArrow(aligned, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> id, comp: the least id that is reached, by spreading minima and jumping along them.

    Every round is a written table; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = written(links.union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        told = labels.select(F.col("id").alias("b"), "comp")
        near = edges.join(told, "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        following = written(low.join(jump, "comp").select("id", "old", F.least("comp", "far").alias("comp")), "labels")
        if following.where("old <> comp").limit(1).count() == 0:
            return following.select("id", "comp")
        labels = following.select("id", "comp")


def near_duplicates(docs: DataFrame, least: float = LEAST, large: int = LARGE, block: int = BLOCK_TEXTS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, key (hash of the text), class_id, class_key, one row per row of ``docs``.

    Similar are documents whose occurrence-labelled shingles of five words align in order to ``least`` of all the
    shingles of both. A class is what such links connect; it is named by its least doc_id (nulls last).

    Equal word sequences are one text from the start (texts without words and nulls too), so thousands of copies are
    one text afterwards. Texts that share a band key are candidates. STARS times every text of a bucket is aligned
    with a centre: the text with the fullest buckets that is not yet in the class of the earlier centre. Texts of one
    bucket that are in different classes even then are all compared: in buckets up to ``large`` as listed pairs, in
    larger ones inside tasks that take two blocks of at most about ``block`` texts and send back links only. There
    is no cap on a bucket, a class or the partners of a text, and pairs within a class are never listed.
    Repeated rows, ties in doc_id and null ids each keep a row; an empty table gives none.
    """
    drawn = written(sketches(docs), "sketches")
    told = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    texts = drawn.groupBy("id").agg(F.min(told).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    spread = texts.select("id", "n", F.posexplode("keys").alias("band", "k"))
    shared = spread.groupBy("k").agg(F.count("*").alias("rows")).where("rows > 1")
    members = written(spread.join(shared, "k").select("k", "band", "id", "n", "rows"), "members")
    weights = members.groupBy("id").agg(F.sum("rows").alias("weight"))
    words = docs.select(text_words(F.col("text")).alias("w"))
    words = words.select(F.unhex(F.md5(F.array_join("w", " "))).alias("id"), F.transform("w", lambda x: F.hash(x)).alias("w"))
    words = written(words.join(weights.select("id"), "id", "left_semi").groupBy("id").agg(F.first("w").alias("w")), "words")
    members = written(members.join(weights, "id"), "members").withColumn("comp", F.col("id"))
    fits = F.least("n", "m") >= least * F.greatest("n", "m")

    def centres(of: DataFrame) -> DataFrame:
        best = of.groupBy("k").agg(F.max(F.struct("weight", "id", "n", "comp")).alias("p"))
        return best.select("k", F.col("p.id").alias("a"), F.col("p.n").alias("m"), F.col("p.comp").alias("pc"))

    def classed(links: DataFrame, of: DataFrame) -> DataFrame:
        return of.drop("comp").join(components(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    tried: list[DataFrame] = []
    links: list[DataFrame] = []

    def tested(pairs: DataFrame) -> None:
        fresh = reduce(lambda x, y: x.join(y, ["a", "b"], "left_anti"), tried, pairs.distinct())
        tried.append(written(fresh, "pairs"))
        links.append(written(verified(tried[-1], words, least), "links"))

    now, open_keys = members, members
    for _ in range(STARS):
        met = now.join(centres(open_keys), "k").where((F.col("comp") != F.col("pc")) & fits)
        tested(met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")))
        now = written(classed(reduce(DataFrame.union, links), members), "classed")
        open_keys = now.join(centres(now), "k").where("comp <> pc").select("k", "id", "n", "weight", "comp")
    several = now.groupBy("k").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("k")
    rest = written(now.join(several, "k"), "rest")
    left = rest.where(f"rows <= {large}").select("k", "id", "n", "comp")
    right = left.select("k", F.col("id").alias("b"), F.col("n").alias("m"), F.col("comp").alias("pc"))
    both = (left["k"] == right["k"]) & (left["id"] < right["b"]) & (left["comp"] != right["pc"]) & fits
    tested(left.join(right, both).select(F.col("id").alias("a"), "b"))
    crowded = rest.where(f"rows > {large}")
    links.append(written(_linked_in_blocks(crowded, words.join(texts.select("id", "keys"), "id"), least, block), "links"))
    comps = components(reduce(DataFrame.union, links))
    named = texts.select("id", "rep").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    head = named.groupBy("comp").agg(F.min("rep").alias("head"))
    named = named.select("id", "comp").join(head, "comp").select("id", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"))
    return drawn.select("id", "doc_id", "key").join(named, "id").select("doc_id", "key", "class_id", "class_key")


def _linked_in_blocks(crowded: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """Links between texts of one crowded bucket and of different classes; each pair meets in its first common band."""
    parts = crowded.groupBy("k").agg(F.expr(f"int((count(*) + {block - 1}) div {block})").alias("parts"))
    own = crowded.join(parts, "k").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = own.select("k", "band", "id", "comp", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    dealt = dealt.select("k", "band", "id", "comp", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def linked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band, lo, hi = int(rows["band"].iloc[0]), key[1], key[2]
        own = [shingles(np.asarray(w)) for w in rows["w"]]
        size = np.array([len(x) for x in own])
        keys = np.array(rows["keys"].tolist())[:, : band + 1]
        comp = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        part, names, found = rows["part"].to_numpy(), rows["id"].to_numpy(), []
        for u in np.flatnonzero(part == lo):
            right = part == hi
            right[: u + 1] &= lo != hi
            right &= (comp != comp[u]) & (np.minimum(size, size[u]) >= least * np.maximum(size, size[u]))
            right &= ~(keys[:, :band] == keys[u, :band]).any(axis=1)
            at = np.flatnonzero(right)
            if not len(at):
                continue
            sorted_u = np.sort(own[u])
            flat = np.concatenate([own[v] for v in at])
            hit = sorted_u[np.minimum(np.searchsorted(sorted_u, flat), len(sorted_u) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(size[at])[:-1]))
            for v in at[common >= least * (size[u] + size[at] - common)]:
                if comp[v] != comp[u] and similarity(own[u], own[v], least) >= least:
                    found.append((min(names[u], names[v]), max(names[u], names[v])))
                    comp[comp == comp[v]] = comp[u]
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.join(texts, "id").groupBy("k", "lo", "hi").applyInPandas(linked, "a binary, b binary")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document (all its columns) of each class of near duplicates: the one that names the class."""
    classes = near_duplicates(docs, least)
    heads = (
        classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .distinct()
    )
    own = docs.withColumn("_text_key", F.xxhash64("text"))
    kept = own.join(heads, own["doc_id"].eqNullSafe(heads["_id"]) & (own["_text_key"] == heads["_key"]), "left_semi")
    repeated = own.groupBy("doc_id", "_text_key").agg(F.count("*").alias("_rows")).where("_rows > 1").limit(1).count()
    if repeated:
        kept = kept.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id", "_text_key").orderBy("doc_id"))).where("_row = 1").drop("_row")
    return kept.drop("_text_key")
