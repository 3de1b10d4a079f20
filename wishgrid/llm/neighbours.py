"""Approximate nearest neighbours: inverted lists scanned by adaptive numbers of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.llm.common import send_package, written

#: Vectors (chosen by hash) on which lists are fitted, lists at most, and vectors a list aims at.
FIT_ROWS, MOST_LISTS, LIST_ROWS = 20_000, 1024, 400
#: Lists probed by a query, at least and as a share of all lists.
LEAST_PROBES, PROBE_SHARE = 24, 0.6
#: Dimensions of a column block, and how sure a test must be to abandon a candidate (in standard deviations).
COLUMNS, EPSILON = 16, 2.1
#: Vectors and queries that meet in one scan.
PART_ROWS, PART_QUERIES = 4096, 1024


def distinct_vectors(table: DataFrame, most: int) -> DataFrame:
    """vec_id, embedding -> v (doubles as bytes), ids: equal vectors once, with their ``most`` least ids in order.

    Left out: null ids, null or zero vectors, and those with null or non-finite components. A vector on a third of all
    rows is cut to ``most`` rows in each task before the shuffle, which is all that its ``most - 1`` nearest can need.
    """
    e = F.col("e")
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(sound)
    rows = rows.select("vec_id", F.transform("e", lambda x: x + F.lit(0.0)).alias("e"))  # -0.0 as 0.0
    least = F.dense_rank().over(Window.partitionBy("e").orderBy("vec_id"))
    return rows.withColumn("rank", least).where(F.col("rank") <= most).groupBy("e").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


class Index:
    """Centroids of the lists and the rotation, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        centre = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
        for _ in range(12):
            own = (sample @ centre.T).argmax(axis=1)
            for k in range(len(centre)):
                rows = sample[own == k]
                if len(rows):
                    mean = rows.mean(axis=0)
                    centre[k] = mean / max(np.linalg.norm(mean), 1e-12)
        self.centre = centre

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        near = unit @ self.centre.T
        probes = min(probes, near.shape[1])
        return np.argpartition(-near, probes - 1, axis=1)[:, :probes]


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    v = v / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def scan(index: Index, own: np.ndarray, queries: np.ndarray, least_ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows of ``own`` that can be its ``k`` nearest of this part, by adaptive dimension scan.

    Unit vectors are rotated, so the distance over the first d of D dimensions, times D / d, estimates the whole. All
    candidates are read one column block after the other; where the estimate is above the bound by more than the
    test allows, a candidate is abandoned. The bound is the k-th least whole distance found so far: first of the
    candidates that look best after one block. What is left is taken with a little slack for rounding.
    """
    x = (_unit(own) @ index.rotation).astype(np.float32)
    q = (_unit(queries) @ index.rotation).astype(np.float32)
    blocks = [np.ascontiguousarray(x[:, c : c + COLUMNS]) for c in range(0, index.dim, COLUMNS)]
    head, width = blocks[0], blocks[0].shape[1]
    partial = np.maximum((head * head).sum(axis=1)[None, :] + (q[:, :width] ** 2).sum(axis=1)[:, None] - 2 * q[:, :width] @ head.T, 0)
    out = []
    for row in range(len(q)):
        dist = partial[row]
        look = np.argpartition(dist, min(4 * k, len(dist)) - 1)[: 4 * k]
        whole = ((x[look] - q[row]) ** 2).sum(axis=1)
        bound = np.partition(whole, min(k, len(whole)) - 1)[min(k, len(whole)) - 1] if len(whole) >= k else np.inf
        alive = np.arange(len(x))
        seen = width
        for block, first in zip(blocks[1:], range(COLUMNS, index.dim, COLUMNS), strict=True):
            keep = dist * (index.dim / seen) <= bound * (1 + EPSILON / np.sqrt(seen)) ** 2 + 1e-5
            alive, dist = alive[keep], dist[keep]
            dist = dist + ((block[alive] - q[row, first : first + block.shape[1]]) ** 2).sum(axis=1)
            seen += block.shape[1]
        if len(alive) > k:
            alive = alive[dist <= np.partition(dist, k - 1)[k - 1] + 1e-4]
        out.append(alive)
    return out


def nearest_neighbours(table: DataFrame, k: int = 5, every: int = 50, least_probes: int = LEAST_PROBES, probe_share: float = PROBE_SHARE) -> DataFrame:
    """embeddings(vec_id, embedding) -> query_id, rank, vec_id, score: the ``k`` nearest found by cosine.

    Queries are the rows whose vec_id is divisible by ``every``; all rows but those of the query's own id are
    candidates. Nearest first, ties to the smaller id; fewer rows if there are fewer candidates. Scores are cosines
    in double precision of the original vectors. See ``distinct_vectors`` for rows that take no part; so do vectors
    of another length than the most frequent (of equally frequent ones the greatest). Repeated rows count once.

    Equal vectors are searched once, as candidates and as queries, with their least ids. The lists are fitted on at
    most about FIT_ROWS vectors; all are indexed. A list meets its queries in parts of bounded size on both sides,
    so neither a crowded list nor one that many queries probe lands in one task; a part sends at most k + 1 rows a
    query.
    """
    spark = table.sparkSession
    send_package(spark)
    vectors = written(distinct_vectors(table, k + 1), "vectors")
    lengths = vectors.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()  # a row per length
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    dim, total = max(((r.n, r.d) for r in lengths))[::-1]
    vectors = vectors.where(F.size("e") == dim)
    share = min(1.0, FIT_ROWS / total)
    sample = vectors.where(F.pmod(F.xxhash64("e"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("e")
    drawn = np.array([r.e for r in sample.collect()]).reshape(-1, dim)  # about FIT_ROWS at most
    if not len(drawn):
        drawn = np.array([r.e for r in vectors.limit(1).collect()])
    lists = max(1, min(MOST_LISTS, total // LIST_ROWS, len(drawn)))
    probes = min(lists, max(least_probes, round(lists * probe_share)))
    sent = spark.sparkContext.broadcast(Index(_unit(drawn), lists))

    def assigned(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                    cells = sent.value.nearest(_unit(v), count)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], ["e", "ids", "cells"])

        return run

    kinds = "e array<double>, ids array<long>, cells array<int>"
    placed = written(vectors.select("e", F.col("ids").cast("array<long>").alias("ids")).mapInArrow(assigned(1), kinds).select("e", "ids", F.col("cells")[0].alias("cell")), "placed")
    asks = table.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e")).distinct()
    asks = asks.join(vectors.select("e"), "e")
    asked = written(asks.groupBy("e").agg(F.min("query_id").alias("q"), F.array().cast("array<long>").alias("ids")), "asked")
    probing = written(asked.select("e", "ids").mapInArrow(assigned(probes), kinds).select("e", F.explode("cells").alias("cell")), "probing")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows")).join(probing.groupBy("cell").agg(F.count("*").alias("asks")), "cell")
    parts = F.broadcast(  # at most MOST_LISTS rows
        sizes.select("cell", F.expr(f"int((rows + {PART_ROWS - 1}) div {PART_ROWS})").alias("ps"), F.expr(f"int((asks + {PART_QUERIES - 1}) div {PART_QUERIES})").alias("qs"))
    )
    own = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("e"), "ps").cast("int").alias("p"), F.explode(F.expr("sequence(0, qs - 1)")).alias("q"), "e", "ids")
    ask = probing.join(parts, "cell").select("cell", F.explode(F.expr("sequence(0, ps - 1)")).alias("p"), F.pmod(F.xxhash64("e"), "qs").cast("int").alias("q"), "e")

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["e", "score", "low", "ids"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        x, q, ids = np.array(left["e"].tolist()), np.array(right["e"].tolist()), left["ids"].to_numpy()
        low = np.array([i[0] for i in ids])
        size, rows = np.sqrt((x * x).sum(axis=1)), []
        for ask, alive in zip(q, scan(sent.value, x, q, low, k + 1), strict=True):
            score = (x[alive] @ ask) / (size[alive] * np.sqrt((ask * ask).sum()))
            best = np.lexsort((low[alive], -score))[: k + 1]
            rows += [(ask, score[b], low[alive[b]], ids[alive[b]]) for b in best]
        return pd.DataFrame(rows, columns=columns)

    keys = ["cell", "p", "q"]
    found = own.groupBy(keys).cogroup(ask.groupBy(keys)).applyInPandas(searched, "e array<double>, score double, low long, ids array<long>")
    best = Window.partitionBy("e").orderBy(F.desc("score"), "low")
    top = found.withColumn("place", F.row_number().over(best)).where(f"place <= {k + 1}")
    rows = asks.join(top, "e").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(nearest)).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
