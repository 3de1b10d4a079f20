"""Vector cache: nearest answer, touching and storing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishgrid.functions.vectors import norm

BLOCK = 16384  # vectors of a block: a task holds one block of either side
LEAST_BLOCKS = 6  # blocks a side is cut into at least, where it has enough vectors, so that all cores have work
STRIPE = 512  # queries of a block multiplied at once
NEAR = 1e-9  # far more than products of unit vectors may differ by the order of their sums


def _unit(df: DataFrame, dim: int) -> DataFrame:
    length = norm(F.col("embedding"), dim)
    return df.withColumn("_n", length).where("_n > 0").withColumn(
        "u", F.expr(f"transform(slice(embedding, 1, {dim}), x -> cast(x as double) / _n)")
    ).drop("_n", "embedding")


def _blocks(rows: int) -> int:
    return max(math.ceil(rows / BLOCK), min(LEAST_BLOCKS, math.ceil(rows / STRIPE)), 1)


def semantic_lookup(queries: DataFrame, cache: DataFrame, threshold: float, dim: int) -> DataFrame:
    """the nearest cached vector of every query by cosine distance, kept if <= ``threshold``.

    ``queries(query_id, embedding)``, ``cache(id, embedding)``; ties go to the least id. Exact. In so many dimensions no
    bound on distances spares a pair, so every query meets every cached vector (equal ones once): both sides are cut into
    blocks, each pair of blocks is a matrix product in one task, and what comes within ``NEAR`` of a query's best there
    is measured again, component by component. A block sends back at most one row a query.
    """
    stored = _unit(cache.select("id", "embedding"), dim).where("not exists(u, x -> isnan(x))").groupBy("u").agg(F.min("id").alias("id"))
    asked = _unit(queries.select("query_id", "embedding"), dim).where("not exists(u, x -> isnan(x))")
    n_asked, n_stored = _blocks(asked.count()), _blocks(stored.count())

    def dealt(df: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        at = F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other)
        return df.select(key, "u", at).select("*", every).groupBy("qb", "cb")

    def nearest(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        def matrix(table: pa.Table) -> np.ndarray:
            return table["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

        if not left.num_rows or not right.num_rows:
            return
        q, c = matrix(left), matrix(right)
        ids = right["id"].combine_chunks()
        order = ids.to_numpy(zero_copy_only=False).argsort(kind="stable")
        c, ids = c[order], ids.take(pa.array(order))
        for start in range(0, len(q), STRIPE):
            part = q[start : start + STRIPE]
            product = part @ c.T
            least = np.maximum(product.max(axis=1), 1.0 - threshold) - NEAR
            row, col = np.nonzero(product >= least[:, None])
            total = np.zeros(len(row))
            for i in range(dim):  # the order of the sum is that of the plain formula
                total += part[row, i] * c[col, i]
            dist = 1.0 - total
            best = np.lexsort((col, dist, row))
            best = best[np.unique(row[best], return_index=True)[1]]
            best = best[dist[best] <= threshold]
            yield pa.record_batch(
                [left["query_id"].combine_chunks().take(pa.array(start + row[best])), ids.take(pa.array(col[best])), pa.array(dist[best])],
                ["query_id", "id", "dist"],
            )

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(nearest(left, right), pa.schema([left.schema.field("query_id"), right.schema.field("id"), ("dist", pa.float64())]))

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, dist double"
    pairs = (
        dealt(asked, "query_id", "qb", n_asked, "cb", n_stored)
        .cogroup(dealt(stored, "id", "cb", n_stored, "qb", n_asked))
        .applyInArrow(found, kinds)
    )
    best = pairs.groupBy("query_id").agg(F.min(F.struct("dist", "id")).alias("b"))
    return best.select("query_id", "b.id", "b.dist")


def touch_cache(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """count the hits and move the time of last use. ``hits(id, used_at)``."""
    used = hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("used_at").alias("used_at"))
    return (
        cache.join(used, "id", "left")
        .withColumn("hit_count", F.col("hit_count") + F.coalesce("n", F.lit(0)))
        .withColumn("last_used_at", F.coalesce("used_at", "last_used_at"))
        .select(*cache.columns)
    )


def store_cache(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """append; equal signatures are kept side by side."""
    return cache.unionByName(answers, allowMissingColumns=True)
