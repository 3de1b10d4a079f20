"""Column helpers for dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 128


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product in DOUBLE; unrolled into generated code where the dimension is known."""
    if dim is not None and dim <= UNROLL_LIMIT:
        total = F.lit(0.0)
        for i in range(dim):
            total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
        return total
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def cosine_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.lit(1.0) - dot(a, b, dim) / (norm(a, dim) * norm(b, dim))
