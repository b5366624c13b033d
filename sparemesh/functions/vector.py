"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .attributes import DOMAINS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def domain_slices(vector: Column, width: int) -> dict[str, Column]:
    return {d: F.slice(vector, i * width + 1, width) for i, d in enumerate(DOMAINS)}


def fused(scores: Column) -> Column:
    """Fusion of the domain scores at hand: three quarters of the best plus a quarter of sum / 4."""
    values = F.map_values(scores)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.array_max(values) * 0.75 + (total / 4.0) * 0.25
