"""Vector scores as column expressions (B-01, K-01).

The query vector is a literal array, so scoring needs no join; a zero vector or another dimension gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _fold(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _fold(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance, in [-1, 1]; NULL for a zero vector, a NULL or unequal dimensions."""
    norms = F.sqrt(_fold(a, a)) * F.sqrt(_fold(b, b))
    return F.try_divide(dot(a, b), norms)


def score(a: Column, b: Column, digits: int = 6) -> Column:
    """The cosine rounded, so that ties and comparisons don't hang on the order of additions."""
    return F.round(cosine(a, b), digits)
