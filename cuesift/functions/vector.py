"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, tiny: float = 1e-9) -> Column:
    """Cosine; 0 where a vector is shorter than ``tiny``."""
    return F.when((norm(a) < tiny) | (norm(b) < tiny), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(doubles(a), lambda x: x / n)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def affine_score(product: Column) -> Column:
    """A dot product of unit vectors as a score: (x + 1) / 2 within 0 and 1."""
    return clip01((product + 1) / 2)
