"""Array-of-number expressions for embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    n = norm(a) + F.lit(1e-12)
    return F.transform(col(a), lambda x: x.cast("double") / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12))
