"""Compute once, use often inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **cols: Column) -> DataFrame:
    """Like ``withColumns``, but the values are fixed before later expressions read them.

    A plain projection may be folded into the lambda that uses it and then be evaluated once per array element; the
    one-row generator keeps it apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
