"""Vector operators that need a matrix product: Spark partitions the rows, each task multiplies Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def random_projection(df: DataFrame, column: str, in_dim: int, dim: int, seed: int = 7) -> DataFrame:
    """Seeded random projection of ``column``, L2-normalised; other columns are kept."""
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != column] + [T.StructField("projected", T.ArrayType(T.DoubleType()))]
    )

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = np.random.default_rng(seed).standard_normal((in_dim, dim))
        for pdf in batches:
            if not len(pdf):
                continue
            out = np.stack(pdf[column].to_numpy()).astype(np.float64) @ matrix
            out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-12
            yield pdf.drop(columns=[column]).assign(projected=list(out))

    return df.mapInPandas(project, schema)
