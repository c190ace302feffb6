"""Scratch folders on the cluster's shared storage, and write-then-read helpers for landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/lumatlas/{name}-{uuid.uuid4().hex}"


def roundtrip_text(df: DataFrame, body: str) -> DataFrame:
    """Write rows whose ``body`` is raw text as JSON lines and read them back with the same declared schema."""
    path = scratch(df.sparkSession, "landed")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path).select(*df.columns)


def roundtrip_documents(df: DataFrame, schema: str, value: str = "body") -> DataFrame:
    """Write one JSON document per row as text lines and read them back through the declared ``schema``."""
    path = scratch(df.sparkSession, "landed")
    df.select(F.col(value)).write.text(path)
    return df.sparkSession.read.schema(schema).json(path)
