"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words as the text contracts count them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def only(df: DataFrame, **names: str) -> DataFrame:
    """Just the named columns, renamed: extra columns of the input, whatever they are called, cannot clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in names.items()])


_SHIPPED: set[str] = set()
ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application, where PYTHONPATH doesn't already.

    Rows reach Python in batches of ``BATCH_ROWS``, unless the session sets a number itself: texts are long, and Spark's
    usual 10,000 rows would hold tens of megabytes several times over.
    """
    if ROWS not in spark.conf.getAll:
        spark.conf.set(ROWS, BATCH_ROWS)
    package = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    import tempfile
    import zipfile

    archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
