"""Batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import hilbert

INDEX_BUCKETS = 64
#: Bytes of a row group: small enough that a box meets few others.
ROW_GROUP = 16 << 20


def by_place(rows: DataFrame, folders: list[str] | None = None, parts: int | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows in ranges along a Hilbert curve, within ``folders`` first, and in its order inside a range.

    Written so, a row group covers a small area, and the bounds that Parquet keeps of it let a box skip nearly all others. Ranges
    are cut by a sample of the rows, so one popular area becomes many.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_h", hilbert(lat, lon))
    order = [*(folders or []), "_h"]
    return keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_h")


def write_index(photos: DataFrame, cells: DataFrame, path: str, mode: str = "append") -> None:
    """Retrieval index rows {vec_id, embedding, lat, lon, leaf}, in folders by leaf bucket.

    Within a folder rows lie along a Hilbert curve (:func:`by_place`), so a box reads few row groups.
    """
    from ..operators.places import nearest_leaf

    placed = nearest_leaf(photos, cells).drop("leaf_km").withColumn("leaf_bucket", F.pmod("leaf", F.lit(INDEX_BUCKETS)))
    by_place(placed, ["leaf_bucket"]).write.mode(mode).option("parquet.block.size", ROW_GROUP).partitionBy("leaf_bucket").parquet(path)


def write_cells(cells: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cell table with its prior; a small dimension, one file per task is enough."""
    cells.write.mode(mode).parquet(path)


def write_view_index(views: DataFrame, path: str, mode: str = "append") -> None:
    """Viewpoints with panoramas (float32), one folder per region, in it along a Hilbert curve."""
    v = views.withColumn("pano", F.col("pano").cast("array<float>"))
    by_place(v, ["region"]).write.mode(mode).option("parquet.block.size", ROW_GROUP).partitionBy("region").parquet(path)


def region_boxes(views: DataFrame) -> DataFrame:
    return views.groupBy("region").agg(
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"), F.count("*").alias("viewpoints")
    )
