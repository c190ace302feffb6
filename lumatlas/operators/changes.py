"""Table changes as logs replayed with one grouped pass: last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATCHABLE = ("user_lat", "user_lon", "user_label", "note", "group_id")


def patch_photos(photos: DataFrame, log: DataFrame, allowed: tuple[str, ...] = PATCHABLE, key: str = "photo_id") -> DataFrame:
    """Apply (key, seq, field, value) writes to allow-listed text fields; a null value clears the field."""
    use = [c for c in allowed if c in photos.columns]
    last = log.filter(F.col("field").isin(*use)).groupBy(key).agg(
        *[F.max(F.when(F.col("field") == c, F.struct("seq", "value"))).alias(f"_{c}") for c in use]
    )
    j = photos.join(last, key, "left")
    for c in use:
        new = F.col(f"_{c}")
        j = j.withColumn(c, F.when(new.isNotNull(), new["value"].cast(photos.schema[c].dataType)).otherwise(F.col(c)))
    return j.drop(*[f"_{c}" for c in use])


def latest_results(log: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, seq, result, error) attempts → status, newest non-null result, newest error."""
    g = log.groupBy(key).agg(
        F.max(F.when(F.col("result").isNotNull(), F.struct("seq", "result"))).alias("r"), F.max(F.struct("seq", "error")).alias("e")
    )
    return g.select(
        key,
        F.when(F.col("e.error").isNotNull(), "error").otherwise("done").alias("status"),
        F.col("r.result").alias("result"),
        F.col("e.error").alias("error"),
    )


def replay_groups(log: DataFrame) -> DataFrame:
    """(group_id, seq, op, name) → live groups with their latest name; a deleted group is gone."""
    g = log.groupBy("group_id").agg(
        F.max_by("op", "seq").alias("op"),
        F.max(F.when(F.col("op") != "delete", F.struct("seq", F.substring("name", 1, 120).alias("name")))).alias("n"),
    )
    return g.filter("op <> 'delete'").select("group_id", F.col("n.name").alias("name"))


def detach_deleted(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """Photos of groups that no longer exist keep no group."""
    live = groups.select("group_id", F.lit(True).alias("_live"))
    return photos.join(live, "group_id", "left").withColumn("group_id", F.when(F.col("_live"), F.col("group_id"))).drop("_live")


def delete_photos(photos: DataFrame, tombstones: DataFrame, key: str = "photo_id") -> DataFrame:
    return photos.join(tombstones.select(key).distinct(), key, "left_anti")


def promote_feedback(feedback: DataFrame, cells: DataFrame) -> DataFrame:
    """Reviewed corrections as index rows with the cell they fall in."""
    from .places import nearest_leaf

    ok = feedback.filter((F.col("status") == "approved") & F.col("embedding").isNotNull())
    return nearest_leaf(ok, cells).select("feedback_id", "embedding", "lat", "lon", "leaf")
