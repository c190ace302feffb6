"""Answers on their way out: privacy, pins, boxes, GPS answers and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import col
from ..functions.names import PEOPLE_REASON, PEOPLE_REPORT_SUMMARY, PINNED, fmt_ratio

COARSE_RADIUS_KM = 10.0
MIN_CONFIDENCE = 0.5


def coarsen(results: DataFrame, min_radius_km: float = COARSE_RADIUS_KM, policy: str = "coarsen") -> DataFrame:
    """Photos whose main subject is people are shown at city level at best: 0.1° grid, radius of 10 km or more."""
    hide = F.coalesce(F.col("people_main"), F.lit(False)) if policy == "coarsen" else F.lit(False)
    return results.withColumns(
        {
            "lat": F.when(hide, F.bround("lat", 1)).otherwise(F.col("lat")),
            "lon": F.when(hide, F.bround("lon", 1)).otherwise(F.col("lon")),
            "radius_km": F.when(hide, F.greatest(F.col("radius_km"), F.lit(min_radius_km))).otherwise(F.col("radius_km")),
            "resolution": F.when(hide & (F.col("resolution") == "street"), "city").otherwise(F.col("resolution")),
            "coarsened": hide,
            "privacy_reason": F.when(hide, F.lit(PEOPLE_REASON)),
        }
    )


def coarsen_report(reports: DataFrame) -> DataFrame:
    """City level at most for reports about people: no address, no evidence chain, last two parts of the name."""
    fine = ~F.col("precision").isin("city", "region", "country", "unknown")
    hide = F.coalesce(F.col("people_main"), F.lit(False)) & fine
    parts = F.split("place_name", ", ")
    last2 = F.array_join(F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts), ", ")
    new = {
        "lat": F.bround("lat", 1),
        "lon": F.bround("lon", 1),
        "precision": F.lit("city"),
        "address": F.lit(""),
        "place_name": last2,
        "summary": F.lit(PEOPLE_REPORT_SUMMARY),
        "evidence_chain": F.slice("evidence_chain", 1, 0),
    }
    return reports.withColumns({c: F.when(hide, x).otherwise(F.col(c)) for c, x in new.items()})


def report_pinned(precision, lat, lon, confidence) -> Column:
    return (
        col(precision).isin(*PINNED) & col(lat).isNotNull() & col(lon).isNotNull() & (col(confidence) >= MIN_CONFIDENCE)
    )


def report_coords(lat, lon) -> tuple[Column, Column]:
    ok = col(lat).between(-90, 90) & col(lon).between(-180, 180)
    return F.when(ok, col(lat)), F.when(ok, col(lon))


def skyline_answer(status, confidence, lat, lon) -> Column:
    """struct(pinned, confidence, lat, lon): a skyline search pins only a good and confident fit."""
    ok = col(status) == "ok"
    return F.struct(
        (ok & (col(confidence) >= MIN_CONFIDENCE)).alias("pinned"),
        F.bround(col(confidence), 3).alias("confidence"),
        F.when(ok, col(lat)).alias("lat"),
        F.when(ok, col(lon)).alias("lon"),
    )


def valid_box(south, west, north, east) -> Column:
    s, w, n, e = (col(c) for c in (south, west, north, east))
    return (s >= -90) & (s < n) & (n <= 90) & (w >= -180) & (w < e) & (e <= 180)


def area_status(area_km2, cap: float) -> Column:
    return F.when(col(area_km2) > cap, "area_too_large").otherwise("ok")


def gps_results(geocoded: DataFrame) -> DataFrame:
    """Answers for photos that carry a GPS fix: 15 m, 99 %, exact, continent and country as hierarchy."""
    node = lambda level, name, code: F.struct(
        F.lit(level).alias("level"), name.alias("name"), code.alias("code"), F.lit(0.99).alias("probability")
    )
    return geocoded.withColumns(
        {
            "uncertainty_radius_m": F.lit(15.0),
            "confidence": F.lit(99.0),
            "resolution": F.lit("exact"),
            "hierarchy": F.array(
                node("continent", F.col("continent_name"), F.lit("")), node("country", F.col("country"), F.col("place_iso2"))
            ),
        }
    )


def explain(attributions: DataFrame, head: Column) -> DataFrame:
    """(photo_id, explanation): head, the three strongest supporting clues with their ratio, first contradiction.

    ``attributions``: photo_id, key, label, log_ratio, ratio, direction; a photo has at most one row per rule.
    """
    order = W.partitionBy("photo_id", "direction").orderBy(F.round(F.abs("log_ratio"), 9).desc(), "key")
    r = attributions.withColumn("rn", F.row_number().over(order))
    keep = ((F.col("direction") == "supports") & (F.col("rn") <= 3)) | ((F.col("direction") == "contradicts") & (F.col("rn") == 1))
    text = F.concat(F.col("label"), F.lit(" ("), fmt_ratio("ratio"), F.lit(")"))
    g = r.groupBy("photo_id").agg(
        F.array_sort(F.collect_list(F.when(keep & (F.col("direction") == "supports"), F.struct("rn", text.alias("t"))))).alias("pro"),
        F.max(F.when(keep & (F.col("direction") == "contradicts"), F.col("label"))).alias("con"),
    )
    pro = F.array_join(F.transform("pro", lambda p: p["t"]), "; ")
    parts = F.array_compact(
        F.array(
            head,
            F.when(F.size("pro") > 0, F.concat(F.lit("Key evidence: "), pro, F.lit("."))),
            F.when(F.col("con").isNotNull(), F.concat(F.lit("Conflicting: "), F.col("con"), F.lit("."))),
        )
    )
    return g.select("photo_id", F.array_join(parts, " ").alias("explanation"))
