"""Clues of many photos → one located, named and privacy-checked answer per photo, as a single lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_at_resolution
from ..operators import evidence as E
from ..operators import fusion as U
from ..operators import places as P
from ..operators import results as S
from ..operators import retrieval as R
from ..operators import textcues as X
from ..operators.cells import CellModel

VLM_WEIGHT = 0.7


@dataclass
class Knowledge:
    """Shared tables: the cell model, the sparse rule table, the rules' regions, places and countries."""

    model: CellModel
    rule_leafs: DataFrame
    rules: DataFrame
    places: DataFrame
    countries: DataFrame


def clue_rows(detections: DataFrame, lines: DataFrame | None, rules: DataFrame) -> DataFrame:
    """One row per photo and rule it hits: photo_id, rule, score, weight."""
    cue = E.best_detection(E.usable_detections(detections, rules)).select("photo_id", F.col("cue").alias("rule"), "score")
    if lines is not None:
        cue = cue.unionByName(X.analyse(lines).select("photo_id", "rule", "score"))
    return cue.withColumn("weight", F.lit(1.0))


def region_points(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Centres of the regions a photo's rules point to."""
    g = rules.filter("size(regions) > 0").select("rule", F.posexplode("regions").alias("pos", "g"))
    return obs.join(F.broadcast(g), "rule").select(
        "photo_id", F.concat(F.lit("cue:"), F.col("rule")).alias("key"), "pos", F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon"),
        (F.col("score") * F.col("g.peak")).alias("weight"), F.col("weight").alias("ev_weight"), F.col("g.sigma_km").alias("sigma_km"),
    )


def answer_points(candidates: DataFrame, weight: float = VLM_WEIGHT) -> DataFrame:
    return candidates.filter("lat is not null and lon is not null").select(
        "photo_id", F.lit("vlm").alias("key"), F.col("rank").alias("pos"), "lat", "lon", F.col("probability").alias("weight"), F.lit(weight).alias("ev_weight"), F.col("radius_km").alias("sigma_km")
    )


def locate(
    photos: DataFrame,
    know: Knowledge,
    detections: DataFrame,
    lines: DataFrame | None = None,
    candidates: DataFrame | None = None,
    people_policy: str = "coarsen",
) -> DataFrame:
    """(photo_id, lat, lon, radius_km, resolution, confidence, place, hierarchy keys, coarsened).

    Clues are reduced to one row per photo and rule before anything is spread over leaves; the only shuffles of the
    fusion bring a photo's clues together. Photos without a clue get the honest prior answer.
    """
    m = know.model
    obs = clue_rows(detections, lines, know.rules).transform(E.by_photo)
    delta = E.sparse_evidence(obs, know.rule_leafs)
    pts = region_points(obs, know.rules)
    if candidates is not None:
        ans = E.answer_evidence(candidates, m.cells)
        base = ans.filter("leaf = -1").select("photo_id", F.col("loglik").alias("base"))
        ans = ans.filter("leaf <> -1").join(base, "photo_id").select(
            "photo_id", "leaf", (F.lit(VLM_WEIGHT) * (F.col("loglik") - F.col("base"))).alias("delta")
        )
        delta = delta.unionByName(ans).groupBy("photo_id", "leaf").agg(F.sum("delta").alias("delta")).transform(E.by_photo)
        pts = pts.unionByName(answer_points(candidates))
    # a photo no clue says anything about keeps the prior: its zero delta touches one leaf without moving it
    idle = photos.select("photo_id").join(delta.select("photo_id").distinct(), "photo_id", "left_anti")
    first = m.cells.agg(F.min("leaf")).scalar()
    delta = delta.unionByName(idle.select("photo_id", first.alias("leaf"), F.lit(0.0).alias("delta")))
    rows = U.photo_rows(U.touched_posterior(delta, m))
    points = R.photo_points(P.nearest_leaf(pts, m.cells)).select("photo_id", "points")
    out = U.locate_rows(rows.join(points, "photo_id", "left"), m)
    out = out.select(
        "photo_id", F.col("out_lat").alias("lat"), F.col("out_lon").alias("lon"), "radius_km", "resolution", "confidence",
        F.col("h_continent_key").alias("continent_key"), F.col("h_iso2_key").alias("country_key"), F.col("h_admin1_key").alias("admin1_key"), F.col("h_leaf_key").alias("leaf_key"),
    )
    out = P.reverse_geocode(out, know.places, know.countries)
    label = name_at_resolution("resolution", "display_name", "place_admin1", "country", "continent_name")
    out = out.withColumn("place", label).join(E.people_main(detections), "photo_id", "left")
    out = S.coarsen(out, policy=people_policy)
    return out.select(
        "photo_id", F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), F.bround("radius_km", 4).alias("radius_km"), "resolution", "confidence", "place",
        "continent_key", "country_key", "admin1_key", "leaf_key", "coarsened", "privacy_reason",
    )
