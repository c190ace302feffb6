"""Nearest, range and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places as P
from .q_scalars import r6
from .sqlparts import hav
from .views import query

NEAR = "with d as (select {k}, {s}, {h} as km, {score} as score from {a}, {b}), r as (select *, row_number() over (partition by {k} order by round(score,9), {s}) as rn from d) "


@query(
    "join_reverse_geocode",
    "places countries photos",
    f"""with d as (select photo_id, place_id, p.name, p.admin1, p.iso2, {hav('photos.lat', 'photos.lon', 'p.lat', 'p.lon')} as km, population from photos, places p),
    r as (select *, row_number() over (partition by photo_id order by round(km-2*log10(greatest(population,10.0)),9), place_id) as rn from d)
    select photo_id, place_id, r.name as place_name, iso2, c.name as country, round(km,6)+0.0 as distance_km,
      case when km>25 then concat('~', cast(cast(round_even(km,0) as bigint) as varchar), ' km from ', r.name, ', ', admin1, ', ', c.name)
        when km>3 then concat('Near ', r.name, ', ', admin1, ', ', c.name) else concat(r.name, ', ', admin1, ', ', c.name) end as display_name
    from r join countries c using (iso2) where rn=1""",
)
def _(v):
    g = P.reverse_geocode(v.photos.select("photo_id", "lat", "lon"), v.places, v.countries)
    return g.select(
        "photo_id", "place_id", "place_name", F.col("place_iso2").alias("iso2"), "country", r6(F.col("distance_km")).alias("distance_km"), "display_name"
    )


@query(
    "join_nearest_leaf",
    "cells photos",
    f"""with d as (select photo_id, leaf, {hav('photos.lat', 'photos.lon', 'c.lat', 'c.lon')} as km, scale_km from photos, cells c),
    r as (select *, row_number() over (partition by photo_id order by round(km/scale_km,9), leaf) as rn from d)
    select photo_id, leaf, round(km,6)+0.0 as leaf_km from r where rn=1""",
)
def _(v):
    n = P.nearest_leaf(v.photos.select("photo_id", "lat", "lon"), v.cells)
    return n.select("photo_id", "leaf", r6(F.col("leaf_km")).alias("leaf_km"))


@query(
    "join_nearest_town",
    "places photos",
    f"""with d as (select photo_id, place_id, {hav('photos.lat', 'photos.lon', 'c.lat', 'c.lon')} as km from photos, places c),
    r as (select *, row_number() over (partition by photo_id order by round(km,9), place_id) as rn from d)
    select photo_id, place_id, round(km,6)+0.0 as town_km from r where rn=1""",
)
def _(v):
    n = P.nearest_town(v.photos.select("photo_id", "lat", "lon"), v.places)
    return n.select("photo_id", "place_id", r6(F.col("town_km")).alias("town_km"))
