"""Reverse geocoding and cell lookup on top of the exact nearest join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .spatial import auto_tile_deg, competing, nearest, nearest_index

TOWN_BIAS_KM = 2.0


def town_bias(population) -> Column:
    """Bigger towns win when distances are close: 2 km per power of ten of population."""
    return F.lit(TOWN_BIAS_KM) * F.log10(F.greatest(F.col(population), F.lit(10.0)))


def town_index(places: DataFrame, tile_deg: float = 1.0, biased: bool = True) -> DataFrame:
    p = places.withColumn("_bias", town_bias("population") if biased else F.lit(0.0))
    return nearest_index(p, "place_id", "_bias", tile_deg=tile_deg)


def town_tile_deg(places: DataFrame, biased: bool = True) -> float:
    """Tile size by the towns that can win, however many share a place."""
    return auto_tile_deg(competing(places, "place_id", town_bias("population") if biased else 0.0).count())


def cell_index(cells: DataFrame, tile_deg: float = 1.0) -> DataFrame:
    return nearest_index(cells, "leaf", "scale_km", scaled=True, tile_deg=tile_deg)


def cell_tile_deg(cells: DataFrame) -> float:
    return auto_tile_deg(competing(cells, "leaf", "scale_km", scaled=True).count())


def with_country(df: DataFrame, countries: DataFrame, code: str = "iso2") -> DataFrame:
    """Country name, continent and driving side; an unknown code stands for itself and drives on the right."""
    c = countries.select(
        F.col("iso2").alias(code),
        F.col("name").alias("country"),
        F.col("continent").alias("country_continent"),
        F.col("drives_on").alias("country_drives_on"),
    )
    out = df.join(F.broadcast(c), code, "left")  # a few hundred codes exist
    return (
        out.withColumn("country", F.coalesce("country", F.col(code)))
        .withColumn("country_continent", F.coalesce("country_continent", F.lit("")))
        .withColumn("country_drives_on", F.coalesce("country_drives_on", F.lit("R")))
    )


def reverse_geocode(
    photos: DataFrame,
    places: DataFrame,
    countries: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    tile_deg: float | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Adds place_id, name, admin1, iso2, country, continent, distance_km and display_name of the best town.

    Pass ``index`` (with the ``tile_deg`` it was built for) to reuse a stored tile index.
    """
    tile_deg = tile_deg or town_tile_deg(places)
    ix = town_index(places, tile_deg) if index is None else index
    hit = nearest(photos, ix, lat, lon, tile_deg=tile_deg, id_name="place_id")
    attrs = places.select(
        "place_id", F.col("name").alias("place_name"), F.col("admin1").alias("place_admin1"), F.col("iso2").alias("place_iso2")
    )
    out = with_country(hit.join(attrs, "place_id", "left"), countries, "place_iso2")
    return (
        out.withColumn("continent_name", names.continent_label("country_continent"))
        .withColumn("display_name", names.display_name("place_name", "place_admin1", "country", "distance_km"))
        .drop("country_drives_on", "country_continent")
    )


def nearest_leaf(points: DataFrame, cells: DataFrame, lat="lat", lon="lon", tile_deg: float | None = None) -> DataFrame:
    """Adds the containing leaf: smallest distance relative to the cell's own size."""
    tile_deg = tile_deg or cell_tile_deg(cells)
    return nearest(
        points, cell_index(cells, tile_deg), lat, lon, scaled=True, tile_deg=tile_deg, id_name="leaf", distance_name="leaf_km"
    )


def nearest_town(points: DataFrame, places: DataFrame, lat="lat", lon="lon", tile_deg: float | None = None) -> DataFrame:
    tile_deg = tile_deg or town_tile_deg(places, biased=False)
    return nearest(
        points, town_index(places, tile_deg, biased=False), lat, lon, tile_deg=tile_deg, id_name="place_id", distance_name="town_km"
    )
