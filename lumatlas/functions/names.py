"""Place names, labels and search-lead rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# Continent names.
CONTINENT_NAMES = {
    "AF": "Africa",
    "AN": "Antarctica",
    "AS": "Asia",
    "EU": "Europe",
    "NA": "North America",
    "OC": "Oceania",
    "SA": "South America",
}

# Order of answer precision, finest last.
RESOLUTION_RANK = {"world": 0, "continent": 1, "country": 2, "region": 3, "city": 4, "street": 5, "exact": 6}
PINNED = ("exact", "street")
NEAR_KM2 = 9.0
CITY_KM2 = 25.0
PEOPLE_REASON = "People are the main subject; precision limited to city level."
PEOPLE_REPORT_SUMMARY = "People are the main subject, so the location is shown at city level only."


def lookup(mapping: dict, key) -> Column:
    """Value of a small fixed mapping, null when absent."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, col(key))


def blank_to_null(c) -> Column:
    return F.when(col(c) != "", col(c))


def joined(parts: list, sep: str = ", ") -> Column:
    """Non-empty parts joined, each distinct part once."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[blank_to_null(p) for p in parts]))), sep)


def display_name(name, admin1, country, distance_km) -> Column:
    label = joined([name, admin1, country])
    d = col(distance_km)
    return (
        F.when(d > 25, F.concat(F.lit("~"), F.bround(d, 0).cast("long").cast("string"), F.lit(" km from "), label))
        .when(d > 3, F.concat(F.lit("Near "), label))
        .otherwise(label)
    )


def name_at_resolution(resolution, display, admin1, country, continent) -> Column:
    r, a, c = col(resolution), col(admin1), col(country)
    return (
        F.when(r.isin("exact", "street", "city"), col(display))
        .when((r == "region") & (a != "") & (a != c), F.concat_ws(", ", a, c))
        .when(r.isin("region", "country"), c)
        .when(r == "continent", col(continent))
        .otherwise(F.lit("Unknown location"))
    )


def continent_label(code) -> Column:
    return F.coalesce(lookup(CONTINENT_NAMES, code), blank_to_null(code), F.lit("Unknown"))


def admin1_label(iso2, admin1) -> Column:
    return F.coalesce(blank_to_null(admin1), col(iso2))


def resolution_rank(resolution) -> Column:
    return F.coalesce(lookup(RESOLUTION_RANK, resolution), F.lit(0))


def fmt_ratio(x) -> Column:
    v = col(x)
    whole, tenth = F.bround(v, 0), F.bround(v, 1)
    return F.concat(F.lit("×"), F.when(v >= 10, F.format_number(whole, 0)).otherwise(F.format_number(tenth, 1)))


def tag_address(tags) -> Column:
    """'name, street number, postcode town' from an address tag map; '' when nothing is known."""
    t = col(tags)

    def g(k: str) -> Column:
        return blank_to_null(F.try_element_at(t, F.lit(k)))

    street = F.concat_ws(" ", g("addr:housenumber"), F.coalesce(g("addr:street"), g("addr:place")))
    town = F.concat_ws(" ", g("addr:postcode"), g("addr:city"))
    return F.array_join(
        F.filter(F.array(F.coalesce(g("name"), F.lit("")), street, town), lambda x: x != ""), ", "
    )


def precision_area_km2(precision, city_km2: float = CITY_KM2) -> Column:
    p = col(precision)
    return F.when(p.isin("exact", "street", "neighborhood"), F.lit(NEAR_KM2)).when(p == "city", F.lit(city_km2))


def search_lead(report, result, people_main, city_km2: float = CITY_KM2, people_policy: str = "coarsen") -> Column:
    """struct(lat, lon, km2) to search around, null when too vague.

    ``report`` has (lat, lon, precision); ``result`` has (lat, lon, resolution, confidence). Photos whose main
    subject is people get no lead unless the policy is switched off.
    """
    rp, rs = col(report), col(result)
    area = precision_area_km2(rp["precision"], city_km2)

    def lead(lat: Column, lon: Column, km2: Column) -> Column:
        return F.struct(lat.alias("lat"), lon.alias("lon"), km2.alias("km2"))

    out = F.when(
        rp["lat"].isNotNull() & rp["lon"].isNotNull() & area.isNotNull(), lead(rp["lat"], rp["lon"], area)
    ).when(
        rs["resolution"].isin("street", "city") & (rs["confidence"] >= 50), lead(rs["lat"], rs["lon"], F.lit(city_km2))
    )
    if people_policy == "coarsen":
        out = F.when(~F.coalesce(col(people_main), F.lit(False)), out)
    return out


def lead_with_same_day(lead, near_lat, near_lon, hours, city_km2: float = CITY_KM2, near_hours: float = 3.0) -> Column:
    """A pinned photo of the same day beats a vague lead; within ``near_hours`` it beats every lead."""
    ld, h = col(lead), col(hours)
    close = h <= near_hours
    take = h.isNotNull() & (ld.isNull() | (ld["km2"] > NEAR_KM2) | close)
    return F.when(
        take,
        F.struct(
            col(near_lat).alias("lat"),
            col(near_lon).alias("lon"),
            F.when(close, F.lit(NEAR_KM2)).otherwise(F.lit(city_km2)).alias("km2"),
        ),
    ).otherwise(ld)
