"""Sources and sinks: each derived view is written in the source's own format and read back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cellbuild as B
from ..sources import listings as L
from ..sources import sinks
from ..sources import tables as T
from ..sources.files import roundtrip_documents, roundtrip_text, scratch
from .q_scalars import r6
from .sqlparts import hav
from .views import query


def _csv(df, name, **opt):
    path = scratch(df.sparkSession, name)
    df.write.options(header=True, **opt).csv(path)
    return path


@query("src_countries", "countries", "select iso2, name, continent, drives_on from countries")
def _(v):
    return T.read_countries(v.spark, _csv(v.countries.select("iso2", "name", "continent", "drives_on"), "countries"))


@query(
    "src_places",
    "places",
    "select name, iso2, '' as admin1, lat, lon, case when place_id%4=0 then 0 else population end as population from places",
)
def _(v):
    p = v.places.select("population", "name", "iso2", "lat", "lon", "place_id").withColumn("population", F.when(F.col("place_id") % 4 != 0, F.col("population")))
    return T.read_places(v.spark, _csv(p.drop("place_id"), "places"))


@query(
    "src_geonames",
    "places countries",
    """select 'place' as kind, p.name, p.iso2, case when place_id%5=0 then '' else concat('Region ', admin1) end as extra, population as value from places p
    union all select 'country', name, iso2, 'R', 0 from countries""",
)
def _(v):
    tab = F.lit("\t")
    blank = F.lit("")
    code = F.when(F.col("place_id") % 5 == 0, "none").otherwise(F.col("admin1"))
    cols = [F.col("place_id").cast("string"), F.col("name"), F.col("name"), blank, F.col("lat").cast("string"), F.col("lon").cast("string"), blank, blank, F.col("iso2"), blank, code, blank, blank, blank, F.col("population").cast("bigint").cast("string")]
    folder = scratch(v.spark, "geonames")
    v.places.select(F.concat_ws("\t", *cols).alias("value")).write.text(folder + "/cities")
    v.places.select("iso2", "admin1").distinct().select(F.concat(F.concat_ws(".", "iso2", "admin1"), tab, F.lit("Region "), F.col("admin1"), tab, blank).alias("value")).write.text(folder + "/admin1")
    info = v.countries.select(F.concat_ws("\t", "iso2", blank, blank, blank, "name", blank, blank, blank, "continent").alias("value"))
    info.unionByName(v.countries.limit(1).select(F.lit("# header line").alias("value"))).write.text(folder + "/info")
    places, countries = T.read_geonames(v.spark, folder + "/cities", folder + "/admin1", folder + "/info")
    a = places.select(F.lit("place").alias("kind"), "name", "iso2", F.col("admin1").alias("extra"), F.col("population").alias("value"))
    b = countries.select(F.lit("country").alias("kind"), "name", "iso2", F.col("drives_on").alias("extra"), F.lit(0.0).alias("value"))
    return a.unionByName(b)


@query(
    "join_admin1_name",
    "places",
    "select place_id, case when place_id%5=0 then '' else concat('Region ', admin1) end as admin1_name from places",
)
def _(v):
    c = v.places.select("place_id", "iso2", F.when(F.col("place_id") % 5 == 0, "none").otherwise(F.col("admin1")).alias("admin1_code"))
    a = v.places.select("iso2", "admin1").distinct().select(F.concat_ws(".", "iso2", "admin1").alias("code"), F.concat(F.lit("Region "), F.col("admin1")).alias("admin1_name"))
    return T.with_admin1_name(c, a).select("place_id", F.col("admin1").alias("admin1_name"))


@query(
    "src_cue_rules",
    "countries",
    """select concat('cue_', iso2) as rule, concat('Sign of ', name) as label, iso2, 12.0e0 as lr, 0.2e0 as other from countries""",
)
def _(v):
    entry = F.struct(F.concat(F.lit("Sign of "), F.col("name")).alias("label"), F.lit("road").alias("kind"), F.create_map(F.col("iso2"), F.lit(12.0)).alias("countries"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("cue_"), F.col("iso2")), entry)))
    path = scratch(v.spark, "rules")
    # the rule file is one small document: one entry per country
    v.countries.agg(F.to_json(F.struct(F.lit(1).alias("version"), pairs.alias("cues"))).alias("value")).coalesce(1).write.text(path)
    r = T.read_cue_rules(v.spark, path)
    return r.select("rule", "label", F.explode("countries").alias("iso2", "lr"), "other")


@query("src_manifest", "photos", "select concat('img/', cast(photo_id as varchar), '.jpg') as file, lat, lon from photos")
def _(v):
    m = v.photos.select(F.concat(F.lit("img/"), F.col("photo_id").cast("string"), F.lit(".jpg")).alias("path"), "lat", "lon")
    path = _csv(m, "manifest")
    d = T.read_manifest(v.spark, path)
    return d.select(F.substring_index("path", "/", -2).alias("file"), "lat", "lon")


@query("src_coords", "photos", "select lat, lon from photos")
def _(v):
    return T.read_coords(v.spark, _csv(v.photos.select("lat", "lon"), "coords"))


IMG = "st as (select c_custkey as k, 48.84::double+((c_custkey*37)%200)*0.0001::double as lat, 2.33::double+((c_custkey*53)%240)*0.0001::double as lon, cast((c_custkey*71)%360 as double) as heading from customer)"


def _images(v):
    return v.street_images.select(F.col("image_id").alias("k"), "lat", "lon", "heading")


def _pages(df, item, field):
    """Group rows into pages of a hundred, each one JSON document."""
    pages = df.groupBy(F.floor(F.col("k") / 100).alias("page")).agg(F.collect_list(item).alias(field))
    return pages.select(F.to_json(F.struct(field)).alias("body"))


@query(
    "src_street_graph",
    "",
    f"""with {IMG} select cast(k as varchar) as image_id, round(lat,6) as lat, round(lon,6) as lon, case when k%7=0 then 0 else heading end as heading, case when k%5=0 then '' else strftime(make_timestamp((1577836800+k*86400)*1000000), '%Y-%m-%d') end as captured_at,
      case when k%3=0 then concat('t',cast(k as varchar)) else concat('f',cast(k as varchar)) end as full_url from st where k%11<>0 and k%13<>0""",
)
def _(v):
    k, ks = F.col("k"), F.col("k").cast("string")
    item = F.struct(
        ks.alias("id"),
        F.when(k % 11 != 0, F.struct(F.array("lon", "lat").alias("coordinates"))).alias("computed_geometry"),
        F.when(k % 7 != 0, F.col("heading")).alias("compass_angle"),
        F.when(k % 5 != 0, ((F.lit(1577836800) + k * 86400) * 1000).cast("string")).alias("captured_at"),
        F.when(k % 13 != 0, F.concat(F.lit("t"), ks)).alias("thumb_256_url"),
        F.when(k % 3 != 0, F.concat(F.lit("f"), ks)).alias("thumb_1024_url"),
    )
    g = L.street_graph(roundtrip_documents(_pages(_images(v), item, "data"), L.GRAPH))
    return g.select("image_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "heading", "captured_at", "full_url")


@query(
    "src_street_stac",
    "",
    f"""with {IMG} select concat('pnx:', cast(k as varchar)) as image_id, round(lat,6) as lat, round(lon,6) as lon, case when k%7=0 then 0 else heading end as heading, case when k%5=0 then '' else '2023-06-01' end as captured_at,
      concat(case when k%3=0 then 'sd' when k%3=1 then 'hd' else 't' end, cast(k as varchar)) as full_url from st where k%11<>0 and k%13<>0""",
)
def _(v):
    k, ks = F.col("k"), F.col("k").cast("string")

    def href(name, cond):
        return F.when(cond, F.struct(F.concat(F.lit(name), ks).alias("href")))

    item = F.struct(
        ks.alias("id"),
        F.when(k % 11 != 0, F.struct(F.array("lon", "lat").alias("coordinates"))).alias("geometry"),
        F.struct(F.when(k % 7 != 0, F.col("heading").cast("string")).alias("view:azimuth"), F.when(k % 5 != 0, F.lit("2023-06-01T10:00:00Z")).alias("datetime")).alias("properties"),
        F.struct(href("t", k % 13 != 0).alias("thumb"), href("sd", k % 3 == 0).alias("sd"), href("hd", k % 3 == 1).alias("hd")).alias("assets"),
    )
    s = L.street_stac(roundtrip_documents(_pages(_images(v), item, "features"), L.STAC))
    return s.select("image_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "heading", "captured_at", "full_url")


@query(
    "src_poi_elements",
    "pois",
    """select round(lat,5) as lat, round(lon,5) as lon, street as name, cast(housenumber as varchar) as number, 2 as tags from pois where poi_id%10<>0 or poi_id%2=1""",
)
def _(v):
    k = F.col("k")
    p = v.pois.withColumnRenamed("poi_id", "k")
    tags = F.struct(F.col("street").alias("name"), F.col("housenumber").cast("string").alias("addr:housenumber"), F.when(k % 3 != 0, "x").alias("layer"))
    center = F.when((k % 2 == 0) & (k % 10 != 0), F.struct("lat", "lon"))
    item = F.struct(F.when(k % 2 == 1, F.col("lat")).alias("lat"), F.when(k % 2 == 1, F.col("lon")).alias("lon"), center.alias("center"), tags.alias("tags"))
    e = L.poi_elements(roundtrip_documents(_pages(p, item, "elements"), L.ELEMENTS))
    g = lambda n: F.try_element_at("tags", F.lit(n))
    return e.select(F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), g("name").alias("name"), g("addr:housenumber").alias("number"), F.size("tags").alias("tags"))


@query(
    "src_web_matches",
    "photos",
    """select photo_id, concat('guess ', scene) as guess, case when photo_id%20 > 12 then 12 else photo_id%20 end as entities, 8 as matching, case when photo_id%3=0 then 1 else 0 end as landmarks, case when photo_id%3=0 then round(lat,4) end as lat from photos""",
)
def _(v):
    k = F.col("photo_id")
    n = (k % 20).cast("int")
    ents = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("description"), F.lit(0.5).alias("score")))
    urls = lambda c: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(F.concat(F.lit(c), i.cast("string")).alias("url")))
    loc = F.array(F.struct(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("latLng")))
    marks = F.array(F.struct(F.lit("Tower").alias("description"), F.lit(0.9).alias("score"), F.when(k % 3 == 0, loc).otherwise(F.slice(loc, 1, 0)).alias("locations")))
    web = F.struct(F.array(F.struct(F.concat(F.lit("guess "), F.col("scene")).alias("label"))).alias("bestGuessLabels"), ents.alias("webEntities"), urls("full").alias("fullMatchingImages"), urls("part").alias("partialMatchingImages"))
    doc = v.photos.select(F.to_json(F.struct("photo_id", F.array(F.struct(web.alias("webDetection"), marks.alias("landmarkAnnotations"))).alias("responses"))).alias("body"))
    w = L.web_matches(roundtrip_documents(doc, "photo_id bigint, " + L.WEB))
    return w.select(
        "photo_id", F.get("best_guess", F.lit(0)).alias("guess"), F.size("entities").alias("entities"), F.size("matching_images").alias("matching"),
        F.size("landmarks").alias("landmarks"), F.round(F.get("landmarks", F.lit(0))["lat"], 4).alias("lat"),
    )


@query(
    "src_place_hits",
    "places",
    """with h as (select *, row_number() over (partition by iso2 order by place_id) as rn from places) select iso2 as query, name, round(lat,4) as lat, round(lon,4) as lon from h where rn<=6 and place_id%7<>0""",
)
def _(v):
    hit = F.struct("place_id", F.when(F.col("place_id") % 7 != 0, F.col("name")).alias("display_name"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"))
    doc = v.places.groupBy(F.col("iso2").alias("query")).agg(F.array_sort(F.collect_list(hit)).alias("hits")).select(F.to_json(F.struct("query", "hits")).alias("body"))
    h = L.place_hits(roundtrip_documents(doc, L.HITS))
    return h.select("query", "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(
    "src_photo_meta",
    "reports",
    """select photo_id, case when photo_id%2=0 then round(lat,4) end as gps_lat, prec as precision, confidence/100 as confidence, case when photo_id%3=0 then null else 'city' end as resolution, photo_id%19=0 as verified from reports""",
)
def _(v):
    k = F.col("photo_id")
    js = lambda s: F.to_json(s)
    rows = v.reports.select(
        "photo_id",
        F.when(k % 2 == 0, js(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("exif").alias("source")))).alias("gps"),
        F.when(k % 3 != 0, js(F.struct(F.lit("city").alias("resolution"), F.lit(70.0).alias("confidence")))).alias("result"),
        js(F.struct(F.struct(F.col("prec").alias("precision"), (F.col("confidence") / 100).alias("confidence")).alias("report"))).alias("investigation"),
        js(F.struct((k % 19 == 0).alias("verified"))).alias("streetmatch"),
    )
    r = L.photo_rows(roundtrip_text(rows, "gps"))
    return r.select(
        "photo_id", F.round("gps.latitude", 4).alias("gps_lat"), "investigation.report.precision", "investigation.report.confidence", "result.resolution", "streetmatch.verified"
    )


@query(
    "flt_poi_query",
    "pois",
    """select poi_id from pois where lat between 48.84 and 48.855 and lon between 2.33 and 2.35 and (poi_id%3=0 or poi_id%4=0) and regexp_matches(street, '(?i)a') order by poi_id limit 60""",
)
def _(v):
    k = F.col("poi_id")
    tags = F.map_from_arrays(F.array(F.lit("name"), F.lit("leisure"), F.lit("tourism")), F.array(F.col("street"), F.when(k % 3 == 0, "water_park").otherwise("garden"), F.when(k % 4 == 0, "hotel")))
    p = v.pois.withColumn("tags", tags)
    return L.poi_query(p, (48.84, 2.33, 48.855, 2.35), ["leisure=water_park", "tourism"], "A").select("poi_id")


# ---- builds and sinks --------------------------------------------------------------------------

TOWN = f"""nt as (select * from (select photo_id, photos.lat, photos.lon, p.iso2, p.admin1, row_number() over (partition by photo_id order by round({hav('photos.lat','photos.lon','p.lat','p.lon')},9), place_id) as rn from photos, places p) where rn=1),
 ce as (select iso2, admin1, count(*) as n, degrees(asin(sum(sin(radians(lat)))/(sqrt(pow(sum(cos(radians(lat))*cos(radians(lon))),2)+pow(sum(cos(radians(lat))*sin(radians(lon))),2)+pow(sum(sin(radians(lat))),2))+1e-12))) as clat,
   degrees(atan2(sum(cos(radians(lat))*sin(radians(lon))), sum(cos(radians(lat))*cos(radians(lon))))) as clon from nt group by 1,2),
 sc as (select iso2, admin1, greatest(quantile_cont({hav('clat','clon','lat','lon')},0.68),1.0) as scale from nt join ce using (iso2, admin1) group by 1,2),
 nm as (select * from (select ce.iso2, ce.admin1, p.name, row_number() over (partition by ce.iso2, ce.admin1 order by round({hav('clat','clon','p.lat','p.lon')},9), place_id) as rn from ce, places p) where rn=1)"""
# groups of one cell in full; of those that are split, what every split must keep
CELLS_SQL = f"""with {TOWN}, t as (select sum(n) as t from ce)
    select iso2, admin1, cast(ceil(n/400.0) as bigint) as cells, n as photos, round(n/t,6)+0.0 as prior, case when n<=400 then name end as name,
      case when n<=400 then round(clat,5)+0.0 end as lat, case when n<=400 then round(clon,5)+0.0 end as lon, case when n<=400 then round(scale,4)+0.0 end as scale_km
    from ce join sc using (iso2, admin1) join nm using (iso2, admin1) cross join t"""


def built(v):
    return B.build_cells(v.photos.select(F.col("photo_id").alias("point_id"), "lat", "lon"), v.places)


def by_group(cells):
    """Cells of each region counted, its photos and prior summed; the cell itself where there is one."""
    one = F.count("*") == 1

    def only(c):
        return F.when(one, F.first(c))

    return cells.groupBy("iso2", "admin1").agg(
        F.count("*").alias("cells"), F.sum("count").alias("photos"), r6(F.sum(F.exp("log_prior"))).alias("prior"), only("name").alias("name"),
        r6(only("lat"), 5).alias("lat"), r6(only("lon"), 5).alias("lon"), r6(only("scale_km"), 4).alias("scale_km"),
    )


@query("agg_cells_build", "places photos", CELLS_SQL)
def _(v):
    return by_group(built(v))


@query("snk_cells", "places photos", CELLS_SQL)
def _(v):
    path = scratch(v.spark, "cells")
    sinks.write_cells(built(v), path)
    return by_group(v.spark.read.parquet(path))


@query("agg_kmeans_sphere")
def _(v):
    p = v.photos.select(F.col("photo_id").alias("point_id"), "album_id", "lat", "lon")
    return B.kmeans_sphere(p, ["album_id"], target=30).select("point_id", "album_id", "cluster")


@query(
    "join_cell_name",
    "places photos",
    f"""with ce as (select album_id, degrees(asin(sum(sin(radians(lat)))/(sqrt(pow(sum(cos(radians(lat))*cos(radians(lon))),2)+pow(sum(cos(radians(lat))*sin(radians(lon))),2)+pow(sum(sin(radians(lat))),2))+1e-12))) as clat,
        degrees(atan2(sum(cos(radians(lat))*sin(radians(lon))), sum(cos(radians(lat))*cos(radians(lon))))) as clon from photos group by 1)
    select album_id, name from (select album_id, p.name, row_number() over (partition by album_id order by round({hav('clat','clon','p.lat','p.lon')},9), place_id) as rn from ce, places p) where rn=1""",
)
def _(v):
    lat, lon = geo.spherical_mean("lat", "lon")
    return B.name_cells(v.photos.groupBy("album_id").agg(lat.alias("lat"), lon.alias("lon")), v.places).select("album_id", "name")


@query(
    "snk_index",
    "geo_index cells",
    f"""select vec_id, leaf, leaf%64 as leaf_bucket, len(embedding) as dim from (select g.vec_id, g.embedding, c.leaf, row_number() over (partition by g.vec_id order by round({hav('g.lat','g.lon','c.lat','c.lon')}/c.scale_km,9), c.leaf) as rn from geo_index g, cells c) where rn=1""",
)
def _(v):
    path = scratch(v.spark, "index")
    sinks.write_index(v.geo_index.select("vec_id", "embedding", "lat", "lon"), v.cells, path)
    return v.spark.read.parquet(path).select("vec_id", "leaf", F.col("leaf_bucket").cast("bigint").alias("leaf_bucket"), F.size("embedding").alias("dim"))


@query("snk_view_index")
def _(v):
    from .q_skyline import view_index

    path = scratch(v.spark, "views")
    sinks.write_view_index(view_index(v), path)
    return v.spark.read.parquet(path).select("region", "i", "j", "lat", "lon", "spacing_km", "pano")


