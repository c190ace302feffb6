"""Photo archive: each photo's own location, what it inherits from its group, and what photos of the same day say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import PINNED, lookup, resolution_rank

SAME_DAY_HOURS = 12.0
BUCKET_MICROS = 3_600_000_000
INDOOR = ("home", "bar_restaurant", "other_indoor")
# Report precision as answer resolution.
REPORT_RESOLUTION = {
    "exact": "exact", "street": "street", "neighborhood": "street", "city": "city", "region": "region", "country": "country",
}
OPTION = "lat double, lon double, label string, source string, confidence double, resolution string, kind int"


def location_options() -> Column:
    """All answers a photo has for its place, as array<struct>, in order of preference on equal strength.

    Reads user_lat/user_lon/user_label and the structs result(lat, lon, label, resolution, confidence),
    report(lat, lon, precision, confidence 0..1, place_name), street(verified, lat, lon, captured_at, address, in_view)
    and skyline(pinned, lat, lon, confidence 0..1).
    """

    def opt(kind, lat, lon, label, source, confidence, resolution) -> Column:
        return F.struct(
            lat.alias("lat"), lon.alias("lon"), label.alias("label"), F.lit(source).alias("source"),
            confidence.cast("double").alias("confidence"), resolution.alias("resolution"), F.lit(kind).alias("kind"),
        )

    def label(text: Column, default: str) -> Column:
        return F.when(F.length(text) > 0, text).otherwise(F.lit(default))

    rs, rp, st, sk = (F.col(c) for c in ("result", "report", "street", "skyline"))
    report_res = lookup(REPORT_RESOLUTION, rp["precision"])
    dated = F.when(F.length(st["captured_at"]) > 0, F.concat(F.lit("Matched street photo from "), st["captured_at"])).otherwise(
        F.lit("Matched street photo")
    )
    return F.array_compact(
        F.array(
            F.when(
                F.col("user_lat").isNotNull() & F.col("user_lon").isNotNull(),
                opt(0, F.col("user_lat"), F.col("user_lon"), label(F.col("user_label"), "Set by you"), "you", F.lit(100.0), F.lit("exact")),
            ),
            F.when(
                rs.isNotNull() & (rs["resolution"] != "world"),
                opt(1, rs["lat"], rs["lon"], rs["label"], "photo", rs["confidence"], rs["resolution"]),
            ),
            F.when(
                rp["lat"].isNotNull() & rp["lon"].isNotNull() & report_res.isNotNull(),
                opt(2, rp["lat"], rp["lon"], label(rp["place_name"], "Investigated location"), "photo", F.bround(100 * rp["confidence"], 1), report_res),
            ),
            F.when(
                st["verified"] & st["lat"].isNotNull(),
                opt(3, st["lat"], st["lon"], F.when(st["in_view"], F.concat(F.lit("Facing "), st["address"])).otherwise(dated), "photo", F.lit(95.0), F.lit("exact")),
            ),
            F.when(
                sk["pinned"] & sk["lat"].isNotNull(),
                opt(4, sk["lat"], sk["lon"], F.lit("Mountain skyline match"), "photo", F.bround(100 * sk["confidence"], 1), F.lit("street")),
            ),
        )
    )


def strength(o: Column) -> Column:
    return resolution_rank(o["resolution"]) + F.when(o["source"] == "you", 10).otherwise(0)


def own_location(options: Column) -> Column:
    """The photo's own location: its pin, else the strongest answer at street level or better; null when none."""
    pinned = F.filter(options, lambda o: (o["source"] == "you") | o["resolution"].isin(*PINNED))
    ranked = F.transform(
        pinned,
        lambda o: F.struct((-strength(o)).alias("s"), (-o["confidence"]).alias("c"), o["kind"].alias("k"), o.alias("o")),
    )
    return F.array_min(ranked)["o"]


def with_own(photos: DataFrame) -> DataFrame:
    return photos.withColumn("own", own_location(location_options()))


def group_best(photos: DataFrame) -> DataFrame:
    """(group_id, donor, best): strongest own location per group, reduced on the map side."""
    o = F.col("own")
    pick = F.min(
        F.struct((-strength(o)).alias("s"), (-o["confidence"]).alias("c"), F.col("photo_id").alias("donor"), o.alias("best"))
    )
    has = photos.filter(F.col("group_id").isNotNull() & F.col("own").isNotNull())
    return has.groupBy("group_id").agg(pick.alias("g")).select("group_id", "g.donor", "g.best")


def resolve(photos: DataFrame) -> DataFrame:
    """Adds ``location`` and ``via``: own unless another member of the group has a stronger one."""
    j = photos.join(group_best(photos), "group_id", "left")
    own, best = F.col("own"), F.col("best")
    stronger = (strength(best) > strength(own)) | ((strength(best) == strength(own)) & (best["confidence"] > own["confidence"]))
    inherit = best.isNotNull() & (F.col("donor") != F.col("photo_id")) & (own.isNull() | stronger)
    loc = F.when(inherit, best.withField("source", F.lit("group"))).otherwise(own)
    return j.withColumn("location", loc).withColumn("via", F.when(inherit, F.col("donor"))).drop("donor", "best")


def same_day(photos: DataFrame, pins: DataFrame, hours: float = SAME_DAY_HOURS) -> DataFrame:
    """Closest pinned photo in time within ``hours``: (photo_id, near_id, hours).

    ``photos``: photo_id, album_id, micros; ``pins``: the same for pinned photos. Pins and photos are ordered within
    one-hour buckets; what lies beyond a bucket comes from a per-bucket summary. No pair of photos is ever formed, and
    a large album is spread over its hours.
    """
    bucket = F.floor(F.col("micros") / BUCKET_MICROS)
    rank = F.row_number().over(W.partitionBy("album_id", "micros").orderBy("photo_id"))
    at = (
        pins.filter("micros is not null").withColumn("_r", rank).filter("_r <= 2")
        .groupBy("album_id", "micros").agg(F.array_sort(F.collect_list("photo_id")).alias("ids"))
    )
    pin = F.struct(F.col("micros").alias("t"), "ids")
    rows = photos.filter("micros is not null").select(
        "album_id", "micros", "photo_id", F.lit(None).cast("struct<t:bigint,ids:array<bigint>>").alias("pin")
    ).unionByName(at.select("album_id", "micros", F.lit(None).cast("bigint").alias("photo_id"), pin.alias("pin")))
    rows = rows.withColumn("b", bucket)
    hour = W.partitionBy("album_id", "b").orderBy("micros")
    rows = rows.withColumns(
        {
            "same": F.first("pin", ignorenulls=True).over(hour.rangeBetween(0, 0)),
            "before": F.last("pin", ignorenulls=True).over(hour.rangeBetween(W.unboundedPreceding, -1)),
            "after": F.first("pin", ignorenulls=True).over(hour.rangeBetween(1, W.unboundedFollowing)),
        }
    )
    ends = rows.groupBy("album_id", "b").agg(F.min("pin").alias("lo"), F.max("pin").alias("hi"))
    album = W.partitionBy("album_id").orderBy("b")
    ends = ends.select(
        "album_id",
        "b",
        F.last("hi", ignorenulls=True).over(album.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"),
        F.first("lo", ignorenulls=True).over(album.rowsBetween(1, W.unboundedFollowing)).alias("later"),
    )
    j = rows.filter("photo_id is not null").join(ends, ["album_id", "b"])
    limit = int(hours * 3_600_000_000)

    def option(p: Column) -> Column:
        other = F.get(F.filter(p["ids"], lambda x: x != F.col("photo_id")), F.lit(0))
        return F.when(other.isNotNull(), F.struct(F.abs(p["t"] - F.col("micros")).alias("gap"), other.alias("near_id")))

    opts = F.array_compact(
        F.transform(F.array_compact(F.array("same", "before", "after", "earlier", "later")), option)
    )
    best = F.array_min(F.filter(opts, lambda o: o["gap"] <= limit))
    return j.withColumn("_n", best).filter("_n is not null").select(
        "photo_id", "_n.near_id", (F.col("_n.gap").cast("double") / 3.6e9).alias("hours")
    )


def lead_text() -> Column:
    """Best coarse answer of a photo without a spot, as 'name · precision'; the report first, then the result."""
    rp, rs = F.col("report"), F.col("result")
    coarse = ~rp["precision"].isin("unknown", "exact", "street")
    return F.when(
        (F.length(rp["place_name"]) > 0) & coarse, F.concat_ws(" · ", rp["place_name"], rp["precision"])
    ).when(
        rs["resolution"].isNotNull() & ~rs["resolution"].isin("world", "exact", "street"), F.concat_ws(" · ", rs["label"], rs["resolution"])
    )


def album_summary(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per photo: scene, era, group name, location and, without a location, the best lead text."""
    from ..functions.times import micros, same_day_text

    p = resolve(with_own(photos)).withColumn("micros", micros("taken_at"))
    pins = p.filter("own is not null").select("photo_id", "album_id", "micros")
    near = same_day(p.filter("location is null").select("photo_id", "album_id", "micros"), pins)
    told = near.join(
        p.select(F.col("photo_id").alias("near_id"), F.col("filename").alias("near_file"), F.col("own.label").alias("near_label")), "near_id"
    ).select("photo_id", same_day_text("near_file", "near_label", "hours").alias("same_day"))
    names = groups.select("group_id", F.col("name").alias("group_name"))
    out = p.join(names, "group_id", "left").join(told, "photo_id", "left")
    return out.select(
        "photo_id",
        F.col("result.scene").alias("scene"),
        F.when(F.length("result.era") > 0, F.col("result.era")).alias("era"),
        "group_name",
        "location",
        "via",
        F.when(F.col("location").isNull(), F.coalesce("same_day", lead_text())).alias("lead"),
    )


def group_summary(resolved: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, name, photos, donor, best): size and best location of each group. Members stay a table of their own
    (``resolved`` by group_id): a group may hold a large share of all photos, so they are counted, not collected."""
    loc = F.col("location")
    pick = F.min(F.when(loc.isNotNull(), F.struct((-strength(loc)).alias("s"), (-loc["confidence"]).alias("c"), F.col("photo_id").alias("id"), loc.alias("best"))))
    g = resolved.filter("group_id is not null").groupBy("group_id").agg(F.count("*").alias("photos"), pick.alias("g"))
    return groups.join(g, "group_id", "left").select(
        "group_id", "name", F.coalesce("photos", F.lit(0)).alias("photos"), F.col("g.best").alias("best")
    )


def already_searched(leads: DataFrame, searched: DataFrame) -> DataFrame:
    """Leads not inside the box searched before for the same photo."""
    j = leads.join(searched.select("photo_id", "south", "west", "north", "east"), "photo_id", "left")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return j.filter(~F.coalesce(inside, F.lit(False))).drop("south", "west", "north", "east")
