"""Nearest and range joins on the sphere, as equi joins on grid tiles.

Nearest: a tile index lists, for every tile of a latitude/longitude grid, exactly the sites that can win for some
point of the tile. It is refined from coarse to fine tiles, so no step compares every site with every tile. Points
then meet their tile's list in one equi join and the winner is picked inside the row.

Range: the searching side is repeated for the tiles its box touches and meets the other side on the tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, col, haversine_km, unit_vector

BROADCAST_BYTES = 64 << 20
SLACK_KM = 1e-6
SCORE_STEP_KM = 2e-9  # scores further apart than this differ after rounding


def small_enough(df: DataFrame, rows: int | None = None, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> bool:
    """Counted size check for a broadcast side (the caller persists what is costly to compute twice)."""
    n = df.count() if rows is None else rows
    return n * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int = 64, rows: int | None = None) -> DataFrame:
    """Broadcast only when the counted rows fit the bound; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if small_enough(df, rows, row_bytes) else df


def tile_i(lat, deg: float) -> Column:
    n = int(round(180 / deg))
    return F.least(F.lit(n - 1), F.floor((col(lat) + 90.0) / deg).cast("int"))


def tile_j(lon, deg: float) -> Column:
    n = int(round(360 / deg))
    return F.pmod(F.floor((col(lon) + 180.0) / deg).cast("int"), F.lit(n))


LADDER = (30.0, 5.0, 1.0, 0.25, 0.05)  # tile sizes from coarse to fine; each divides the one before


def _tile_bounds(sites: DataFrame, deg: float, scaled: bool, keys: list[str]) -> DataFrame:
    """Keep the sites that can win somewhere in their tile (columns ti, tj, lat, lon, handicap)."""
    c_lat = (F.col("ti") + 0.5) * deg - 90.0
    c_lon = (F.col("tj") + 0.5) * deg - 180.0
    reach = F.greatest(
        haversine_km(c_lat, c_lon, c_lat - deg / 2, c_lon + deg / 2),
        haversine_km(c_lat, c_lon, c_lat + deg / 2, c_lon + deg / 2),
    ) + F.lit(SLACK_KM)
    d = haversine_km(c_lat, c_lon, "lat", "lon")
    if scaled:
        lo, hi = F.greatest(F.lit(0.0), d - reach) / F.col("handicap"), (d + reach) / F.col("handicap")
    else:
        lo, hi = d - reach - F.col("handicap"), d + reach - F.col("handicap")
    best = F.min("hi").over(W.partitionBy(*keys, "ti", "tj"))
    return (
        sites.withColumn("lo", lo)
        .withColumn("hi", hi)
        .withColumn("best", best)
        .filter("lo <= best")
        .drop("lo", "hi", "best")
    )


def competing(sites: DataFrame, site_id: str, handicap=0.0, scaled: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, lat, lon, handicap) of the sites that can win at all.

    Of sites in one place, a site with no smaller handicap and a lower id is never worse, so the other one goes; unscaled, so does
    one whose handicap is smaller by more than the rounding of scores. Where many sites share a place, a tile's list then
    holds few of them.
    """
    keys = keys or []
    place = [*keys, "lat", "lon"]
    cur = sites.select(*keys, F.col(site_id).alias("id"), col("lat").alias("lat"), col("lon").alias("lon"), col(handicap).cast("double").alias("handicap"))
    # ids are compared as structs, so a null id keeps its place before all others
    cur = cur.groupBy(*place, "handicap").agg(F.min(F.struct("id")).alias("first"))
    bonus = F.nanvl("handicap", F.lit(None))
    before = W.partitionBy(*place).orderBy(bonus.desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    cur = cur.withColumn("better", F.min("first").over(before)).withColumn("most", F.max(bonus).over(W.partitionBy(*place)))
    keep = F.col("better").isNull() | (F.col("first") < F.col("better"))
    keep = keep | (F.col("handicap") <= 0) if scaled else keep & ~F.coalesce(F.col("handicap") < F.col("most") - SCORE_STEP_KM, F.lit(False))
    return cur.filter(keep).select(*keys, "first.id", "lat", "lon", "handicap")


def nearest_index(
    sites: DataFrame,
    site_id: str,
    handicap=0.0,
    scaled: bool = False,
    tile_deg: float = 1.0,
    keys: list[str] | None = None,
    occupied: DataFrame | None = None,
) -> DataFrame:
    """Tile → array of sites that can be nearest to some point in it.

    The score is ``distance - handicap`` or, when ``scaled``, ``distance / handicap``. ``tile_deg`` is a step of
    ``LADDER``. Without ``occupied`` the index covers the world and depends on the sites only, so it can be written
    once and reused. With ``keys`` sites compete only among equal keys, and ``occupied`` (keys, ti, tj of the finest
    tiles that hold points) limits the work to tiles in use.
    """
    keys = keys or []
    steps = [d for d in LADDER if d >= tile_deg - 1e-9]
    if abs(steps[-1] - tile_deg) > 1e-9:
        raise ValueError(f"tile_deg must be one of {LADDER}")
    carry = [*keys, "id", "lat", "lon", "handicap"]
    cur = competing(sites, site_id, handicap, scaled, keys)

    def used(deg: float) -> DataFrame:
        k = int(round(deg / tile_deg))
        return occupied.select(*keys, F.floor(F.col("ti") / k).cast("int").alias("ti"), F.floor(F.col("tj") / k).cast("int").alias("tj")).distinct()

    if occupied is None:
        rows, cols = int(180 / steps[0]), int(360 / steps[0])
        # the fixed set of root tiles is the only place where every site meets every tile
        root = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("t")
        cur = cur.select("*", root).select(*carry, F.floor(F.col("t") / cols).cast("int").alias("ti"), (F.col("t") % cols).alias("tj"))
    else:
        cur = cur.join(used(steps[0]), keys)
    cur = _tile_bounds(cur, steps[0], scaled, keys)
    for wide, deg in zip(steps, steps[1:], strict=False):
        k = int(round(wide / deg))
        kids = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1)))
        cur = cur.select(*carry, "ti", "tj", kids.alias("t")).select(
            *carry, (F.col("ti") * k + F.floor(F.col("t") / k).cast("int")).alias("ti"), (F.col("tj") * k + F.col("t") % k).alias("tj")
        )
        if occupied is not None:
            cur = cur.join(used(deg), [*keys, "ti", "tj"], "left_semi")
        cur = _tile_bounds(cur, deg, scaled, keys)
    u = unit_vector("lat", "lon")
    site = F.struct("id", u["x"].alias("x"), u["y"].alias("y"), u["z"].alias("z"), "handicap")
    return cur.groupBy(*keys, "ti", "tj").agg(F.collect_list(site).alias("sites"))


def auto_tile_deg(sites: int) -> float:
    """Tile size that keeps a tile's candidate list short for a gazetteer of this many sites."""
    return 5.0 if sites <= 200 else 1.0 if sites <= 20_000 else 0.25


def nearest(
    points: DataFrame,
    index: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    scaled: bool = False,
    tile_deg: float = 1.0,
    id_name: str = "site_id",
    distance_name: str = "distance_km",
    broadcast: bool | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Exact nearest site per point under the index's score; ties go to the lower id. Points are not shuffled when
    the index is small enough to broadcast; otherwise the tile join is split by the adaptive skew rule."""
    if broadcast is None:
        index = index.persist()
        entries = index.agg(F.coalesce(F.sum(F.size("sites")), F.lit(0))).first()[0]
        broadcast = small_enough(index, entries, row_bytes=48)

    def score(c: Column) -> Column:
        # chord length gives the same distance as the haversine form with a third of the work per site
        dx, dy, dz = F.col("_u.x") - c["x"], F.col("_u.y") - c["y"], F.col("_u.z") - c["z"]
        d = F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(dx * dx + dy * dy + dz * dz) * 0.5)
        s = d / c["handicap"] if scaled else d - c["handicap"]
        return F.struct(F.rint(s * 1e9).alias("s"), c["id"].alias("id"), d.alias("d"))

    keyed = (
        points.withColumn("_ti", tile_i(lat, tile_deg))
        .withColumn("_tj", tile_j(lon, tile_deg))
        .withColumn("_u", unit_vector(lat, lon))
    )
    ix = index.select(*(keys or []), F.col("ti").alias("_ti"), F.col("tj").alias("_tj"), "sites")
    joined = keyed.join(F.broadcast(ix) if broadcast else ix, [*(keys or []), "_ti", "_tj"], "left")
    best = F.array_min(F.transform("sites", score))
    return (
        joined.withColumn("_best", best)
        .drop("_ti", "_tj", "_u", "sites")
        .withColumn(id_name, F.col("_best.id"))
        .withColumn(distance_name, F.col("_best.d"))
        .drop("_best")
    )


def covering_tiles(south, west, north, east, deg: float) -> Column:
    """Tiles a plain (non-wrapping) box touches: array<struct(ti, tj)>."""
    i0, i1 = F.floor(col(south) / deg).cast("int"), F.floor(col(north) / deg).cast("int")
    j0, j1 = F.floor(col(west) / deg).cast("int"), F.floor(col(east) / deg).cast("int")
    return F.flatten(
        F.transform(
            F.sequence(i0, i1),
            lambda i: F.transform(F.sequence(j0, j1), lambda j: F.struct(i.alias("ti"), j.alias("tj"))),
        )
    )


def dealt(a: DataFrame, b: DataFrame, keys: list[str], most_a: int, most_b: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a group of more than ``most_a`` (``most_b``) rows dealt out: columns _pa and _pb to join on as well.

    Rows are counted by key first. Each pair of rows still meets once: a row of a dealt group is repeated for the other side's parts.
    Both come in a stated number of partitions: rows are few and small, and what they give is not, so they mustn't be merged by size.
    """
    parts = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    n = parts(a, most_a, "_na").join(parts(b, most_b, "_nb"), keys).filter("_na > 1 or _nb > 1")
    some = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        mine, count, theirs = f"_p{own}", f"_n{own}", f"_n{other}"
        place = F.pmod(F.xxhash64(*df.columns), F.coalesce(count, F.lit(1))).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)) - 1))
        out = df.join(F.broadcast(n), keys, "left").select(*df.columns, place.alias(mine), each.alias(f"_p{other}"))
        return out.repartition(some, *keys, "_pa", "_pb")

    return deal(a, "a", "b"), deal(b, "b", "a")


def box_tiles(left: DataFrame, right: DataFrame, box: tuple[str, str, str, str], deg: float, lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """``left`` repeated for the tiles (_ti, _tj) that its boxes touch, and ``right`` with the tile it lies in."""
    a = left.withColumn("_t", F.explode(covering_tiles(*box, deg)))
    a = a.withColumn("_ti", F.col("_t.ti")).withColumn("_tj", F.col("_t.tj")).drop("_t")
    b = right.withColumn("_ti", F.floor(F.col(lat) / deg).cast("int")).withColumn("_tj", F.floor(F.col(lon) / deg).cast("int"))
    return a, b


PER_PART = (4096, 4096)  # boxes and rows that meet in one part of a dealt tile
FEW_PARTS = (1 << 17, 1 << 17)  # the same where rows are many and should be repeated little


def box_join(
    left: DataFrame, right: DataFrame, box: tuple[str, str, str, str], deg: float, lat: str = "lat", lon: str = "lon", deal: tuple[int, int] | None = None
) -> DataFrame:
    """Rows of ``right`` inside the closed box of each row of ``left``; ``right`` coordinates keep their names.

    Always a shuffled join: the planner sizes ``left`` by its files, not by the tiles it is repeated for, and would broadcast it.
    ``deal`` spreads the pairs of crowded tiles over tasks, at the price of counting both sides first. What a box meets is
    bounded then, so it is looked up by its tile and nothing is sorted.
    """
    s, w, n, e = box
    a, b = box_tiles(left, right, box, deg, lat, lon)
    keys = ["_ti", "_tj"]
    if deal:
        a, b = dealt(a, b, keys, *deal)
        keys += ["_pa", "_pb"]
    return (
        a.join(b.hint("shuffle_hash" if deal else "merge"), keys)
        .filter(F.col(lat).between(F.col(s), F.col(n)) & F.col(lon).between(F.col(w), F.col(e)))
        .drop(*keys)
    )


def radius_boxes(df: DataFrame, lat: str, lon: str, radius_m, prefix: str = "_") -> DataFrame:
    """Adds the square box of a radius in metres as ``<prefix>s/w/n/e``."""
    dlat = col(radius_m) / 111_320.0
    dlon = col(radius_m) / (F.lit(111_320.0) * F.greatest(F.cos(F.radians(F.col(lat))), F.lit(0.01)))
    return (
        df.withColumn(f"{prefix}s", F.col(lat) - dlat)
        .withColumn(f"{prefix}w", F.col(lon) - dlon)
        .withColumn(f"{prefix}n", F.col(lat) + dlat)
        .withColumn(f"{prefix}e", F.col(lon) + dlon)
    )


def reach_tiles(lat, lon, reach_km, deg: float) -> Column:
    """Tiles (wrapping at ±180) within a great-circle reach; one world tile (-1, -1) once the reach is hemispheric."""
    la, lo = col(lat), col(lon)
    r = col(reach_km)
    rad = r / F.lit(EARTH_RADIUS_KM)
    dlat = F.degrees(rad)
    rows, cols = int(round(180 / deg)), int(round(360 / deg))
    i0 = F.greatest(F.lit(0), F.floor((la - dlat + 90.0) / deg).cast("int"))
    i1 = F.least(F.lit(rows - 1), F.floor((la + dlat + 90.0) / deg).cast("int"))
    polar = (la + dlat >= 90.0) | (la - dlat <= -90.0)
    ratio = F.least(F.lit(1.0), F.sin(F.least(rad, F.lit(1.5707963))) / F.greatest(F.cos(F.radians(la)), F.lit(1e-9)))
    dlon = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + 1e-9)
    j0 = F.floor((lo - dlon + 180.0) / deg).cast("int")
    j1 = F.least(F.floor((lo + dlon + 180.0) / deg).cast("int"), j0 + (cols - 1))
    near = F.flatten(
        F.transform(
            F.sequence(i0, i1),
            lambda i: F.transform(
                F.sequence(j0, j1), lambda j: F.struct(i.alias("ti"), F.pmod(j, F.lit(cols)).alias("tj"))
            ),
        )
    )
    return F.when(r < 3000.0, near).otherwise(F.array(F.struct(F.lit(-1).alias("ti"), F.lit(-1).alias("tj"))))


def site_tiles(lat, lon, deg: float) -> Column:
    """The two tiles a site answers to in a reach join: its own and the world tile."""
    return F.array(
        F.struct(tile_i(lat, deg).alias("ti"), tile_j(lon, deg).alias("tj")),
        F.struct(F.lit(-1).alias("ti"), F.lit(-1).alias("tj")),
    )


def reach_join(
    left: DataFrame,
    sites: DataFrame,
    reach_km: Column | str,
    lat: str = "lat",
    lon: str = "lon",
    site_lat: str = "site_lat",
    site_lon: str = "site_lon",
    deg: float = 10.0,
) -> DataFrame:
    """Pairs within a per-row great-circle reach (``distance_km`` added), wrapping at the antimeridian."""
    a = left.withColumn("_reach", col(reach_km)).withColumn("_t", F.explode(reach_tiles(lat, lon, F.col("_reach"), deg)))
    b = sites.withColumn("_t", F.explode(site_tiles(site_lat, site_lon, deg)))
    return (
        a.join(b, "_t")
        .withColumn("distance_km", haversine_km(lat, lon, site_lat, site_lon))
        .filter(F.col("distance_km") <= F.col("_reach"))
        .drop("_t", "_reach")
    )


__all__ = [
    "auto_tile_deg",
    "box_join",
    "box_tiles",
    "competing",
    "covering_tiles",
    "dealt",
    "maybe_broadcast",
    "nearest",
    "nearest_index",
    "radius_boxes",
    "reach_join",
    "small_enough",
]
