"""Building leaf cells from training coordinates: towns give the group, spherical k-means splits a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_RADIUS_KM, haversine_km, hilbert, spherical_mean, unit_vector, vector_lat, vector_lon
from ..session import checkpoint_dir
from .places import nearest_town
from .spatial import maybe_broadcast, nearest, nearest_index, tile_i, tile_j
from .stats import percentiles

TARGET = 400
ITERATIONS = 25
#: Centres (or candidates) of one group up to which they travel as one array to the group's blocks of points.
ARRAY_LIMIT = 100_000
#: Points of a partition of blocks, and neighbours along the curve that are compared with the same few centres.
PART_POINTS, RUN = 200_000, 256
#: Rounds of seeding, candidates that a round draws for each centre wanted, and candidates that are thinned out together.
SEED_ROUNDS, OVERSAMPLE, SEED_BLOCK = 5, 2, 2048
#: Two chords of the unit sphere whose scores can round to the same value differ by less.
TIE = 1e-12


class _Blocks:
    """Points of all groups, packed once: a row holds neighbours of one group along a Hilbert curve (``pts``).

    Every pass reads the packed rows where they lie; only centres move.
    """

    def __init__(self, points: DataFrame, keys: list[str]):
        self.keys, self.fields = keys, points.schema.fields
        spark = points.sparkSession
        own = [c for c in points.columns if c not in keys]
        kinds = {f.name: f for f in self.fields}
        pts = T.ArrayType(T.StructType([kinds[c] for c in own]))
        self.point_fields = [kinds[c] for c in own]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // PART_POINTS))
        curve = F.coalesce(hilbert("lat", "lon"), F.lit(-1)).alias("_h")
        ranged = points.select("*", curve).repartitionByRange(parts, *keys, "_h").sortWithinPartitions(*keys, "_h").drop("_h")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                new = np.zeros(b.num_rows, bool)
                new[0] = True
                for k in keys:
                    new[1:] |= pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(new)
                rows = pa.StructArray.from_arrays([b.column(c) for c in own], names=own)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in keys], lists], names=[*keys, "pts"])

        self.packed = ranged.mapInArrow(pack, T.StructType([*[kinds[k] for k in keys], T.StructField("pts", pts)])).checkpoint()

    def _met(self, centres: DataFrame, rows: int | None) -> DataFrame:
        cs = centres.groupBy(*self.keys).agg(F.collect_list(F.struct("cluster", "c_lat", "c_lon")).alias("cs"))
        return self.packed.join(maybe_broadcast(cs, 32, centres.count() if rows is None else rows), self.keys)

    def assigned(self, centres: DataFrame, rows: int | None = None) -> DataFrame:
        """Every point with its nearest centre (``cluster``) and its distance (``_d``, km)."""
        keys, names = self.keys, [f.name for f in self.fields]
        own = [f.name for f in self.point_fields]
        kinds = {f.name: f for f in self.fields}
        out = T.StructType([*[kinds[k] for k in keys], *self.point_fields, T.StructField("cluster", centres.schema["cluster"].dataType), T.StructField("_d", T.DoubleType())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r, pts, cs, best, d in _searched(b):
                    same = pa.array(np.full(len(pts), r))
                    kept = [pts.field(c) for c in own]
                    ids = cs.field("cluster").take(pa.array(best))
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(same) for k in keys], *kept, ids, pa.array(d, mask=np.isnan(d))], names=[*keys, *own, "cluster", "_d"])

        return self._met(centres, rows).mapInArrow(lambda it: _joined(place(it)), out).select(*names, "cluster", "_d")

    def sums(self, centres: DataFrame, rows: int | None = None) -> DataFrame:
        """What a round needs of each centre's points: (keys, cluster, n, x, y, z, cost), summed in the blocks first."""
        keys = self.keys
        kinds = {f.name: f for f in self.fields}
        numbers = [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "cost")]
        out = T.StructType([*[kinds[k] for k in keys], T.StructField("cluster", centres.schema["cluster"].dataType), T.StructField("n", T.LongType()), *numbers])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r, pts, cs, best, d in _searched(b):
                    used, to = np.unique(best, return_inverse=True)
                    chord = np.sin(d / (2 * EARTH_RADIUS_KM))
                    each = [*_unit(pts, "lat", "lon"), chord * chord]
                    each = [np.bincount(to, np.where(np.isnan(e), 0.0, e), len(used)) for e in each]
                    same = pa.array(np.full(len(used), r))
                    ids = cs.field("cluster").take(pa.array(used))
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(k).take(same) for k in keys], ids, pa.array(np.bincount(to, minlength=len(used))), *map(pa.array, each)], names=out.names
                    )

        return _summed(self._met(centres, rows).mapInArrow(lambda it: _joined(add(it)), out), keys)


class _Tiled:
    """The same for groups with too many centres for one array: points meet a tile index of their group's centres."""

    def __init__(self, points: DataFrame, keys: list[str], tile_deg: float = 0.25):
        self.points, self.keys, self.tile_deg = points, keys, tile_deg

    def assigned(self, centres: DataFrame, rows: int | None = None) -> DataFrame:
        used = self.points.select(*self.keys, tile_i("lat", self.tile_deg).alias("ti"), tile_j("lon", self.tile_deg).alias("tj")).distinct()
        sites = centres.withColumnsRenamed({"c_lat": "lat", "c_lon": "lon"})
        ix = nearest_index(sites, "cluster", tile_deg=self.tile_deg, keys=self.keys, occupied=used)
        return nearest(self.points, ix, tile_deg=self.tile_deg, id_name="cluster", distance_name="_d", broadcast=False, keys=self.keys)

    def sums(self, centres: DataFrame, rows: int | None = None) -> DataFrame:
        chord = F.sin(F.col("_d") / (2 * EARTH_RADIUS_KM))
        u = unit_vector("lat", "lon")
        one = self.assigned(centres).select(*self.keys, "cluster", F.lit(1).cast("long").alias("n"), u["x"].alias("x"), u["y"].alias("y"), u["z"].alias("z"), (chord * chord).alias("cost"))
        return _summed(one, self.keys)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "z", "cost")])


def _unit(rows: pa.StructArray, lat: str, lon: str) -> list[np.ndarray]:
    p, m = (np.radians(rows.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in (lat, lon))
    return [np.cos(p) * np.cos(m), np.cos(p) * np.sin(m), np.sin(p)]


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places in ``c`` of the centres that can be nearest to one of the neighbouring points ``x``."""
    mid = x.mean(0)
    reach = np.sqrt(((x - mid) ** 2).sum(1).max())
    away = np.sqrt(((c - mid) ** 2).sum(1))
    return np.flatnonzero(~(away > away.min() + 2 * reach + 1e-9))


def _closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre, of equal ones (to 1e-9 km) the first, and its distance in km."""
    gap = sum((x[:, i, None] - c[None, :, i]) ** 2 for i in range(3))
    best = gap.argmin(1)
    least = gap[np.arange(len(x)), best]
    tied = np.flatnonzero((gap <= ((np.sqrt(least) + TIE) ** 2)[:, None]).sum(1) > 1)
    if len(tied):
        score = np.rint(2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(gap[tied]) / 2)) * 1e9)
        best[tied] = score.argmin(1)
        least = gap[np.arange(len(x)), best]
    return best, 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(least) / 2))


def _searched(b: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray, pa.StructArray, np.ndarray, np.ndarray]]:
    """Of each row (block and centres of its group): its number, points, centres, every point's nearest centre and distance."""
    for r in range(b.num_rows):
        pts, cs = b.column("pts")[r].values, b.column("cs")[r].values
        pts, cs = (pa.StructArray.from_arrays(v.flatten(), fields=list(v.type)) for v in (pts, cs))
        cs = cs.take(pc.sort_indices(cs.field("cluster"), null_placement="at_start"))
        x, c = np.stack(_unit(pts, "lat", "lon"), 1), np.stack(_unit(cs, "c_lat", "c_lon"), 1)
        best, d = np.zeros(len(x), np.int64), np.full(len(x), np.nan)  # a point without a place goes to the first centre
        real = np.flatnonzero(np.isfinite(x).all(1))
        some = np.flatnonzero(np.isfinite(c).all(1))
        if len(real) and len(some):
            if len(real) > RUN < len(some):
                some = some[_near(x[real], c[some])]
            for i in range(0, len(real), RUN):
                run = real[i : i + RUN]
                few = some[_near(x[run], c[some])] if len(some) > 8 else some
                best[run], d[run] = (lambda k, km: (few[k], km))(*_closest(x[run], c[few]))
        yield r, pts, cs, best, d


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _thin_out(candidates: pd.DataFrame) -> pd.DataFrame:
    """Weighted k-means++ on one block of candidates: ``quota`` of them, far apart and where many points are."""
    c = candidates.sort_values("cluster")
    la, lo = np.radians(c["c_lat"].to_numpy()), np.radians(c["c_lon"].to_numpy())
    x = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
    weight = c["weight"].to_numpy(float)
    rng = np.random.default_rng(len(c))
    chosen, gap = [int(np.argmax(weight))], np.full(len(c), np.inf)
    while len(chosen) < int(c["quota"].iloc[0]):
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        mass = np.cumsum(weight * gap)
        if mass[-1] <= 0:
            break  # all others lie where a chosen one does
        chosen.append(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")))
    return c.iloc[sorted(chosen)]


def _search(points: DataFrame, keys: list[str], wide: bool) -> _Blocks | _Tiled:
    return _Tiled(points, keys) if wide else _Blocks(points, keys)


def seed_centres(
    points: DataFrame, sizes: DataFrame, keys: list[str], array_limit: int = ARRAY_LIMIT, point_id: str = "point_id", search: _Blocks | _Tiled | None = None
) -> DataFrame:
    """k-means|| in every group at once: (keys, cluster, c_lat, c_lon), ``k`` centres for each group of ``sizes(keys, k)``.

    From one point a group, each round draws every point with a chance of ``OVERSAMPLE * k`` times its share of the group's
    squared distances to the candidates so far (by a hash of its id, so a rerun draws the same). The candidates, weighted with the
    points nearest to them, are thinned out by k-means++: a group's in one block while they are few, else tile by tile,
    each block of at most ``SEED_BLOCK`` or so with its share of the centres. Only candidates are written to the checkpoint folder.
    """
    first = points.groupBy(*keys).agg(F.min(F.struct(F.xxhash64(point_id).alias("h"), point_id, "lat", "lon")).alias("s"))
    candidates = first.select(*keys, F.col(f"s.{point_id}").alias("cluster"), F.col("s.lat").alias("c_lat"), F.col("s.lon").alias("c_lon")).checkpoint()
    most = sizes.agg(F.max("k")).first()[0] or 1
    wide = most * OVERSAMPLE * SEED_ROUNDS > array_limit
    if search is None or wide != isinstance(search, _Tiled):
        search = _search(points, keys, wide)
    chord = F.sin(F.col("_d") / (2 * EARTH_RADIUS_KM))
    groups = sizes.count()
    for turn in range(SEED_ROUNDS):
        total = search.sums(candidates).groupBy(*keys).agg(F.sum("cost").alias("total")).join(sizes, keys)
        draw = F.pmod(F.xxhash64(F.lit(turn), point_id), F.lit(1 << 53)) / float(1 << 53)
        away = search.assigned(candidates).withColumn("cost", chord * chord)
        drawn = away.join(maybe_broadcast(total, rows=groups), keys).filter((F.col("total") > 0) & (draw < F.lit(OVERSAMPLE) * F.col("k") * F.col("cost") / F.col("total")))
        drawn = drawn.select(*keys, F.col(point_id).alias("cluster"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
        candidates = candidates.unionByName(drawn).distinct().checkpoint()
    weights = search.sums(candidates).select(*keys, "cluster", F.col("n").alias("weight"))
    c = candidates.join(weights, [*keys, "cluster"]).join(sizes, keys).join(candidates.groupBy(*keys).agg(F.count("*").alias("of_group")), keys)
    tile = F.when(F.col("of_group") > SEED_BLOCK, F.struct(tile_i("c_lat", 0.25).alias("i"), tile_j("c_lon", 0.25).alias("j"))).otherwise(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    c = c.withColumn("tile", tile)
    in_tile = c.groupBy(*keys, "tile").agg(F.ceil(F.count("*") / SEED_BLOCK).alias("parts"))
    c = c.join(in_tile, [*keys, "tile"]).withColumn("block", F.struct("tile", F.pmod(F.xxhash64("cluster"), F.col("parts")).alias("part"))).checkpoint()
    # a block's share of the centres by its share of the points, rounded so that they add up
    share = c.groupBy(*keys, "block").agg(F.sum("weight").alias("w"), F.first("k").alias("k"))
    by = W.partitionBy(*keys)
    to = F.round(F.sum("w").over(by.orderBy("block")) / F.sum("w").over(by) * F.col("k"))
    before = F.round((F.sum("w").over(by.orderBy("block")) - F.col("w")) / F.sum("w").over(by) * F.col("k"))
    share = share.select(*keys, "block", (to - before).cast("long").alias("quota")).filter("quota > 0")
    c = c.join(share, [*keys, "block"]).select(*keys, "block", "cluster", "c_lat", "c_lon", "weight", "quota")
    return c.groupBy(*keys, "block").applyInPandas(_thin_out, c.schema).select(*keys, "cluster", "c_lat", "c_lon")


def kmeans_sphere(
    points: DataFrame, keys: list[str], target: int = TARGET, iters: int = ITERATIONS, array_limit: int = ARRAY_LIMIT, point_id: str = "point_id"
) -> DataFrame:
    """Spherical k-means in every group at once, k = ceil(n / target): points with ``cluster``, the id of the point it was seeded from.

    Seeds by :func:`seed_centres`. Each round is one assignment join and one grouped mean; only the centres are written to the
    checkpoint folder. Rounds stop when no centre moves. A group of up to ``target`` points is one cluster, 0, without any round.
    """
    spark = points.sparkSession
    checkpoint_dir(spark)
    sizes = points.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(target)).cast("long").alias("k")).checkpoint()
    many = sizes.filter("k > 1")
    whole = points.join(sizes.filter("k = 1").select(*keys), keys, "left_semi").withColumn("cluster", F.lit(0).cast("long"))
    if many.isEmpty():
        return whole
    wide = many.agg(F.max("k")).first()[0] > array_limit
    split = points.join(many.select(*keys), keys, "left_semi")
    search = _search(split, keys, wide)
    centres = seed_centres(split, many, keys, array_limit, point_id, search).checkpoint()
    rows = centres.count()
    for _ in range(iters):
        moved = search.sums(centres, rows).select(*keys, "cluster", vector_lat(*map(F.col, "xyz")).alias("n_lat"), vector_lon(F.col("x"), F.col("y")).alias("n_lon"))
        # an empty cluster keeps its centre
        new = centres.join(moved, [*keys, "cluster"], "left").select(
            *keys, "cluster", F.coalesce("n_lat", "c_lat").alias("c_lat"), F.coalesce("n_lon", "c_lon").alias("c_lon"),
            F.coalesce(haversine_km("c_lat", "c_lon", "n_lat", "n_lon"), F.lit(0.0)).alias("step_km"),
        ).checkpoint()
        shift = new.agg(F.max("step_km")).first()[0] or 0.0
        centres = new.drop("step_km")
        if shift < 1e-6:
            break
    return whole.unionByName(search.assigned(centres, rows).drop("_d").select(*whole.columns))


def build_cells(coords: DataFrame, places: DataFrame, target: int = TARGET, iters: int = ITERATIONS) -> DataFrame:
    """Coordinates (point_id, lat, lon) → leaf cells: iso2, admin1, cluster, lat, lon, scale_km, count, name, log_prior."""
    spark = coords.sparkSession
    checkpoint_dir(spark)
    # a table may come in few files: the search for towns is spread however it is stored
    spread = coords.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    town = nearest_town(spread, places).join(places.select("place_id", "iso2", "admin1"), "place_id")
    pts = town.select("point_id", "lat", "lon", "iso2", "admin1")
    keys = ["iso2", "admin1"]
    labelled = kmeans_sphere(pts.checkpoint(), keys, target, iters).checkpoint()
    ck = [*keys, "cluster"]
    lat, lon = spherical_mean("lat", "lon")
    centre = labelled.groupBy(*ck).agg(lat.alias("c_lat"), lon.alias("c_lon"), F.count("*").alias("count"))
    d = labelled.join(centre.drop("count"), ck).withColumn("d", haversine_km("c_lat", "c_lon", "lat", "lon"))
    p68 = percentiles(d, ck, "d", {"p68": 0.68})
    cells = centre.join(p68, ck).select(
        *ck, F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), F.greatest("p68", F.lit(1.0)).alias("scale_km"), "count"
    )
    total = coords.agg(F.count("*")).scalar()
    cells = cells.withColumn("log_prior", F.log(F.col("count") / total))
    return name_cells(cells, places)


def name_cells(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Adds the name of the town nearest to each cell's centre."""
    named = nearest_town(cells, places)
    return named.join(places.select("place_id", "name"), "place_id").drop("place_id", "town_km")
