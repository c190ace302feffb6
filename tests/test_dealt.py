"""Joins that deal crowded tiles out, counts without pairs, and what is compared in NumPy, against plain pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lumatlas.operators import boxcount, skyline, spatial, street


def spots(spark, n, seed, *names):
    rng = random.Random(seed)
    rows = [(k, 48.0 + rng.randrange(60) * 0.001, 2.0 + rng.randrange(60) * 0.001) for k in range(n)]
    return spark.createDataFrame(rows, f"{names[0]} bigint, {names[1]} double, {names[2]} double")


def test_dealt_pairs_meet_once(spark):
    a = spots(spark, 300, 1, "a", "p", "q").selectExpr("a", "p - 0.004 as s", "q - 0.004 as w", "p + 0.004 as n", "q + 0.004 as e")
    a, b = a.union(a.limit(3)), spots(spark, 400, 2, "b", "lat", "lon")
    box = ("s", "w", "n", "e")
    plain = sorted(spatial.box_join(a, b, box, 0.02).select("a", "b").collect())
    few = spatial.box_join(a, b, box, 0.02, deal=(7, 5))
    assert sorted(few.select("a", "b").collect()) == plain and len(plain) > 1000
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0] and "ShuffledHashJoin" in plan


def test_points_are_counted_as_by_hand():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 500):
        x, y = rng.integers(0, 20, n) / 2.0, rng.integers(0, 20, n) / 2.0
        b = np.sort(rng.integers(-2, 24, (200, 2, 2)) / 2.0, axis=2)
        edges = [lambda v, q: v >= b[q, 0, 0], lambda v, q: v <= b[q, 0, 1], lambda v, q: v >= b[q, 1, 0], lambda v, q: v <= b[q, 1, 1]]
        want = [int(((x >= k[0, 0]) & (x <= k[0, 1]) & (y >= k[1, 0]) & (y <= k[1, 1])).sum()) for k in b]
        assert boxcount.Points(x, y).count(*edges, 200).tolist() == want


def test_ring_counts_are_those_of_the_listed_images(spark, monkeypatch):
    monkeypatch.setattr(street, "COUNT_LEADS", 10)
    monkeypatch.setattr(street, "COUNT_IMAGES", 60)
    leads = spots(spark, 40, 4, "lead_id", "lead_lat", "lead_lon").withColumn("km2", F.when(F.col("lead_id") % 5 == 0, None).when(F.col("lead_id") % 2 == 0, 9.0).otherwise(25.0))
    images = spots(spark, 500, 5, "image_id", "lat", "lon").union(spark.createDataFrame([(900, None, 2.0), (901, float("nan"), 2.0), (902, 48.0, 2.0)], "image_id bigint, lat double, lon double"))
    want = street.images_in_rings(leads, images).groupBy("lead_id", "ring").agg(F.count("*").alias("images"))
    got = street.ring_counts(leads, images)
    assert sorted(got.select("lead_id", "ring", "images").collect()) == sorted(want.collect()) and want.count() > 60
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_ring_search_keeps_only_what_a_verdict_can_depend_on(spark):
    leads = spots(spark, 30, 6, "lead_id", "lead_lat", "lead_lon").withColumn("km2", F.lit(25.0))
    images = spots(spark, 900, 7, "image_id", "lat", "lon")

    def match(photos):
        k = (F.col("image_id") * 37 + F.col("lead_id") * 11) % 199
        inliers = F.when(k == 0, 60).when(k == 1, 39).when(k == 2, 29).when(k == 3, 41).otherwise(k % 20).cast("int")
        return photos.withColumn("inliers", inliers).withColumn("similarity", (k / 199.0).cast("double"))

    want = street.first_verified_ring(match(street.images_in_rings(leads, images)))
    for i in (images, images.union(images.limit(0))):
        got, read = street.search_outwards(leads, i, match)
        assert sorted(got.select("lead_id", "ring", "searched", "best_image_id").collect()) == sorted(want.select("lead_id", "ring", "searched", "best_image_id").collect())
    assert len({r.ring for r in want.collect()}) > 1 and read[0][1] == 30
    twice = street.search_outwards(leads, images.union(images), match)[0]
    assert sorted(twice.collect()) == sorted(got.collect())


def test_facing_building_as_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(street, "LOOKING", 9)
    monkeypatch.setattr(street, "LOOKED_AT", 11)
    rng = random.Random(8)
    at = lambda: (48.0 + rng.randrange(40) * 0.0001, 2.0 + rng.randrange(40) * 0.0001)
    cams = [(k, *at(), None if k % 13 == 0 else float(rng.randrange(36) * 10)) for k in range(120)]
    pois = [(k, *at(), "" if k % 17 == 0 else None if k % 19 == 0 else f"{k} Rue") for k in range(150)]
    want = {}
    for k, la, lo, heading in cams:
        for p, lat, lon, address in pois:
            dy, dx = (lat - la) * 111_320.0, (lon - lo) * 111_320.0 * math.cos(math.radians(la))
            d = math.sqrt(dx * dx + dy * dy)
            side = 80 / 111_320.0 / math.cos(math.radians(la))
            if address and d <= 80 and abs(lat - la) <= 80 / 111_320.0 and abs(lon - lo) <= side:
                view = None if heading is None else abs((math.degrees(math.atan2(dx, dy)) % 360 - heading + 180) % 360 - 180) <= 35
                want[k] = min(want.get(k, (2,)), (0 if view is None else 1 - view, round(d, 6), p, view, d))
    got = street.facing_building(spark.createDataFrame(cams, "image_id bigint, lat double, lon double, heading double"), spark.createDataFrame(pois, "poi_id bigint, lat double, lon double, address string"))
    assert {r.image_id: (r.poi_id, r.in_view, round(r.distance_m, 5)) for r in got.collect()} == {k: (v[2], v[3], round(v[4], 5)) for k, v in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_matches_in_boxes_are_those_of_listed_pairs(spark, monkeypatch):
    monkeypatch.setattr(skyline, "TRIED", 4)
    monkeypatch.setattr(skyline, "TRIED_ON", 7)
    rng = np.random.default_rng(9)
    views = [(k, 47.0 + float(rng.random()) * 0.4, 7.0 + float(rng.random()) * 0.4, rng.normal(size=36).tolist(), 1 + k % 2) for k in range(40)]
    lens = lambda n: {"q": rng.normal(size=n).tolist(), "w": np.ones(n).tolist()}
    photos = [(k, v[1] - 0.1, v[2] - 0.1, v[1] + 0.1, v[2] + 0.1, [30.0, 46.0, 63.0], [lens(4), lens(5), lens(7)], 1 + k % 3) for k, v in enumerate(views[:25])]
    v = spark.createDataFrame(views, "view_id bigint, lat double, lon double, pano array<double>, times bigint")
    p = spark.createDataFrame(photos, "photo_id bigint, s double, w double, n double, e double, fovs array<double>, angles array<struct<q:array<double>,w:array<double>>>, times bigint")
    pairs = p.drop("times").join(v.drop("times"), F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))).select("photo_id", "view_id", "pano")
    want = {(r.photo_id, r.view_id): r for r in skyline.match(p.select("photo_id", "angles", "fovs"), pairs, 10.0).collect()}
    got = skyline.match_in_boxes(p, v, ("s", "w", "n", "e"), 0.1, 10.0).collect()
    assert {(r.photo_id, r.view_id) for r in got} == set(want) and len(got) == len(want) > 60
    for r in got:
        w = want[r.photo_id, r.view_id]
        assert abs(r.rmse - w.rmse) < 1e-8 and (r.azimuth, r.fov, r.times) == (w.azimuth, w.fov, (1 + r.photo_id % 3) * (1 + r.view_id % 2))


def test_few_angles_score_like_many(monkeypatch):
    rng = np.random.default_rng(10)
    pano, angles = rng.normal(size=(20, 36)), [(rng.normal(size=n), rng.random(n) + 0.5) for n in (4, 6)]
    few = skyline._scores(angles, pano)
    monkeypatch.setattr(skyline, "TURNS", 1)
    for a, b in zip(few, skyline._scores(angles, pano), strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_candidates_in_one_place_share_panoramas(spark):
    part = [(r, c, 100 + (r * 37 + c * 11) % 300) for r in range(40) for c in range(40)]
    quad, g = skyline.quads(skyline.clean_elevation(spark.createDataFrame(part, "r int, c int, elev int"))).persist(), skyline.Grid(48.0, 7.0, 0.01, 40, 40)
    rng = np.random.default_rng(11)
    prof = spark.createDataFrame([(k, rng.random(320).tolist(), [1.0] * 320, 1.5) for k in range(3)], "photo_id bigint, y array<double>, w array<double>, aspect double")
    rows = [(k, 1, 47.8, 7.2, 9.0, 40.0 + k, 46.0, 1.0) for k in range(3)] + [(0, 2, 47.7, 7.1, 9.0, 10.0, 46.0, 1.0)]
    cand = spark.createDataFrame(rows, "photo_id bigint, rank int, lat double, lon double, rmse double, azimuth double, fov double, spacing_km double")
    seen, panoramas = [], skyline.block_panoramas
    try:
        skyline.block_panoramas = lambda v, *a, **k: (seen.append(v.count()), panoramas(v, *a, **k))[1]
        every = {(r.photo_id, r["rank"]): r for r in skyline.refine(cand, prof, quad, g, 10.0, 5.0, 8).collect()}
    finally:
        skyline.block_panoramas = panoramas
    assert seen == [2 * 49] and len(every) == 4
    for k in range(3):
        alone = skyline.refine(cand.filter(f"photo_id = {k}"), prof, quad, g, 10.0, 5.0, 8).collect()
        assert all(abs(r.rmse - every[k, r["rank"]].rmse) < 1e-9 and r.view_id == every[k, r["rank"]].view_id for r in alone)
