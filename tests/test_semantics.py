"""Behaviour the reference's own tests pin down, on small tables, and brute-force checks of folds and searches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatlas.functions import metadata, names, times
from lumatlas.operators import archive, evidence, fusion, places, results, retrieval, skyline, spatial, stats, street, textcues
from lumatlas.operators.cells import CellModel
from lumatlas.sources.tables import read_places

R = 6371.0088


def hav(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


# ---- a small world ------------------------------------------------------------------------------

CELLS = [
    (0, "Los Angeles", "US", "US/California", "NA", 34.05, -118.24),
    (1, "Barstow", "US", "US/California", "NA", 34.90, -117.02),
    (2, "New York", "US", "US/New York", "NA", 40.71, -74.01),
    (3, "Paris", "FR", "FR/Ile-de-France", "EU", 48.86, 2.35),
    (4, "Sydney", "AU", "AU/NSW", "OC", -33.87, 151.21),
    (5, "Perth", "AU", "AU/WA", "OC", -31.95, 115.86),
    (6, "London", "GB", "GB/England", "EU", 51.51, -0.13),
    (7, "Tokyo", "JP", "JP/Tokyo", "AS", 35.68, 139.69),
    (8, "Moscow", "RU", "RU/Moscow", "EU", 55.76, 37.62),
    (9, "Cape Town", "ZA", "ZA/Cape", "AF", -33.92, 18.42),
]
RULES = [
    ("joshua_tree", "Joshua tree", None, [(34.9, -116.2, 160.0, 800.0)], None, None, None, 0.01),
    ("left_hand_traffic", "left", {c: 6.0 for c in ("AU", "GB", "JP", "ZA")}, None, None, None, None, 0.08),
    ("eucalyptus", "Eucalyptus", {"AU": 12.0, "ZA": 3.0, "US": 1.2}, None, None, None, None, 0.3),
    ("snow_ground", "Snow", None, None, None, None, (35.0, 90.0, True, 4.0), 0.1),
]


@pytest.fixture(scope="module")
def world(spark):
    cells = spark.createDataFrame(
        [(*c, 30.0, 0.0) for c in CELLS],
        "leaf bigint, name string, iso2 string, admin1 string, continent string, lat double, lon double, scale_km double, log_prior double",
    )
    rules = spark.createDataFrame(RULES, evidence.RULE_SCHEMA)
    return cells, rules, CellModel(cells), evidence.rule_leaf(rules, cells).persist()


def dense_posterior(obs, temperature=1.0):
    lat = np.array([c[5] for c in CELLS])
    lon = np.array([c[6] for c in CELLS])
    total = np.zeros(len(CELLS))
    for rule, s in obs:
        _, _, countries, regions, _, _, band, other = next(r for r in RULES if r[0] == rule)
        r = np.ones(len(CELLS))
        if countries:
            r *= [countries.get(c[2], other) for c in CELLS]
        if regions:
            r *= other + sum(p * np.exp(-0.5 * (hav(a, b, lat, lon) / np.sqrt(sg**2 + 900)) ** 2) for a, b, sg, p in regions)
        if band:
            y = np.abs(lat) if band[2] else lat
            r *= np.where((y >= band[0]) & (y <= band[1]), band[3], other)
        total += np.log(1 - s + s * r)
    e = np.exp((total - total.max()) / temperature)
    return e / e.sum()


def located(spark, world, obs, temperature=1.0):
    cells, _, _, leafs = world
    model = CellModel(cells, temperature) if temperature != 1.0 else world[2]
    rows = [(p, r, s, 1.0) for p, items in obs.items() for r, s in items]
    o = spark.createDataFrame(rows, "photo_id bigint, rule string, score double, weight double")
    t = fusion.touched_posterior(evidence.sparse_evidence(o, leafs), model)
    return t, model


def test_sparse_posterior_equals_dense(spark, world):
    obs = {1: [("joshua_tree", 0.92)], 2: [("left_hand_traffic", 0.9)], 3: [("left_hand_traffic", 0.9), ("eucalyptus", 0.9), ("snow_ground", 0.4)]}
    for temperature in (1.0, 3.0):
        t, model = located(spark, world, obs, temperature)
        q0 = {r["leaf"]: r["q0"] for r in model.cells.collect()}
        got = {}
        for r in t.collect():
            got.setdefault(r["photo_id"], {"u": r["u"]})[r["leaf"]] = r["p"]
        for photo, items in obs.items():
            want = dense_posterior(items, temperature)
            have = [got[photo].get(i, q0[i] * got[photo]["u"]) for i in range(len(CELLS))]
            assert np.allclose(have, want, atol=1e-12)
            assert math.isclose(sum(have), 1.0, abs_tol=1e-9)


def test_distinctive_cue_localises_and_parents_outweigh_children(spark, world):
    t, model = located(spark, world, {1: [("joshua_tree", 0.92)], 2: [("left_hand_traffic", 0.9), ("eucalyptus", 0.9)], 3: [("snow_ground", 0.1)]})
    rows = {r["photo_id"]: r for r in fusion.locate_rows(fusion.photo_rows(t), model).collect()}
    assert rows[1]["h_iso2_key"] == "US" and rows[1]["resolution"] in ("city", "region")
    assert hav(rows[1]["out_lat"], rows[1]["out_lon"], 34.9, -116.2) < 250
    assert rows[2]["h_iso2_key"] == "AU"
    assert rows[3]["resolution"] == "world" and rows[3]["radius_km"] >= 5000
    for r in rows.values():
        m = [r[f"h_{lv}_mass"] for lv in ("continent", "iso2", "admin1", "leaf")]
        assert all(a >= b - 1e-9 for a, b in zip(m, m[1:], strict=False))


def test_temperature_softens(spark, world):
    sharp = fusion.decide(fusion.photo_rows(located(spark, world, {1: [("joshua_tree", 0.92)]})[0]), world[2]).first()
    t, model = located(spark, world, {1: [("joshua_tree", 0.92)]}, 3.0)
    assert fusion.decide(fusion.photo_rows(t), model).first()["h_iso2_mass"] < sharp["h_iso2_mass"]


# ---- geometry -----------------------------------------------------------------------------------


def test_antimeridian_and_nearest_index_are_exact(spark):
    rng = np.random.default_rng(1)
    sites = [(i, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180)), float(10 ** rng.uniform(1, 7))) for i in range(300)]
    pts = [(i, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for i in range(400)] + [(1000, 0.0, 179.95), (1001, 89.9, 10.0), (1002, -90.0, 0.0)]
    s = spark.createDataFrame(sites, "place_id bigint, lat double, lon double, population double")
    p = spark.createDataFrame(pts, "pid bigint, lat double, lon double")
    la, lo, pop = (np.array([x[i] for x in sites]) for i in (1, 2, 3))
    ix = places.town_index(s, 5.0)
    got = {r["pid"]: r["site_id"] for r in spatial.nearest(p, ix, tile_deg=5.0, broadcast=False).collect()}
    for pid, a, b in pts:
        assert got[pid] == int(np.argmin(hav(a, b, la, lo) - 2 * np.log10(np.maximum(pop, 10))))
    scaled = spatial.nearest_index(s.withColumn("k", F.log10("population")), "place_id", "k", scaled=True, tile_deg=5.0)
    got = {r["pid"]: r["site_id"] for r in spatial.nearest(p, scaled, scaled=True, tile_deg=5.0, broadcast=False).collect()}
    for pid, a, b in pts:
        assert got[pid] == int(np.argmin(hav(a, b, la, lo) / np.log10(pop)))


def test_keyed_index_on_occupied_tiles(spark):
    rng = np.random.default_rng(2)
    sites = [(i % 3, i, float(rng.uniform(40, 50)), float(rng.uniform(0, 10))) for i in range(90)]
    pts = [(i, i % 3, float(rng.uniform(40, 50)), float(rng.uniform(0, 10))) for i in range(200)]
    s = spark.createDataFrame(sites, "g int, sid bigint, lat double, lon double")
    p = spark.createDataFrame(pts, "pid bigint, g int, lat double, lon double")
    used = p.select("g", spatial.tile_i("lat", 0.25).alias("ti"), spatial.tile_j("lon", 0.25).alias("tj")).distinct()
    ix = spatial.nearest_index(s, "sid", tile_deg=0.25, keys=["g"], occupied=used)
    got = {r["pid"]: r["site_id"] for r in spatial.nearest(p, ix, tile_deg=0.25, broadcast=False, keys=["g"]).collect()}
    for pid, g, a, b in pts:
        own = [x for x in sites if x[0] == g]
        d = hav(a, b, np.array([x[2] for x in own]), np.array([x[3] for x in own]))
        assert got[pid] == own[int(np.argmin(d))][1]


def test_mean_shift_picks_a_mode_not_the_midpoint(spark):
    pts = [(38.72, -9.14), (38.73, -9.13), (38.71, -9.15), (41.15, -8.63)]
    df = spark.createDataFrame([(1, [(a, b, 1.0, -1, 0.0) for a, b in pts])], f"photo_id bigint, points {fusion.POINT_TYPE}")
    m = df.select(fusion.mean_shift("points", "10D").alias("m")).first()["m"]
    assert hav(m["lat"], m["lon"], 38.72, -9.14) < 3


# ---- text ---------------------------------------------------------------------------------------


def test_text_rules(spark):
    lines = ["вулиця Хрещатик, їжа", "서울특별시", "ถนนสุขุมวิท", "ラーメン 東京", "Hauptstraße 5", "Kossuth Lajos utca", "ul. Marszałkowska", "Rua Augusta",
             "www.padaria.com.br", "Tel. +48 22 123 45 67", "+351 21 000 0000", "Departures via London", "Gate 12", "Main Avenue boulevard"]
    df = spark.createDataFrame([(i, i, None, t) for i, t in enumerate(lines)], "photo_id bigint, line_id bigint, score double, text string")
    got = {}
    for r in textcues.analyse(df).collect():
        got.setdefault(r["photo_id"], set()).add(r["rule"])
    assert {"script:cyrillic", "letter:uk"} <= got[0]
    assert "script:hangul" in got[1] and "script:thai" in got[2]
    assert got[3] == {"script:kana"}
    assert "word:de_street" in got[4] and "letter:de" in got[4]
    assert "word:hu_street" in got[5] and {"word:pl_street", "letter:pl"} <= got[6] and "word:pt_street" in got[7]
    assert "tld:BR" in got[8] and got[9] == {"phone:48"} and got[10] == {"phone:351"}
    assert not got.keys() & {11, 12, 13}


# ---- metadata, leads, archive -------------------------------------------------------------------


def test_camera_metadata(spark):
    rows = [("2019:06:12 14:05:33", "37,46.494N"), ("2019-06-12T14:05:33.000Z", "122,25,9.9W"), ("0000:00:00 00:00:00", "+37.77"), (None, "x")]
    d = spark.createDataFrame(rows, "t string, x string").select(times.parse_taken("t").cast("string").alias("t"), metadata.xmp_coord("x").alias("x")).collect()
    assert [r["t"] for r in d] == ["2019-06-12 14:05:33", "2019-06-12 14:05:33", None, None]
    assert d[0]["x"] == pytest.approx(37.7749) and d[1]["x"] == pytest.approx(-122.41941667) and d[2]["x"] == 37.77 and d[3]["x"] is None


def test_leads_follow_precision_and_people_policy(spark):
    rows = [("region", False), ("city", False), ("street", False), ("street", True)]
    d = spark.createDataFrame(rows, "p string, people boolean")
    rep = F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.col("p").alias("precision"))
    res = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit("world").alias("resolution"), F.lit(0.0).alias("confidence"))
    km2 = [r[0]["km2"] if r[0] else None for r in d.select(names.search_lead(rep, res, "people")).collect()]
    assert km2 == [None, 25.0, 9.0, None]


ARCHIVE = (
    "photo_id bigint, group_id string, user_lat double, user_lon double, user_label string, "
    "result struct<lat:double,lon:double,label:string,resolution:string,confidence:double,scene:string,era:string>, "
    "report struct<lat:double,lon:double,precision:string,confidence:double,place_name:string>, "
    "street struct<verified:boolean,lat:double,lon:double,captured_at:string,address:string,in_view:boolean>, "
    "skyline struct<pinned:boolean,lat:double,lon:double,confidence:double>"
)


def test_group_inheritance(spark):
    def row(i, g, res=None, user=(None, None)):
        return (i, g, user[0], user[1], None, (*res, None, None) if res else None, None, None, None)

    base = [row(1, "g", (46.0, 7.0, "X", "street", 60.0)), row(2, "g", (10.0, 10.0, "X", "continent", 20.0)), row(3, "g"), row(4, None, (1.0, 1.0, "X", "country", 40.0))]
    got = {r["photo_id"]: r for r in archive.resolve(archive.with_own(spark.createDataFrame(base, ARCHIVE))).collect()}
    assert got[1]["location"]["source"] == "photo" and got[2]["location"]["source"] == "group" and got[2]["via"] == 1
    assert got[3]["location"]["lat"] == 46.0 and got[4]["location"] is None
    base[2] = row(3, "g", None, (40.0, -3.0))
    got = {r["photo_id"]: r for r in archive.resolve(archive.with_own(spark.createDataFrame(base, ARCHIVE))).collect()}
    assert got[3]["location"]["source"] == "you" and got[1]["location"]["lat"] == 40.0


def test_same_day_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 200)) * 1_800_000_000, bool(rng.random() < 0.15)) for i in range(400)]
    df = spark.createDataFrame(rows, "photo_id bigint, album_id int, micros bigint, pinned boolean")
    got = {r["photo_id"]: (r["near_id"], r["hours"]) for r in archive.same_day(df.drop("pinned"), df.filter("pinned").drop("pinned")).collect()}
    for i, a, t, _ in rows:
        opts = [(abs(t - u), j) for j, b, u, p in rows if p and j != i and a == b and abs(t - u) <= 12 * 3_600_000_000]
        assert got.get(i) == ((min(opts)[1], min(opts)[0] / 3.6e9) if opts else None)


def test_people_are_coarsened_to_city(spark):
    d = spark.createDataFrame([(48.8584, 2.2945, 0.2, "street", True), (48.8584, 2.2945, 0.2, "street", False)], "lat double, lon double, radius_km double, resolution string, people_main boolean")
    a, b = results.coarsen(d).collect()
    assert (a["lat"], a["lon"], a["radius_km"], a["resolution"], a["coarsened"]) == (48.9, 2.3, 10.0, "city", True)
    assert (b["lat"], b["resolution"], b["coarsened"]) == (48.8584, "street", False)
    off = results.coarsen(d, policy="off").collect()[0]
    assert off["resolution"] == "street" and not off["coarsened"]


# ---- folds and statistics -----------------------------------------------------------------------


def test_box_nms_against_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(1, "a", i, float(rng.random()), x, y, x + 0.3, y + 0.3) for i, (x, y) in enumerate(rng.random((60, 2)).tolist())]
    df = spark.createDataFrame(rows, "photo_id bigint, cue string, det_id bigint, score double, x0 double, y0 double, x1 double, y1 double")
    keep = []
    for r in sorted((r for r in rows if r[3] >= 0.25), key=lambda r: -r[3]):
        def iou(o, r=r):
            w, h = max(0, min(o[6], r[6]) - max(o[4], r[4])), max(0, min(o[7], r[7]) - max(o[5], r[5]))
            return w * h / (0.18 - w * h + 1e-9)
        if all(iou(o) < 0.5 for o in keep):
            keep.append(r)
    assert {r["det_id"] for r in street.box_nms(df).collect()} == {r[2] for r in keep}


def test_heading_diverse_and_viewpoints(spark):
    img = spark.createDataFrame([(1, i, float(i), h) for i, h in enumerate([0.0, 20.0, 50.0, 340.0, 100.0, 200.0])], "point_id bigint, image_id bigint, distance_m double, heading double")
    assert [r["image_id"] for r in street.heading_diverse(img).orderBy("rank").collect()] == [0, 2, 4]
    v = spark.createDataFrame([(1, i, 0.1 * i, 46.0 + 0.01 * i, 7.0, 1.0) for i in range(12)], "photo_id bigint, view_id bigint, rmse double, lat double, lon double, spacing_km double")
    assert [r["view_id"] for r in skyline.viewpoint_nms(v).orderBy("rank").collect()] == [0, 3, 6, 9]


def test_percentiles_and_quantile_match_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(np.round(rng.gamma(2, 3), 2)), float(rng.random())) for k in ("a", "b") for _ in range(500)] + [("a", 5.0, 1.0)] * 400
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r["k"]: r for r in stats.percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    wq = {r["k"]: r["quantile"] for r in stats.weighted_quantile(df, ["k"], "v", "w", 0.68).collect()}
    for k in ("a", "b"):
        x, w = np.array([r[1] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])
        assert got[k]["p50"] == pytest.approx(np.percentile(x, 50)) and got[k]["p99"] == pytest.approx(np.percentile(x, 99))
        o = np.argsort(x, kind="stable")
        assert wq[k] == x[o][np.searchsorted(np.cumsum(w[o]) / w.sum(), 0.68)]


def test_ivf_recall_and_exact_knn(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((8, 16))
    x = np.concatenate([c + 0.2 * rng.standard_normal((60, 16)) for c in centre])
    rows = [(i, [float(t) for t in r]) for i, r in enumerate(x)]
    ix = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = ix.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.knn(q, ix, k=5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i in range(0, 480, 40) for j in np.argsort(-(u @ u[i]))[:5]}
    assert exact == want
    # many blocks and slices give the same answer as one
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "SIDE_BYTES", 8 * 16 * 10)
        assert {(r["query_id"], r["vec_id"]) for r in retrieval.knn(q, ix, k=5).collect()} == want
        small = {(r["query_id"], r["vec_id"]) for r in retrieval.IvfIndex(ix, lists=8).search(q, k=5, probes=2).collect()}
        assert len(small & exact) >= 0.9 * len(exact)
    assert retrieval.knn(q.limit(0), ix, k=5).collect() == [] == retrieval.knn(q, ix.limit(0), k=5).collect()
    near = {(r["query_id"], r["vec_id"]) for r in retrieval.IvfIndex(ix, lists=8).search(q, k=5, probes=2).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


# ---- skyline ------------------------------------------------------------------------------------


def test_skyline_recovers_direction(spark):
    rng = np.random.default_rng(8)
    az = np.arange(360)
    panos = [np.interp(az, np.arange(0, 361, 20), np.append(h := rng.uniform(0, 12, 18), h[0])) for _ in range(20)]
    fov, true_az, f = 46.0, 130.0, 0.5 / np.tan(np.radians(23.0))
    x = (np.arange(320) + 0.5) / 320
    angles = np.interp((true_az + np.degrees(np.arctan((x - 0.5) / f))) % 360, np.append(az, 360), np.append(panos[7], panos[7][0]))
    y = 0.5 - np.tan(np.radians(angles - 2.0)) * f * 1.5
    prof = spark.createDataFrame([(1, y.tolist(), [1.0] * 320, 1.5, list(skyline.FOVS))], "photo_id bigint, y array<double>, w array<double>, aspect double, fovs array<double>")
    views = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(panos)], "photo_id bigint, view_id bigint, pano array<double>")
    m = skyline.match(skyline.lens_angles(prof, 1.0).select("photo_id", "fovs", "angles"), views, 1.0).orderBy("rmse").first()
    assert m["view_id"] == 7 and m["fov"] == 46.0 and m["rmse"] < 0.1
    assert abs((m["azimuth"] - true_az + 180) % 360 - 180) < 2.0


def test_voids_are_sea_level(spark):
    d = spark.createDataFrame([(0, 0, 100), (0, 1, -32768), (1, 0, 5), (1, 1, 7)], "r int, c int, elev int")
    assert [r["elev"] for r in skyline.clean_elevation(d).orderBy("r", "c").collect()] == [100.0, 0.0, 5.0, 7.0]


# ---- sources ------------------------------------------------------------------------------------


def test_places_without_region_or_population(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("population,name,iso2,lat,lon\n,Nowhere,XX,1.5,2.5\n7,Somewhere,XX,3,4\n")
    got = read_places(spark, str(f)).orderBy("name").collect()
    assert (got[0]["admin1"], got[0]["population"], got[0]["lat"]) == ("", 0.0, 1.5) and got[1]["population"] == 7.0


def test_a_source_may_fail_but_not_all(spark):
    a = spark.createDataFrame([(1, "A"), (2, "A")], "image_id bigint, src string")
    b = spark.createDataFrame([(2, "B"), (3, "B")], "image_id bigint, src string")
    got = {r["image_id"]: r["src"] for r in street.union_sources([None, a, b]).collect()}
    assert got == {1: "A", 2: "A", 3: "B"}
    with pytest.raises(ValueError):
        street.union_sources([None, None])


def test_sites_sharing_a_place_keep_only_those_that_can_win(spark):
    """Sixty towns in each of twelve places: lists stay as short as for twelve towns, and winners are those of the whole."""
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 12), float((i * 5) % 12), float(rng.choice([10.0, 1e3, 1e4, 1e5])), 20.0 + i % 3) for i in range(720)]
    s = spark.createDataFrame(rows, "place_id long, lat double, lon double, population double, scale_km double")
    p = spark.createDataFrame([(j, float(a), float(b)) for j, (a, b) in enumerate([*rng.uniform(-2, 14, (60, 2)), *[(i % 12, (i * 5) % 12) for i in range(12)]])], "pid long, lat double, lon double")
    for scaled, handicap in ((False, places.town_bias("population")), (True, "scale_km")):
        ix = spatial.nearest_index(s, "place_id", handicap, scaled=scaled, tile_deg=5.0)
        assert ix.agg(F.max(F.size("sites"))).first()[0] <= 12 * (3 if scaled else 1)
        got = {r.pid: r.site_id for r in spatial.nearest(p, ix, scaled=scaled, tile_deg=5.0).collect()}
        d = spatial.haversine_km("lat", "lon", "a", "b")
        h = places.town_bias("population") if not scaled else F.col("scale_km")
        score = F.round(d / h if scaled else d - h, 9)
        want = p.crossJoin(s.withColumnsRenamed({"lat": "a", "lon": "b"})).groupBy("pid").agg(F.min(F.struct(score.alias("s"), "place_id")).alias("m"))
        assert got == {r.pid: r.m.place_id for r in want.collect()}


def test_tile_size_follows_the_places_in_use(spark):
    """Three hundred towns in two places need no finer tiles than two towns."""
    s = spark.range(300).select(F.col("id").alias("place_id"), (F.col("id") % 2).cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.lit(100.0).alias("population"), F.lit(5.0).alias("scale_km"), F.col("id").alias("leaf"))
    assert places.town_tile_deg(s) == places.town_tile_deg(s, biased=False) == places.cell_tile_deg(s) == 5.0


def test_boxes_repeated_for_tiles_are_not_broadcast(spark):
    """The planner takes the repeated side for as small as its file; a box over many tiles then filled the driver."""
    b = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "box long, s double, w double, n double, e double")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 2.5, 1.0)], "pid long, lat double, lon double")
    j = spatial.box_join(b, p, ("s", "w", "n", "e"), 0.5)
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pid for r in j.collect()) == [1, 2]


@pytest.mark.parametrize("spread", [4, 400])
def test_nearby_meets_cells_before_images(spark, spread):
    """Crowded places, ties and far images against all pairs; few of a crowd's images are ever met."""
    rng = np.random.default_rng(spread)
    at = rng.integers(0, spread, (1200, 2)) * (0.0024 / spread)
    rows = [(i, 48.84 + float(a), 2.33 + float(b), float(i % 360), None if i % 5 == 0 else f"20{10 + i % 15}-01-01") for i, (a, b) in enumerate(at)]
    img = spark.createDataFrame(rows, "image_id long, lat double, lon double, heading double, captured_at string")
    p = spark.createDataFrame([(k, 48.84 + float(a), 2.33 + float(b)) for k, (a, b) in enumerate(rng.uniform(-0.001, 0.0034, (40, 2)))], "point_id long, lat double, lon double")
    got = {(r.point_id, r.rank): (r.image_id, r.distance_m) for r in street.nearby(p, img, 120.0).collect()}
    want = {}
    d_lat = 120 / 111_320.0
    for k, la, lo in p.collect():
        d_lon = 120 / (111_320.0 * math.cos(math.radians(la)))
        near = [(round(float(hav(la, lo, r[1], r[2])) * 1000, 1), r[0], r[4]) for r in rows if abs(r[1] - la) <= d_lat and abs(r[2] - lo) <= d_lon]
        near = list(enumerate(sorted(near, key=lambda x: x[:2])[:20]))
        late = sorted(near, key=lambda x: (x[1][2] is None, [-ord(c) for c in x[1][2] or ""], x[0]))[:8]
        want |= {(k, i + 1): (x[1], x[0]) for i, (_, x) in enumerate(late)}
    assert got == want
