"""Cells split by k-means against a NumPy fold over each group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatlas.operators import cellbuild


def unit(lat, lon):
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)


def fold(x, k, seed):
    """Spherical k-means from k points drawn at random, to its end: the sum of squared chords."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(60):
        to = np.argmax(x @ c.T, 1)
        new = np.array([x[to == j].sum(0) if (to == j).any() else c[j] for j in range(k)])
        c = new / np.linalg.norm(new, axis=1, keepdims=True)
    return ((x - c[np.argmax(x @ c.T, 1)]) ** 2).sum()


@pytest.mark.parametrize("block", [2048, 12])
def test_split_groups(spark, monkeypatch, block):
    monkeypatch.setattr(cellbuild, "SEED_BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for g, (n, towns) in enumerate([(900, 6), (390, 3), (1300, 9), (41, 1)]):
        at = np.stack([rng.uniform(-60, 60, towns), rng.uniform(-179, 179, towns)], 1)
        p = at[rng.integers(0, towns, n)] + rng.normal(0, 0.4, (n, 2))
        rows += [(g * 10_000 + i, f"N{g}", float(a), float(b)) for i, (a, b) in enumerate(p)]
    points = spark.createDataFrame(rows, "point_id bigint, iso2 string, lat double, lon double").repartition(4)
    target = 130
    got = cellbuild.kmeans_sphere(points, ["iso2"], target).collect()
    assert len(got) == len(rows)
    for g in ("N0", "N1", "N2", "N3"):
        own = [r for r in got if r.iso2 == g]
        x, to = unit(np.array([r.lat for r in own]), np.array([r.lon for r in own])), np.array([r.cluster for r in own])
        k = -(-len(own) // target)
        names = np.unique(to)
        assert len(names) == k
        c = np.array([x[to == j].sum(0) for j in names])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        near = x @ c.T
        # every point lies with its nearest centre: no round would move anything
        assert (near[np.arange(len(x)), np.searchsorted(names, to)] >= near.max(1) - 1e-9).all()
        cost = ((x - c[np.searchsorted(names, to)]) ** 2).sum()
        assert cost <= 1.05 * np.median([fold(x, k, s) for s in range(9)])


def test_wide_groups_and_equal_points(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "N1", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 3, (600, 2)))] + [(1000 + i, "N2", 5.0, 5.0) for i in range(50)]
    points = spark.createDataFrame(rows, "point_id bigint, iso2 string, lat double, lon double")
    wide = cellbuild.kmeans_sphere(points, ["iso2"], 20, iters=4, array_limit=8)
    counts = {r.iso2: (r.n, r.c) for r in wide.groupBy("iso2").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("c")).collect()}
    assert counts["N1"][0] == 600 and counts["N1"][1] >= 28 and counts["N2"] == (50, 1)


def test_many_centres_of_a_group_need_no_tile_index(spark, monkeypatch):
    def index(*_, **__):
        raise AssertionError("a group's centres fit one array")

    monkeypatch.setattr(cellbuild, "nearest_index", index)
    rng = np.random.default_rng(8)
    rows = [(i, "N1", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 1500), rng.uniform(-179, 179, 1500), strict=True))]
    points = spark.createDataFrame(rows, "point_id bigint, iso2 string, lat double, lon double")
    got = cellbuild.kmeans_sphere(points, ["iso2"], 50, iters=2).collect()
    assert len(got) == 1500 and len({r.cluster for r in got}) == 30


def test_closest_among_neighbours_is_exact():
    rng = np.random.default_rng(3)
    c = unit(rng.integers(-60, 60, 400), rng.integers(-179, 179, 400))  # on a grid: ties
    for _ in range(40):
        x = unit(rng.integers(0, 9, 50) + rng.integers(-60, 50), rng.integers(0, 9, 50) + rng.integers(-179, 170))
        few = cellbuild._near(x, c)
        best, km = cellbuild._closest(x, c[few])
        all_km = 2 * 6371.0088 * np.arcsin(np.sqrt(((x[:, None] - c[None]) ** 2).sum(2)) / 2)
        whole = np.rint(all_km * 1e9).argmin(1)
        assert (few[best] == whole).all() and np.allclose(km, all_km[np.arange(50), whole] * cellbuild.EARTH_RADIUS_KM / 6371.0088)
