"""Top-k search against a full scan."""

import random

import pytest

from lumatlas.llm import neighbours


def brute(index, queries, k, scale=1024):
    import math

    def clean(rows):
        ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        return [(i, [math.floor(x * scale) for x in v]) for i, v in ok]

    out = []
    for q, v in {(i, tuple(v)) for i, v in clean(queries)}:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in clean(index) if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("size, slices, block", [(8192, 8192, 16384), (400, 7, 5)])
def test_equals_full_scan(shipped, monkeypatch, size, slices, block):
    monkeypatch.setattr(neighbours, "SLICE", slices)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    rng = random.Random(21)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, list(rows[3][1])) for i in range(40)]  # one very common vector
    rows += [(600, None), (601, [1.0, None, 0.0]), (602, [float("nan")] * 6), (603, [float("inf"), 0.0]), (604, []), (605, [2.0, 1.0]), (None, [1.0] * 6)]
    rows += [rows[0], rows[100]]
    df = shipped.createDataFrame([(*r, "clash", "clash") for r in rows], "photo_id bigint, embedding array<double>, vec string, cell string").repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = neighbours.nearest_photos(df, df.filter("photo_id % 20 = 0"), k=4).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 4)


def test_few_and_none(shipped):
    kind = "photo_id bigint, embedding array<float>"
    few = shipped.createDataFrame([(1, [1.0, 0.5]), (2, [0.25, 1.0])], kind)
    assert sorted(map(tuple, neighbours.nearest_photos(few, few).collect())) == brute([(1, [1.0, 0.5]), (2, [0.25, 1.0])], [(1, [1.0, 0.5]), (2, [0.25, 1.0])], 10)
    none = shipped.createDataFrame([], kind)
    assert neighbours.nearest_photos(none, few).count() == 0 and neighbours.nearest_photos(few, none).count() == 0


def test_large_numbers_stay_exact(shipped):
    rows = [(1, [40000.0, 1 / 1024, 90000.0]), (2, [90000.0, 2 / 1024, 40000.0]), (3, [90000.0, 3 / 1024, 40000.0]), (4, [-1.0, 0.0, 0.0])]
    df = shipped.createDataFrame(rows, "photo_id bigint, embedding array<double>")
    assert sorted(map(tuple, neighbours.nearest_photos(df, df, k=2).collect())) == brute(rows, rows, 2)
