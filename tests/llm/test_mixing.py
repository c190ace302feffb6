"""Source targets by repeated sharing, and what a mix takes."""

import random

import pytest
from pyspark.sql import functions as F

from lumatlas.llm import mixing


def targets(sizes):
    """Share by weight, stop sources at three times their size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, left, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            out[s] += left * weight[s] / total
        left = 0.0
        for s in sorted(free, key=str):
            if out[s] >= 3 * sizes[s]:
                left += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                free = free - {s}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takes(shipped, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "src10", "src2"]
    rows = [(i, rng.choice(names[: 2 + 2 * seed + 1]), " ".join(["w"] * rng.choice([0, 1, 3, 40 if i % 9 else 90]))) for i in range(400)]
    rows += [rows[0], (None, "a", "x y"), (None, "a", None), (7, "only empty", "")]
    df = shipped.createDataFrame([(*r, "clash") for r in rows], "photo_id bigint, source string, summary string, run string").repartition(3)
    good = shipped.createDataFrame([(i, 0.5 + i % 4) for i in range(0, 400, 2)] + [(5, None), (7, -1.0), (9, 2.0), (9, 3.0)], "photo_id bigint, quality double")
    first = mixing.mix_sources(df, quality=good).select("photo_id", "source", "summary", "run", "mix.*").collect()
    again = mixing.mix_sources(df.repartition(5), quality=good).select("photo_id", "source", "summary", "run", "mix.*").collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {}
    for r in first:
        assert r.size == len((r.summary or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    copies = {}
    for r in first:
        copies.setdefault(r.source, set()).add(r.copies if r.size else None)
    # complete epochs come before any further copy
    assert all(len(c - {None}) <= 2 and (max(c - {None}) - min(c - {None}) <= 1) for c in copies.values() if c - {None})
    mixed = mixing.repeated(mixing.mix_sources(df, quality=good))
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in first)


def test_better_reports_are_likelier(shipped):
    df = shipped.range(3000).select(F.col("id").alias("photo_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.lit("x y z").alias("summary"))
    good = shipped.range(0, 3000, 2).select(F.col("id").alias("photo_id"), F.lit(4.0).alias("quality"))
    r = mixing.mix_sources(df, quality=good, weights=(1.0, 2.0)).filter("source = 'a'").groupBy(F.col("photo_id") % 2).agg(F.avg("mix.copies")).collect()
    share = {x[0]: x[1] for x in r}
    assert share[0] > share[1] + 0.2


def test_empty_table(shipped):
    none = shipped.createDataFrame([], "photo_id bigint, source string, summary string")
    assert mixing.mix_sources(none).count() == 0 and mixing.repeated(mixing.mix_sources(none)).count() == 0
