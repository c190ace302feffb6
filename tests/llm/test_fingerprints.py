"""Fingerprints: edited texts by hand, likeness against true likeness."""

import random

from pyspark.sql import functions as F

from lumatlas.llm import fingerprints as fp

from .conftest import pairs


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_texts_follow_the_next_report(shipped):
    for n in (1, 2, 37):
        rng = random.Random(n)
        rows = [(i * 3, "".join(rng.choice("aé日 b") for _ in range(rng.randint(0, 30)))) for i in range(n)] + [(None, "last é")]
        rng.shuffle(rows)
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = {}
        for k, (i, t) in enumerate(order):
            third = len(t) // 3
            want[i] = t[: len(t) - third] + order[(k + 1) % len(order)][1][:third]
        got = fp.compare_with_next(shipped.createDataFrame(rows, "photo_id bigint, summary string").repartition(3)).collect()
        assert {r.photo_id: r.summary_edited for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(dict(rows)[r.photo_id]) for r in got)


def test_likeness_is_near_the_true_one(shipped):
    rng = random.Random(5)
    rows, true = [], []
    for k in range(150):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([8, 20, 60, 400]))]
        cut = rng.randint(0, len(base))
        other = base[:cut] + [f"v{rng.randint(0, 10**6)}" for _ in range(len(base) - cut)]
        a, b = " ".join(base), " ".join(other)
        rows.append((k, a, b))
        true.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    df = shipped.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: r.s for r in df.select("k", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("s")).collect()}
    errors = [got[k] - t for k, t in enumerate(true)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_odd_rows(nasty, nothing):
    got = fp.fingerprint_reports(nasty).collect()
    assert len(got) == len(pairs(nasty))
    assert all(len(r.fingerprint) in (0, 256) and ".." not in r.fingerprint for r in got)
    assert {r.photo_id: r.fingerprint for r in got}[3] == ""
    by_id = {}
    for r in got:
        by_id.setdefault(r.photo_id, set()).add(r.fingerprint)
    assert by_id[22] == by_id[21] and len(by_id[21]) == 1  # equal texts
    assert fp.fingerprint_reports(nothing).count() == 0 and fp.compare_with_next(nothing).count() == 0
    assert fp.compare_with_next(nasty).count() == len(got)
