"""Near copies against all pairs, and components against union-find."""

import random
import re

import pytest

from lumatlas.llm import nearcopies
from lumatlas.llm.components import smallest_reachable

from .conftest import pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(rows, k, percent=80):
    s = [x for x in sets(rows, k) if x[0] is not None and x[1]]
    links = [(a[0], b[0]) for n, a in enumerate(s) for b in s[:n] if 100 * len(a[1] & b[1]) >= percent * len(a[1] | b[1])]
    roots = union_find({i for i, _ in s}, links)
    return sorted(
        (i is None, i or 0, len(x), (roots[i] if x and i is not None else i) or 0, i is None or not x or roots[i] == i) for i, x in sets(rows, k)
    )


def result(df, **how):
    return sorted((r.photo_id is None, r.photo_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in nearcopies.near_copies(df, **how).collect())


@pytest.mark.parametrize("words, most", [(2, 2048), (2, 7), (5, 2048)])
def test_groups_equal_all_pairs(shipped, monkeypatch, words, most):
    monkeypatch.setattr(nearcopies, "SLICE", most)
    rng = random.Random(11)
    free = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, k = [], 0
    for size, copies in ((60, 70), (25, 10), (8, 10)):
        base = free(size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 8))):
                own[rng.randrange(size)] = free(1)[0]
            rows.append((k * 7 % 997, " ".join(own).upper() if rng.random() < 0.3 else "\n".join(own)))
            k += 1
    rows += [(2000 + j, " ".join(free(30))) for j in range(20)] + [(3000 + j, rows[0][1]) for j in range(5)] + [(4000, "a b"), (4001, "a b a b"), (4002, "A  b"), (4003, "a")]
    assert result(shipped.createDataFrame(rows, "photo_id bigint, summary string").repartition(4), words=words) == brute(rows, words)


def test_small_sets_meet_for_certain(shipped):
    """Small linked sets share one of their rarest shingles, whatever their bands."""
    rng = random.Random(13)
    free = lambda n: [f"v{rng.randint(0, 40)}" for _ in range(n)]
    rows = []
    for k in range(120):
        base = free(rng.randint(2, 36))
        rows.append((3 * k, " ".join(base)))
        own = list(base)
        own[rng.randrange(len(own))] = "odd"
        rows += [(3 * k + 1, " ".join(own)), (3 * k + 2, " ".join(base + ["more"]))]
    df = shipped.createDataFrame(rows, "photo_id bigint, summary string").repartition(4)
    assert result(df, words=2) == brute(rows, 2)
    few = [(i, sorted(hash(g) for g in s)) for i, s in sets(rows, 2)]
    keys = {r.node: set(r.rare) for r in nearcopies.rare_keys(shipped.createDataFrame(few, "node bigint, few array<bigint>"), 80).collect()}
    linked = 0
    for n, (i, a) in enumerate(few):
        for j, b in few[:n]:
            common = len(set(a) & set(b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                linked += 1
                assert keys[i] & keys[j]
    assert linked > 100


def test_odd_rows(nasty, nothing):
    rows = pairs(nasty)
    # an id that stands for several texts is one node
    got = {(r[1], r[2]): r[3] for r in result(nasty, words=2)}
    assert got[22, 14 + 2] == 21 and result(nothing) == []
    assert len(result(nasty, words=5)) == len(rows)


def test_components(shipped):
    rng = random.Random(12)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2080)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.root for r in smallest_reachable(shipped.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find(nodes, [x for x in links if x[0] != x[1]])
    assert smallest_reachable(shipped.createDataFrame([], "a bigint, b bigint")).count() == 0
