"""Kneser-Ney perplexities against a plain dictionary model, and the limits."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumatlas.llm import quality

from .conftest import pairs

N = quality.ORDER


def plain_model(texts):
    pad = bytes(N - 1)
    counts = {N: Counter((pad + t)[i : i + N] for t in texts for i in range(len(t)))}
    for n in range(N - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(k, max(0.1 * k, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount[n] = lambda v, d=d: d[min(v, 3) - 1]
    total, left = defaultdict(int), defaultdict(float)
    for n, c in counts.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            left[n, g[:-1]] += discount[n](v)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        low = p(g[1:])
        if (n, g[:-1]) not in total:
            return low
        v = counts[n].get(g, 0)
        return ((v - discount[n](v)) if v else 0) / total[n, g[:-1]] + left[n, g[:-1]] / total[n, g[:-1]] * low

    return p


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_perplexities(shipped, monkeypatch, block, nasty):
    monkeypatch.setattr(quality, "BLOCK_BYTES", block)
    rng = random.Random(6)
    words = ["the", "on", "été", "ra", "mi", "xo", "stone"]
    learn = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).encode() for _ in range(40)]
    p = plain_model(learn)
    model = quality.kneser_ney(quality.count_grams(shipped.createDataFrame([(bytearray(t),) for t in learn], "summary binary")))
    got = quality.perplexities(nasty, model).collect()
    want = []
    for i, t in pairs(nasty):
        b = bytes(N - 1) + t.encode()
        logs = [math.log(p(b[k : k + N])) for k in range(len(t.encode()))]
        want.append((i is None, i or 0, len(logs), math.exp(-sum(logs) / len(logs)) if logs else -1))
    got = sorted((r.photo_id is None, r.photo_id or 0, r.n_bytes, r.perplexity if r.perplexity is not None else -1) for r in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=2e-3)


def test_junk_is_rejected_and_clean_text_kept(shipped, nothing):
    rng = random.Random(7)
    clean = lambda w: " ".join(rng.choice(w) for _ in range(60))
    en, de = ["the", "stone", "bridge", "near", "river", "at", "noon"], ["und", "brücke", "straße", "der", "bei", "mittag"]
    rows = [(i, clean(en if i % 2 else de), "en" if i % 2 else "de") for i in range(600)] + [(600, clean(en), None), (601, clean(en), "xx"), (602, None, "en"), (603, "", "en")]
    rows += [(700 + i, "".join(rng.choice("#$%&*+=@^~|<>[]") for _ in range(200)), "en") for i in range(5)] + [(710, "a" * 500, "de")]
    df = shipped.createDataFrame([(*r, "clash") for r in rows], "photo_id bigint, summary string, lang string, known string")
    trusted = df.filter("photo_id < 500").select("photo_id").union(df.limit(1).select(F.lit(None).cast("bigint")))
    got = {r.photo_id: r for r in quality.classify(df, trusted).collect()}
    assert len(got) == len(rows)
    assert sum(not got[i].kept for i in range(602)) < 30 and got[601].kept
    assert not any(got[i].kept for i in (*range(700, 705), 710, 602, 603)) and got[602].perplexity is None
    empty = df.limit(0)
    assert quality.classify(empty, trusted).count() == 0
    assert {r.kept for r in quality.classify(df.filter("photo_id < 20"), trusted.limit(0)).collect()} == {True}


def test_languages_with_few_trusted_summaries(shipped):
    """One to five held-out summaries are too few for quantiles; clean text of such a language is kept all the same."""
    rng = random.Random(9)
    en, own = ["the", "stone", "bridge", "near", "river", "at", "noon"], ["und", "brücke", "straße", "der", "bei", "mittag"]
    clean = lambda w: " ".join(rng.choice(w) for _ in range(60))
    rows, trusted = [(i, clean(en), "en") for i in range(500)], list(range(500))
    ids = {held: [r.id for r in shipped.range(1000, 1200).filter(F.pmod(F.xxhash64("id"), F.lit(5)).isin([0] if held else [1, 2, 3, 4])).collect()] for held in (True, False)}
    for lang, n, words in (("a1", 1, en), ("a2", 2, en), ("a5", 5, en), ("b1", 1, own), ("b5", 5, own)):
        known = [ids[True].pop() for _ in range(n)] + [ids[False].pop() for _ in range(4 * n)]
        rows += [(i, clean(words), lang) for i in known]
        trusted += known
        at = 2000 + len(rows)
        rows += [(at + i, clean(words), lang) for i in range(40)]
        rows += [(10 * at + i, "".join(rng.choice("#$%&*+=@^~|<>[]") for _ in range(200)), lang) for i in range(3)]
    df = shipped.createDataFrame(rows, "photo_id bigint, summary string, lang string")
    got = quality.classify(df, shipped.createDataFrame([(i,) for i in trusted], "photo_id bigint")).collect()
    kept = Counter((r.lang, r.photo_id >= 10_000) for r in got if r.kept and r.photo_id >= 2000)
    assert all(kept[lang, False] >= 37 and not kept[lang, True] for lang in ("a1", "a2", "a5", "b1", "b5")), kept
