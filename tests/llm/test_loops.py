"""Periodic runs against a direct search over all periods, and the contract's digests."""

import hashlib
import random
import zlib

import pytest

from lumatlas.llm.loops import summary_loops
from lumatlas.llm.queries import QUERIES

from .conftest import pairs


def direct(words, least=6, copies=4):
    """Every maximal run, by trying each period; equal stretches keep the smallest."""
    found = {}
    for q in range(1, len(words) // copies + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, copies * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    runs = sorted((i, e - i, q) for (i, e), q in found.items())
    gone = {t for i, n, q in runs for t in range(i + q, i + n)}
    return runs, " ".join(w for t, w in enumerate(words) if t not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def random_texts():
    r = random.Random(7)
    out = []
    for k in range(120):
        words = [r.choice("abcdefgh"[: 1 + k % 4]) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            period = [r.choice("abc") for _ in range(r.randrange(1, 9))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (period * r.randrange(3, 8))[: len(period) * 5 + r.randrange(3)]
        out.append(" ".join(words))
    return out


def held(rows):
    return [(r.photo_id, r.n_words, [(x.start, x.length, x.period) for x in r.loops], r.collapsed) for r in rows]


def test_all_runs_are_found(shipped):
    texts = random_texts() + ["go " * 5, "go " * 6, "a b " * 4, "a b " * 3 + "a", "x\x1cy " * 9, "\t ", " lead  tail "]
    reports = shipped.createDataFrame(list(enumerate(texts)), "photo_id int, summary string").repartition(5)
    rows = held(summary_loops(reports).orderBy("photo_id").collect())
    assert rows == [(i, len(words_of(t)), *direct(words_of(t))) for i, t in enumerate(texts)]
    assert sum(len(r[2]) for r in rows) > 100


def test_long_period_in_a_long_summary(shipped):
    period = [f"w{i}" for i in range(4_000)]
    text = " ".join(["start"] * 3 + (period * 5)[:17_001] + ["end"] + ["loop", "loop"] * 9_000)
    row = summary_loops(shipped.createDataFrame([(1, text)], "photo_id int, summary string")).first()
    assert [tuple(x) for x in row.loops] == [(3, 17_001, 4_000), (17_005, 18_000, 1)]
    assert row.collapsed == " ".join(["start"] * 3 + period + ["end", "loop"])


def test_odd_rows(nasty, nothing):
    expected = sorted(((i, len(words_of(t)), *direct(words_of(t))) for i, t in pairs(nasty) if len(t) < 9000), key=repr)
    rows = held(summary_loops(nasty).collect())
    assert len(rows) == nasty.count()
    assert sorted((r for r in rows if len(r[3]) < 9000 and r[1] < 9000), key=repr) == expected
    assert summary_loops(nothing).collect() == []
    with pytest.raises(ValueError):
        summary_loops(nasty, copies=3)


def test_query_digests(spark):
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    looped = 0
    for r in rows:
        words = docs[r.doc_id]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:
            continue
        runs, collapsed = direct(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        looped += bool(best)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{i},{m},{q}\n" for i, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
    assert looped > 5
