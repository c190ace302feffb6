"""Repeated passages against brute force over all 50-byte strings."""

import random

import numpy as np
import pytest

from lumatlas.llm import passages

from .conftest import pairs


def brute(rows):
    """(id, bytes) -> per row the removed flags."""
    first = {}
    for i, b in rows:
        own = passages.LAST if i is None else i
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, own), own)
    out = []
    for i, b in rows:
        own = passages.LAST if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, b, bytes(gone)))
    return out


def check(df, rows):
    want = []
    for i, b, gone in brute(rows):
        edges = [k for k in range(len(b) + 1) if (k > 0 and gone[k - 1]) != (k < len(b) and gone[k])]
        want.append((i is None, i or 0, len(b), list(zip(edges[::2], edges[1::2], strict=True)), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = [(r.photo_id is None, r.photo_id or 0, r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in passages.remove_repeats(df).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block, dictionary, frequent", [(8 << 20, 1 << 20, 20_000), (2000, 20, 20_000), (2000, 20, 2)])
def test_repeats_equal_brute_force(shipped, monkeypatch, block, dictionary, frequent):
    monkeypatch.setattr(passages, "BLOCK_BYTES", block)
    monkeypatch.setattr(passages, "DICTIONARY", dictionary)
    monkeypatch.setattr(passages, "FREQUENT", frequent)
    rng = random.Random(8)
    syllable = ["on", "the", "ra", "mi ", "été ", "xo", "le", " ", "\n"]
    free = lambda n: "".join(rng.choice(syllable) for _ in range(n))
    common = [free(k) for k in (24, 26, 30, 45, 80)]
    rows = [(k, "".join(rng.choice([free(12), rng.choice(common)]) for _ in range(6))) for k in range(120)]
    rows += [(200 + k, rows[k][1][: 40 + 17 * k]) for k in range(12)] + [(None, rows[5][1]), (7, rows[7][1]), (300, "a" * 400), (301, "a" * 130), (302, common[0])]
    check(shipped.createDataFrame(rows, "photo_id bigint, summary string").repartition(4), [(i, t.encode()) for i, t in rows])


def test_suffix_orders():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, passages.PHRASE), dtype=np.uint8)
    rows[100:200, 20:] = rows[7, 20:]
    for a, order in passages.suffix_orders(rows):
        suffixes = [rows[i, a:].tobytes() for i in order]
        assert suffixes == sorted(suffixes)


def test_long_texts_go_part_by_part(shipped, monkeypatch):
    monkeypatch.setattr(passages, "PART_BYTES", 300)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    rows = [(1, base), (2, base[1000:1900] + base[:700]), (3, "".join(rng.choice("abc ") for _ in range(700)))]
    check(shipped.createDataFrame(rows, "photo_id bigint, summary string"), [(i, t.encode()) for i, t in rows])


def test_odd_rows_and_extra_columns(nasty, nothing):
    check(nasty, [(i, t.encode()) for i, t in pairs(nasty)])
    assert passages.remove_repeats(nothing).count() == 0
    assert passages.remove_repeats(nasty, carry=("size", "text")).select("carried.size").distinct().count() == 1
