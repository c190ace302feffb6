"""Spelling variants against pairwise comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lumatlas.llm.queries import QUERIES
from lumatlas.llm.variants import spelling_variants, word_counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def direct(counts, ratio=10):
    out = {}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w, n in counts.items():
        others = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if x != w and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    full = {}
    for w, (form, n, links, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, n, links, form_n)
    return full


def held(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_all_neighbours_are_found(shipped):
    r = random.Random(3)
    base = ["aabbaab", "strasse", "überweg", "bahnhof", "aaaaaaa"]
    counts = Counter()
    for w in base:
        counts[w] += 2000
        for _ in range(60):
            v, times = w, r.choice([2, 3, 15, 150])
            for _ in range(r.randrange(1, 4)):
                i = r.randrange(len(v) + 1)
                v = r.choice([v[:i] + r.choice("abß") + v[i:], v[:i] + v[i + 1 :], v[:i] + r.choice("abü") + v[i + 1 :]])
            counts[v] += times
    rows = [(w, n) for w, n in counts.items()]
    lines = shipped.createDataFrame(rows, "w string, n int").selectExpr("w as text", "explode(sequence(1, n)) as word").repartition(4)
    wanted = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = held(spelling_variants(lines))
    assert got == direct(wanted)
    assert any(v[0] and got[v[0]][0] for v in got.values()), "a chain of forms"


def test_words_of_lines(shipped):
    lines = [None, "", "Bahnhof-bahnhof", "ÜBERWEG überweg ÜBERWEG", "kürzer", "strasse1strasse", "naïveté×÷ naïveté×÷", "a" * 100_000, "a" * 100_000, "日本語のテキスト日本語"]
    df = shipped.createDataFrame([(t, "x") for t in lines], "text string, word string")
    assert {r.word: r.n for r in word_counts(df).collect()} == {"bahnhof": 2, "strasse": 2, "naïveté×÷": 2, "Überweg": 2} | {"a" * 100_000: 2}


def test_odd_rows(nasty, nothing):
    counts = Counter()
    for r in nasty.collect():
        counts.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.summary or "")) if len(w) >= 7)
    got = held(spelling_variants(nasty.filter("summary is null or summary not like 'añb%'").withColumn("n", nasty["id"]), text="summary"))
    assert {w: v[2] for w, v in got.items()} == {w: n for w, n in counts.items() if n >= 2 and not w.startswith("añb")}
    assert spelling_variants(nothing, text="summary").collect() == []
    with pytest.raises(ValueError):
        spelling_variants(nasty, text="summary", ratio=1)


def test_query_against_all_pairs(spark):
    counts = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    wanted = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = held(QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001"))
    assert got == direct(wanted) and sum(v[0] is not None for v in got.values()) > 0
