"""Toxicity: kernel by definition, held-out accuracy, disguised insults."""

import random
from itertools import combinations

import numpy as np
import pytest

from lumatlas.llm import toxicity as tox

from .conftest import pairs

INSULTS = ["idiot", "moron", "scum", "worthless", "pathetic"]


def kernel(a, b):
    def phi(w):
        out = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < tox.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + tox.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_features_are_the_subsequence_kernel():
    for a, b in (("idiot", "idxiot"), ("banana", "bandana"), ("abc", "abc"), ("aaaaaaa", "aaab"), ("stupid", "cupid")):
        x, y = tox.features(a), tox.features(b)
        assert sum(v * y.get(u, 0) for u, v in x.items()) == pytest.approx(kernel(a, b))


def comments(n, seed):
    rng = random.Random(seed)
    syllable = ["an", "the", "on", "er", "in", "ble", "ti", "ou", "ea", "st"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllable) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(shipped):
    rows = comments(400, 1)
    feedback = shipped.createDataFrame([r[:2] for r in rows] + [(900, None), (None, "idiot")], "feedback_id bigint, comment string")
    labels = shipped.createDataFrame([(r[0], r[2]) for r in rows] + [(900, 1), (901, 1), (5, None), (None, 1)], "feedback_id bigint, toxic int")
    return tox.train(feedback, labels)


def test_held_out_accuracy(shipped, model):
    rows = comments(300, 2)
    df = shipped.createDataFrame([r[:2] for r in rows], "feedback_id bigint, comment string")
    got = {r.feedback_id: r.score for r in tox.score_comments(df, model).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in rows]
    assert sum(right) >= 0.97 * len(rows)


def test_disguises(model):
    top = tox.Scorer(model).highest(["the on an ti", "you idiot", "you i d i o t", "you i.d.i.o.t!", "you MORON", "worth-less an", "an worthxless an"])
    plain, *insults = top.tolist()
    assert all(x > plain for x in insults)
    assert (model.probability(np.array(insults[:5])) >= 0.5).all() and model.probability(np.array([plain]))[0] < 0.5


def test_insult_of_a_small_language():
    """A language with one in a hundred toxic comments counts like any other, however many labels the others have."""
    rng = random.Random(8)
    syllable = ["ka", "zu", "mo", "ri", "pe", "lo", "shu", "ny"]
    other = lambda *bad: " ".join([*("".join(rng.choice(syllable) for _ in range(rng.randint(2, 4))) for _ in range(20)), *bad])
    rows = [(t, bad) for _, t, bad in comments(2000, 4)] + [(other(), 0) for _ in range(60)] + [(other("gralvex"), 1) for _ in range(5)]
    model = tox.fit([t for t, _ in rows], np.array([bad for _, bad in rows]))
    held = tox.Scorer(model).highest([other("gralvex"), other("Gralvex!"), other("g r a l v e x")] + [other() for _ in range(40)])
    found = model.probability(held) >= 0.5
    assert found[:3].all() and found[3:].sum() <= 2


def test_memory_is_bounded_and_changes_nothing(model, monkeypatch):
    rows = [r[1] for r in comments(60, 3)]
    whole = tox.Scorer(model).highest(rows)
    monkeypatch.setattr(tox, "ROOM", 10)
    small = tox.Scorer(model)
    assert np.array_equal(whole, np.concatenate([small.highest([r]) for r in rows]))


def test_odd_rows(nasty, nothing, model, shipped):
    got = tox.score_comments(nasty, model, feedback_id="photo_id", comment="summary").collect()
    assert len(got) == len(pairs(nasty)) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.feedback_id == 3] == [0.0]
    assert tox.score_comments(nothing, model, feedback_id="photo_id", comment="summary").count() == 0
    none = shipped.createDataFrame([], "feedback_id bigint, comment string")
    blank = tox.train(none, shipped.createDataFrame([], "feedback_id bigint, toxic int"))
    assert all(r.score < 0.5 for r in tox.score_comments(nasty, blank, feedback_id="photo_id", comment="summary").collect())
