"""Licence scan against a search of every word."""

import random
import re

from lumatlas.llm import licences

from .conftest import pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(note):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", note.translate(LOWER))
    places = []
    for t in licences.BASE:
        p = t.text.split()
        places += [(t.label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(places, key=lambda x: x[1])


def test_base_places_equal_brute_force(shipped):
    rng = random.Random(2)
    parts = ["under the MIT license", "Under-the-mit", "license", "cc BY nc", "CC", "by", "Apache License, Version 2.0", "mit", "über", "the", "x1"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    got = {r.photo_id: r for r in licences.scan_licences(shipped.createDataFrame(rows, "photo_id bigint, note string")).collect()}
    for i, note in rows:
        n, places = brute(note)
        assert got[i].n_words == n and sorted((p.at, p.label) for p in got[i].base_places) == sorted((at, lab) for lab, at in places), note
        assert {p.label for p in got[i].base_places} <= {x.label for x in got[i].licences}


def test_templates_by_position(shipped):
    mit, gpl = (next(t for t in licences.NOTICES if t.label == lab) for lab in ("mit", "gpl"))
    shuffled = gpl.text.split()
    random.Random(1).shuffle(shuffled)
    notes = [
        (1, "Intro. " + mit.text.replace("copy of", "(copy) of,").upper()),
        (2, "a b c " + gpl.text.replace("you can", "you surely can")),
        (3, " ".join(shuffled)),
        (4, gpl.text.replace("general public", "public general")),  # without its mandatory phrase
        (5, "This photo is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        (6, "an ordinary note about the free software of the foundation"),
    ]
    got = {r.photo_id: {x.label: x.share for x in r.licences} for r in licences.scan_licences(shipped.createDataFrame(notes, "photo_id bigint, note string")).collect()}
    assert got[1]["mit"] > 0.95 and got[2]["gpl"] > 0.95 and "cc-by-nc" in got[5] and "cc-by" not in got[5]
    assert not got[3] and "gpl" not in got[4] and not got[6]


def test_corpus_without_full_notices(shipped):
    """Template words that no note holds take no votes from those that stand there."""
    short = "This work is licensed under the GNU General Public License, version 3."
    notes = [
        (1, short),
        (2, "The stone bridge near the river. " * 20 + short + " And so on, at noon. " * 20),
        (3, "Free software of the foundation, you can modify or redistribute this program as published: the GNU General Public License."),
        (4, "This work is licensed under the General Public GNU License, version 3."),
        (5, "The license of the general public, a gnu."),
    ]
    notes += [(10 + i, "an ordinary note of the river and the license") for i in range(30)]
    got = {r.photo_id: r.licences for r in licences.scan_licences(shipped.createDataFrame(notes, "photo_id bigint, note string")).collect()}
    assert [x.label for x in got[1]] == [x.label for x in got[2]] == [x.label for x in got[3]] == ["gpl"]
    assert got[1][0].share == got[2][0].share == 1 and abs(got[2][0].at - 122) <= licences.SLACK
    assert not any(got[i] for i in got if i > 3)


def by_hand(words, df, n, templates=licences.BASE + licences.NOTICES):
    """Labels by trying every start of every template: enough of the note's rarest telling words near their places, all phrases there."""
    found = {}
    for t in templates:
        text = t.text.split()
        if t.base:
            if any(words[i : i + len(text)] == text for i in range(len(words))):
                found[t.label] = t
            continue
        mandatory = {w for p in t.key_phrases for w in p.split()}
        rank = lambda w: (df[w], text.index(w))
        known = sorted((w for w in set(text) - mandatory if df.get(w)), key=rank)
        telling = [w for w in known if df[w] <= df[known[len(known) // 2]]] if known else []
        own = sorted((w for w in telling if w in words), key=lambda w: (df[w], w))[: licences.RAREST]
        if not telling or len(own) < min(licences.VOTES, len(telling)):
            continue
        for start in range(-len(text), len(words)):
            near = [w for w in own if any(w in words[max(0, start + i - licences.SLACK) : max(0, start + i + licences.SLACK + 1)] for i, x in enumerate(text) if x == w)]
            window = " ".join(words[max(0, start - licences.SLACK) : max(0, start + len(text) + licences.SLACK)])
            exact = any(start == at - i for w in own for at, x in enumerate(words) if x == w for i, y in enumerate(text) if y == w)
            if exact and len(near) >= min(licences.VOTES, len(telling)) and all(f" {p} " in f" {window} " for p in t.key_phrases):
                found[t.label] = t
                break
    return set(found) - {t.wider for t in found.values()}


def test_labels_equal_a_search_of_every_start(shipped):
    rng = random.Random(5)
    vocabulary = sorted({w for t in licences.NOTICES for w in t.text.split()})
    notes = []
    for i in range(160):
        words = [rng.choice([*vocabulary, "river", "stone"]) for _ in range(rng.randint(0, 40))]
        for t in rng.sample(licences.NOTICES, rng.randint(0, 2)):
            text = [w for w in t.text.split() if rng.random() > rng.choice([0, 0, 0.05, 0.3])]
            at = rng.randint(0, len(words))
            words[at:at] = text
        notes.append((i, " ".join(words)))
    df = {}
    for _, note in notes:
        for w in set(note.split()):
            df[w] = df.get(w, 0) + 1
    got = {r.photo_id: {x.label for x in r.licences} for r in licences.scan_licences(shipped.createDataFrame(notes, "photo_id bigint, note string")).collect()}
    assert got == {i: by_hand(note.split(), df, len(notes)) for i, note in notes}
    assert sum(map(len, got.values())) > 100 and len(set().union(*got.values())) > 18


def test_every_licence_is_told_from_the_others(shipped):
    notes = [(i, f"intro {t.text} outro") for i, t in enumerate(licences.NOTICES)]
    got = {r.photo_id: {x.label for x in r.licences} for r in licences.scan_licences(shipped.createDataFrame(notes, "photo_id bigint, note string")).collect()}
    assert len({t.label for t in licences.NOTICES}) >= 24
    for i, t in enumerate(licences.NOTICES):
        assert t.label in got[i] and got[i] <= {t.label, "apache-2"}, (t.label, got[i])


def test_rare_words_find_and_phrases_only_verify():
    df = {w: 3 for t in licences.NOTICES for w in t.text.split()}
    df = {w.encode(): n for w, n in df.items()}
    index = licences.LicenceIndex.build(licences.BASE + licences.NOTICES, df, 1000)
    for t in licences.NOTICES:
        words = licences.words_of(t.text.encode())
        assert t.label in {x[0] for x in index.scan(words)[1]}
        phrases = licences.words_of(" and ".join(t.key_phrases).encode())
        assert not index.scan(phrases)[1], "a phrase without its surroundings is no licence"
    index.postings.clear()
    assert not any(index.scan(licences.words_of(t.text.encode()))[1] for t in licences.NOTICES), "without its rare words nothing is found"


def test_odd_rows(nasty, nothing):
    got = licences.scan_licences(nasty, note="summary").collect()
    want = sorted((i is None, i or 0, brute(t)[0]) for i, t in pairs(nasty))
    assert sorted((r.photo_id is None, r.photo_id or 0, r.n_words) for r in got) == want
    assert licences.scan_licences(nothing, note="summary").count() == 0
