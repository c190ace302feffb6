"""Licence scan of photo notes by a positional index of licence words, in which each note's rarest are looked up."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Rarest words of a template in a note that are looked up, how many of them must agree on a place, and words a place may be off by.
RAREST, VOTES, SLACK = 8, 3, 3


@dataclass(frozen=True)
class Template:
    """A licence text: ``key_phrases`` must all be there. ``base``: the text is one phrase that must stand as it is.

    ``wider``: the label of a licence whose text this one also holds, and which doesn't count where this one stands.
    """

    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    base: bool = False
    wider: str = ""


# The phrases that count as a licence by themselves.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)

# Opening words of public licences and of the notices that name them, with the phrases that tell them apart.
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this photo is licensed under a creative commons {} 4 0 international license to view a copy of this license visit http creativecommons org licenses {} 4 0"
_CC_SHORT = "this photo is licensed under a creative commons {} 4 0 international license"
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software",
        ("apache license", "in compliance with the license"),
    ),
    Template("bsd-2", _BSD, ("redistribution and use", "source and binary forms")),
    Template(
        "bsd-3",
        _BSD + " 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("redistribution and use", "source and binary forms", "neither the name"),
        wider="bsd-2",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template("gpl", _GNU.format("gnu general public license", "3"), ("gnu general public license",)),
    Template("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("lgpl", _GNU.format("gnu lesser general public license", "3").replace("program", "library"), ("gnu lesser general public license",)),
    Template("agpl", _GNU.format("gnu affero general public license", "3"), ("gnu affero general public license",)),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    Template(
        "epl-2",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www "
        "eclipse org legal epl 2 0",
        ("eclipse public license",),
    ),
    Template(
        "cddl",
        "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file "
        "except in compliance with the license",
        ("common development and distribution license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("released into the public domain", "unencumbered software"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
        "the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
        "and redistribute it freely",
        ("without any express or implied warranty", "permission is granted to anyone"),
    ),
    Template(
        "bsl-1",
        "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license",
        ("boost software license",),
    ),
    Template(
        "wtfpl",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name "
        "is changed do what the fuck you want to public license",
        ("do what the fuck you want to",),
    ),
    Template(
        "artistic-2",
        "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed "
        "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
        ("artistic license 2 0",),
    ),
    Template(
        "ofl-1",
        "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at "
        "http scripts sil org ofl",
        ("sil open font license",),
    ),
    Template(
        "odbl-1",
        "this database is made available under the open database license http opendatacommons org licenses odbl 1 0 any rights in individual contents of "
        "the database are licensed under the database contents license",
        ("open database license",),
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under the creative commons "
        "cc0 1 0 universal public domain dedication",
        ("has waived all copyright", "related or neighboring rights"),
    ),
    *(
        Template(label, form.format(name, label.removeprefix("cc-").replace("-", " ")), (f"creative commons {name}" + (" 4 0" if label == "cc-by" else ""),), wider=wider)
        for label, name, wider in (
            ("cc-by", "attribution", ""),
            ("cc-by-sa", "attribution sharealike", ""),
            ("cc-by-nd", "attribution noderivatives", ""),
            ("cc-by-nc", "attribution noncommercial", ""),
            ("cc-by-nc-sa", "attribution noncommercial sharealike", "cc-by-nc"),
            ("cc-by-nc-nd", "attribution noncommercial noderivatives", "cc-by-nc"),
        )
        for form in (_CC, _CC_SHORT)
    ),
)

#: Lower-cases A-Z; everything but ASCII letters, digits and bytes from 0x80 on separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(note: bytes) -> list[bytes]:
    return note.translate(_TABLE).split()


@dataclass
class LicenceIndex:
    """Inverted index of the templates' telling words: word -> (template, places of the word in it)."""

    templates: list[tuple[Template, list[bytes], list[list[bytes]]]]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, list[int]]]] = field(default_factory=dict)
    #: Words that must agree on a place of each template; 0: the template can't be found.
    needed: list[int] = field(default_factory=list)
    #: The rarest word of each base phrase: (phrase, place in it).
    anchors: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)

    @staticmethod
    def build(templates: tuple[Template, ...], df: dict[bytes, int], n: int) -> LicenceIndex:
        """A template's telling words are those some note holds, outside its key phrases, of at least the median IDF among them."""
        own = [(t, words_of(t.text.encode()), [words_of(p.encode()) for p in t.key_phrases]) for t in templates]
        index = LicenceIndex(own, {w: math.log((1 + n) / (1 + df.get(w, 0))) for _, words, _ in own for w in words})
        postings: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (t, words, keys) in enumerate(own):
            if t.base:  # a base phrase stands wherever its rarest word does, so one word finds every place
                index.needed.append(0)
                rarest = max(words, key=index.idf.__getitem__)
                anchors[rarest].append((k, words.index(rarest)))
                continue
            mandatory = {w for p in keys for w in p}
            held = sorted((w for w in {*words} - mandatory if df.get(w)), key=lambda w: (-index.idf[w], words.index(w)))
            telling = [w for w in held if index.idf[w] >= index.idf[held[len(held) // 2]]] if held else []
            index.needed.append(min(VOTES, len(telling)))
            for w in telling:
                postings[w].append((k, [i for i, x in enumerate(words) if x == w]))
        index.postings, index.anchors = dict(postings), dict(anchors)
        return index

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, float]]]:
        """Places of base phrases, and for each other label its best place and the share of its template's words found there."""
        distinct = set(words)
        held = sorted(distinct & self.postings.keys(), key=lambda w: (-self.idf[w], w))
        looked_up: dict[int, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for w in held:  # the note's own rarest words of each template, rarest first
            for k, places in self.postings[w]:
                if len(looked_up[k]) < RAREST:
                    looked_up[k].append((w, places))
        open_ = {k: own for k, own in looked_up.items() if len(own) >= self.needed[k]}
        at_anchor = distinct & self.anchors.keys()
        if not open_ and not at_anchor:
            return [], []
        where: dict[bytes, list[int]] = {w: [] for w in at_anchor.union(*(dict(own) for own in open_.values()))}
        for at, w in enumerate(words):
            if w in where:
                where[w].append(at)
        base: list[tuple[str, int]] = []
        for w in at_anchor:
            for k, i in self.anchors[w]:
                text = self.templates[k][1]
                base += [(self.templates[k][0].label, at - i) for at in where[w] if at >= i and words[at - i : at - i + len(text)] == text]
        best: dict[str, tuple[float, int, Template]] = {}
        for k, own in open_.items():
            t = self.templates[k][0]
            for share, at in self._places(k, own, where, words):
                best[t.label] = max(best.get(t.label, (0.0, 0, t)), (share, -at, t), key=lambda x: x[:2])
        for t in [t for _, _, t in best.values()]:
            best.pop(t.wider, None)
        return sorted(base, key=lambda x: x[1]), sorted((label, -at, share) for label, (share, at, _) in best.items())

    def _places(self, k: int, own: list[tuple[bytes, list[int]]], where: dict[bytes, list[int]], words: list[bytes]) -> Iterator[tuple[float, int]]:
        """Where enough looked-up words agree that the template starts and its key phrases stand, with the share of its words found."""
        _, text, keys = self.templates[k]
        starts = sorted((at - i, w) for w, places in own for at in where[w] for i in places)
        done, a, b = -SLACK - 1, 0, 0
        agreeing: Counter[bytes] = Counter()
        for start, _ in starts:
            # words inserted or lost between the rare words move their votes to neighbouring starts
            while b < len(starts) and starts[b][0] <= start + SLACK:
                agreeing[starts[b][1]] += 1
                b += 1
            while starts[a][0] < start - SLACK:
                agreeing[starts[a][1]] -= 1
                if not agreeing[starts[a][1]]:
                    del agreeing[starts[a][1]]
                a += 1
            if len(agreeing) < self.needed[k] or start == done:
                continue
            done = start
            first = max(0, start - SLACK)
            window = words[first : max(0, start + len(text) + SLACK)]
            if all(self._stands(window, p) for p in keys):
                there = Counter(window)
                yield sum(min(c, there[w]) for w, c in Counter(text).items()) / len(text), first

    @staticmethod
    def _stands(window: list[bytes], phrase: list[bytes]) -> bool:
        n = len(phrase)
        return any(w == phrase[0] and window[i : i + n] == phrase for i, w in enumerate(window))


def word_counts(photos: DataFrame, templates: tuple[Template, ...], photo_id: str = "photo_id", note: str = "note") -> tuple[dict[bytes, int], int]:
    """In how many notes each word of the templates stands, over all notes, and the number of notes."""
    wanted = {w for t in templates for w in words_of(t.text.encode())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        n = 0
        for b in batches:
            for x in b.column(0).to_pylist():
                n += 1
                found.update(wanted.intersection(words_of(x)))
        yield pa.RecordBatch.from_pydict({"word": [b"", *found], "n": pa.array([n, *found.values()], pa.int64())})

    r = only(photos, note=note).select(F.coalesce("note", F.lit("")).cast("binary").alias("note"))
    rows = r.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row for each template word
    df = {bytes(x.word): x.n for x in rows}
    return df, df.pop(b"", 0)


def scan_licences(photos: DataFrame, photo_id: str = "photo_id", note: str = "note", templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """``photos(photo_id, note)`` -> ``(photo_id, n_words, base_places, licences)``.

    The project records no licences; the operator is general and reads any text as a note. ``base_places`` lists every
    ``(label, at)`` where a base phrase's words stand one after another, ``at`` counting words from 0. ``licences`` lists
    ``(label, at, share)``: base labels with share 1, and templates found by position. Of the words outside a template's key
    phrases, the ones with the highest IDF that the note itself holds are looked up in an inverted index; where enough of
    them agree on the place where the text would start (give or take a few words), all mandatory key phrases must stand
    there too. A key phrase alone, without its licence around it, is none. ``share`` is the part of the template's words
    found at the best place; of several templates with one label the best place counts.

    IDF comes from all notes. Null notes are empty (0 words, empty lists); null and repeated ids stay rows of their own;
    an empty table gives an empty one; other columns are ignored. Two scans, no shuffle of notes.
    """
    index = LicenceIndex.build(templates, *word_counts(photos, templates, photo_id, note))
    r = only(photos, photo_id=photo_id, note=note).withColumn("note", F.coalesce("note", F.lit("")).cast("binary"))
    place = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64())]))
    kind = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64()), ("share", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, found = [], [], []
            for note in b.column(1).to_pylist():
                words = words_of(note)
                places, others = index.scan(words)
                n.append(len(words))
                base.append([{"label": lab, "at": at} for lab, at in places])
                whole = {lab: {"label": lab, "at": at, "share": 1.0} for lab, at in reversed(places)}
                found.append([*whole.values(), *({"label": lab, "at": at, "share": s} for lab, at, s in others)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(base, place), pa.array(found, kind)], ["photo_id", "n_words", "base_places", "licences"])

    id_kind = r.schema["photo_id"].dataType.simpleString()
    places = "array<struct<label: string, at: bigint>>"
    return r.mapInArrow(scan, f"photo_id {id_kind}, n_words bigint, base_places {places}, licences array<struct<label: string, at: bigint, share: double>>")
