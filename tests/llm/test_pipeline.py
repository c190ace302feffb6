"""Every stage of the pipeline against brute force, and the pipeline as a whole."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lumatlas.llm.pieces import tokenizer_path

from .test_nearcopies import brute as near_groups
from .test_passages import brute as repeats
from .test_toxicity import comments


@pytest.fixture(scope="module")
def folder(shipped, tmp_path_factory):
    rng = random.Random(31)
    rows = [(i, t, "en", f"src{i % 3}") for i, t, _ in comments(300, 5)]
    rows += [(1000 + k, f"{rows[4 * k + 1][1]} {rng.choice(['an', 'on'])}", "en", "src1") for k in range(12)]  # near copies
    shared = " ".join(f"passage{k}" for k in range(60))
    rows += [(2000 + k, f"{comments(40, 40)[4 * k + 1][1]} {shared} é{k}", "de", "src2") for k in range(8)]
    rows += [(3000, shared, None, None), (3001, None, "fr", None), (3002, "", "fr", "src1"), (None, "no id here", "en", "src1"), rows[1], (3003, "x " * 5000, "en", "src2")]
    at = tmp_path_factory.mktemp("corpus")
    rng.shuffle(rows)
    docs = shipped.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{at}/documents.parquet")
    labels = shipped.createDataFrame([(i, 1, t) for i, _, t in comments(300, 5)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_stages_and_run(shipped, folder):
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    toxic = {i for i, _, t in comments(300, 5) if t}
    kept = cp.drop_toxic(shipped, docs, folder)
    assert kept.columns == cp.COLUMNS
    gone = Counter(r.doc_id for r in docs.collect()) - Counter(r.doc_id for r in kept.collect())
    assert len(set(gone) ^ toxic) <= 6 and not set(gone) - toxic - set(range(1000, 1012)) - set(range(2000, 2008))

    kept.write.parquet(f"{folder}/1")
    docs = shipped.read.parquet(f"{folder}/1")
    near = cp.drop_near_copies(shipped, docs, folder)
    want = {}
    groups = near_groups([(r.doc_id, r.text or "") for r in docs.collect()], 5)
    firsts = {g[1] for g in groups if not g[0] and g[4]}
    for r in docs.collect():
        if r.doc_id is None or r.doc_id in firsts:
            want[r.doc_id] = (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    assert rows_of(near) == sorted(want.values(), key=str) and near.columns == cp.COLUMNS

    near.write.parquet(f"{folder}/2")
    docs = shipped.read.parquet(f"{folder}/2")
    cut = cp.drop_passages(shipped, docs, folder)
    source = {r.doc_id: r for r in docs.collect()}
    want = []
    for i, b, flags in repeats([(r.doc_id, (r.text or "").encode()) for r in source.values()]):
        left = bytes(c for c, f in zip(b, flags, strict=True) if not f)
        r = source[i]
        if not any(flags):
            want.append((i, r.text, r.lang, r.source, r.n_chars))
        elif left:
            t = left.decode("utf-8", "ignore")
            want.append((i, t, r.lang, r.source, len(t)))
    assert rows_of(cut) == sorted(want, key=str) and any(r[0] == 2003 for r in want)

    cut.write.parquet(f"{folder}/3")
    docs = shipped.read.parquet(f"{folder}/3")
    mixed = cp.mix(shipped, docs, folder)
    assert mixed.columns == cp.COLUMNS and max(Counter(rows_of(mixed)).values()) <= 3 and set(rows_of(mixed)) <= set(rows_of(docs))
    words = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert words(rows_of(mixed)) == pytest.approx(words(rows_of(docs)), abs=3 * 70 + 5000)

    mixed.write.parquet(f"{folder}/4")
    docs = shipped.read.parquet(f"{folder}/4")
    lib = Tokenizer.from_file(tokenizer_path())
    got = cp.encode(shipped, docs, folder).collect()
    assert all(r.exact for r in got)
    ids = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert ids == sorted((str(r.doc_id), lib.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())

    whole = cp.run(shipped, folder).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in whole) == ids


def test_stages_of_an_empty_table(shipped, folder):
    docs = shipped.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [stage(shipped, docs, folder).count() for _, stage in cp.STAGES] == [0] * 5
