"""Token files and BPE against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumatlas.llm import bpe, tokens
from lumatlas.llm.pieces import PieceEncoder, rolling_hash, splits_like_byte_level, tokenizer_path

from .conftest import pairs

LIB = Tokenizer.from_file(tokenizer_path())


def library(text):
    return LIB.encode(text, add_special_tokens=False).ids


def test_piece_memory_equals_library():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t ", "a", "foo", "Bar", "12", "'s", "don't", " ", "\x1c", "é", "日本", "!", "...", "<|endoftext|>", "\r\n", "　", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    enc = PieceEncoder(tokenizer_path(), room=50)
    for a in range(0, len(texts), 100):
        for text, ids in zip(texts[a : a + 100], enc.encode([t.encode() for t in texts[a : a + 100]]), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == library(text), repr(text)


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w[:n]


def test_long_words_equal_library():
    """Words that collide in polynomial hashes, and very long ones."""
    w = thue_morse(2048)
    swapped = w.translate(str.maketrans("ab", "ba"))
    texts = ["q" * 64 + w, "q" * 64 + swapped, w, swapped, w[:64], swapped[:64], "ab" * 500_000, "x" * 1_000_000 + " end", "é" * 40 + "a" * 70 + " é"]
    enc = PieceEncoder(tokenizer_path())
    for _ in range(2):
        for text, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == library(text), text[:70]


def test_equal_hashes_are_told_apart():
    """With a hash that has hardly any values the bytes decide."""
    enc = PieceEncoder(tokenizer_path())
    exact = enc._hashes
    enc._hashes = lambda data, starts, sizes: exact(data, starts, sizes) % np.uint64(5)
    texts = ["one two three four five six seven", "seven six five four three two one", "eight nine", "ten " * 30 + "x" * 100]
    for _ in range(2):
        for text, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == library(text)


def test_long_words_through_the_operators(shipped, tmp_path):
    w = "q" * 64 + thue_morse(2048)
    texts = [w, w.translate(str.maketrans("ab", "ba")), "z" * 1_200_000, "word " * 30_000]
    df = shipped.createDataFrame(list(enumerate(texts)), "photo_id bigint, summary string")
    got = {r.photo_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode_reports(df).collect()}
    tokens.write_token_files(df, f"file://{tmp_path}/long")
    files = {r.photo_id: list(r.ids) for r in tokens.read_tokens(shipped, f"file://{tmp_path}/long").collect()}
    for i, t in enumerate(texts):
        assert got[i] == library(t) and files[i] == [*library(t), 0]


def test_another_tokenizer(shipped, nasty):
    """One that lower-cases and drops white space: no cut is safe, whole texts are encoded."""
    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    assert not splits_like_byte_level(path) and splits_like_byte_level(tokenizer_path())
    rows = nasty.filter("length(summary) < 1000 or summary is null")
    got = sorted((r.photo_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in bpe.encode_reports(rows, tokenizer=path).collect())
    assert got == sorted((i or -1, lib.encode(t, add_special_tokens=False).ids) for i, t in pairs(rows))


def test_files_are_placed_by_their_number(shipped, tmp_path):
    """File names sort as text only up to part-99999."""
    rows = shipped.createDataFrame([(1, "a"), (2, "b b")], "photo_id bigint, summary string")
    for k, name in ((1, "part-99999-x"), (2, "part-100000-x")):
        tokens.write_token_files(rows.filter(f"photo_id = {k}").coalesce(1), str(tmp_path / f"one{k}"))
        (made,) = [f for f in (tmp_path / f"one{k}").glob("part-*.parquet") if tokens.read_tokens(shipped, str(f)).count()]
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"{name}.zstd.parquet").write_bytes(made.read_bytes())
    got = {r.photo_id: r.start for r in tokens.token_starts(shipped, str(tmp_path / "all")).collect()}
    assert got == {1: 0, 2: len(library("a")) + 1}


def test_rolling_hash_depends_on_its_window_only():
    data = np.frombuffer(bytes(range(200)) * 3, np.uint8)
    h = rolling_hash(data, 16)
    assert len(h) == len(data) - 15 and (h[:200] == h[200:400]).all()
    assert len(rolling_hash(data[:15], 16)) == 0


def test_chunk_joins_are_repaired(monkeypatch):
    monkeypatch.setattr(bpe, "MEAN", 6)
    monkeypatch.setattr(bpe, "REACH", 3)
    monkeypatch.setattr(bpe, "WINDOW", 4)
    rng = random.Random(4)
    enc = PieceEncoder(tokenizer_path())
    hard = 0
    for _ in range(400):
        text = "".join(rng.choice(["ab", "the", "é", "日", " ", "123", "\n", "  ", "don't"]) for _ in range(rng.randint(0, 60)))
        raw = text.encode()
        starts, ok, safe = bpe.cut(raw)
        hard += not all(ok)
        chunks = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
        ids = enc.encode(chunks)
        assert np.frombuffer(bpe.join_chunks(raw, starts, ok, safe, ids, enc), enc.dtype).tolist() == library(text)
    assert hard > 50


@pytest.mark.parametrize("small_blocks", [False, True])
def test_round_trip(nasty, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(bpe, "BLOCK_BYTES", 5000)
    r = bpe.encode_reports(nasty)
    r = r.select("photo_id", "n_tokens", "ids", bpe.decode(F.col("ids")).alias("text")).collect()
    got = sorted((x.photo_id is None, x.photo_id or 0, x.text, np.frombuffer(x.ids, "<u4").tolist(), x.n_tokens) for x in r)
    want = sorted((i is None, i or 0, t, library(t), len(library(t))) for i, t in pairs(nasty))
    assert got == want


def test_token_files(nasty, nothing, tmp_path, shipped):
    path = f"file://{tmp_path}/tokens"
    tokens.write_token_files(nasty, path)
    want, start = [], 0
    for i, t in sorted(pairs(nasty), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*library(t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, tokens.token_starts(shipped, path).collect()), key=lambda x: x[1])
    assert got == want
    some = {r.photo_id: list(r.ids) for r in tokens.read_tokens(shipped, path, 13, 21).collect()}
    assert set(some) == {13, 14, 21} and some[13][:-1] == library(dict(pairs(nasty))[13])
    tokens.write_token_files(nothing, f"{path}-none")
    assert tokens.token_starts(shipped, f"{path}-none").count() == 0


def test_empty_table(nothing):
    assert bpe.encode_reports(nothing).count() == 0
