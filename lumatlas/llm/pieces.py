"""Inside a task: exact byte-level BPE through a memory of pieces, and rolling hashes over byte buffers."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np


def give_back() -> None:
    """Hand freed memory back to the machine: Python workers stay alive, with all they once held, from stage to stage."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTER = _class(bytes([*range(65, 91), *range(97, 123)]))
_STOP = _class(b".,!?;:")
_PRINTED = _class(bytes(range(0x21, 0x7F)))
_SECOND, _LEAD = _class(bytes(range(0x80, 0xC0))), _class(bytes(range(0xC3, 0xE0)))


def piece_cuts(data: np.ndarray) -> np.ndarray:
    """Where a cut never changes a byte-level BPE result, because the pre-tokenizer starts a new token there anyway.

    Before a space or line feed that follows a printable character (ASCII, or one of two bytes from U+00C0 on: none of those
    is white space); before a stop that follows a letter; before a letter that follows a single line feed.
    """
    out = np.zeros(len(data), bool)
    if len(data) < 3:
        return out
    two, one, here = data[:-2], data[1:-1], data[2:]
    solid = _PRINTED[one] | (_SECOND[one] & _LEAD[two])
    out[2:] = (((here == 0x20) | (here == 0x0A)) & solid) | (_STOP[here] & _LETTER[one]) | (_LETTER[here] & (one == 0x0A) & _PRINTED[two])
    out[1] = bool(_PRINTED[data[0]]) and data[1] in (0x20, 0x0A)
    return out


def splits_like_byte_level(path: str) -> bool:
    """If the file's tokenizer reads texts as they are and splits them by the byte-level pattern, as ``piece_cuts`` presumes."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    ordinary = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return bool(plain and spec.get("normalizer") is None and ordinary and not any(set(" \n.,!?;:") & set(t["content"]) for t in spec.get("added_tokens", [])))


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            wider = np.empty(max(len(self.room) * 3 // 2, self.n + len(more)), self.room.dtype)
            wider[: self.n] = self.room[: self.n]
            self.room = wider
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    def __len__(self) -> int:
        return self.n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class PieceEncoder:
    """The tokenizers library behind a memory of text pieces: each piece is encoded by the library once per memory fill.

    Texts are cut where that never changes the result (``piece_cuts``); for a tokenizer that doesn't split texts as the
    byte-level one does, they stay whole. Pieces of up to ``SHORT`` bytes are looked up by a 64-bit hash, and what the
    memory holds is compared with the text byte by byte; where they differ, and for longer pieces, the library is asked. When
    the memory is full it starts anew, so its size is bounded (about 45 bytes a piece).
    """

    #: Bytes that are encoded together.
    SLICE = 1 << 19
    #: Bytes of a piece that the memory takes.
    SHORT = 64

    def __init__(self, path: str, room: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.dtype = np.uint16 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.room = room
        self.splits = splits_like_byte_level(path)
        rng = np.random.default_rng(4711)
        self.letter = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(0, 1 << 63, self.SHORT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted keys, and where each piece is described
        self.start, self.count, self.pool = _Grown(np.int32), _Grown(np.int32), _Grown(self.dtype)  # its ids
        self.spelled, self.size, self.letters = _Grown(np.int32), _Grown(np.int32), _Grown(np.uint8)  # its bytes

    def _hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rel = np.arange(len(data)) - np.repeat(starts, sizes)
        if sizes.max() > self.SHORT:  # longer pieces aren't looked up
            np.minimum(rel, self.SHORT - 1, out=rel)
        h = np.add.reduceat(self.letter[data] * self.place[rel], starts)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _by_library(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode pieces by the library and remember them; keys are sorted and new."""
        ids = self._by_library(pieces)
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(count.sum()))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, np.arange(len(self.size), len(self.size) + len(keys), dtype=np.int32))
        self.start.add(len(self.pool) + np.cumsum(count, dtype=np.int64) - count)
        self.spelled.add(len(self.letters) + np.cumsum(size, dtype=np.int64) - size)
        for grown, more in ((self.count, count), (self.size, size), (self.pool, flat), (self.letters, np.frombuffer(b"".join(pieces), np.uint8))):
            grown.add(more)

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of pieces, and how many each has."""
        ends = np.append(starts, len(data))
        sizes = np.diff(ends)
        distinct, first, back = np.unique(self._hashes(data, starts, sizes), return_index=True, return_inverse=True)
        if len(self.keys) > self.room:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        new &= sizes[first] <= self.SHORT
        raw = data.tobytes()
        if new.any():
            self._learn(distinct[new], [raw[starts[k] : ends[k + 1]] for k in first[new].tolist()])
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        if len(self.keys):
            at = self.slot[at][back]
            letters = self.letters.all
            same = self.size.all[at] == sizes
            # the bytes the memory holds, against those of the text
            held = np.repeat((np.where(same, self.spelled.all[at], 0) - starts).astype(np.int32), sizes) + np.arange(len(data), dtype=np.int32)
            if not same.all():
                np.minimum(held, len(letters) - 1, out=held)
            differ = letters[held] != data
            if differ.any():
                same &= ~np.logical_or.reduceat(differ, starts)
            start, count, pool = self.start.all[at].astype(np.int64), self.count.all[at], self.pool.all
        else:
            same, start, count, pool = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32), self.pool.all
        if not same.all():  # what the memory doesn't hold is encoded by the library, each different piece once
            others = np.flatnonzero(~same)
            pieces = [raw[starts[k] : ends[k + 1]] for k in others.tolist()]
            number = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            ids = self._by_library(list(number))
            n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
            which = np.fromiter((number[p] for p in pieces), np.int64, len(pieces))
            start[others], count[others] = (len(pool) + np.cumsum(n_ids) - n_ids)[which], n_ids[which]
            pool = np.concatenate([pool, np.fromiter(chain.from_iterable(ids), self.dtype, int(n_ids.sum()))])
        stops = np.cumsum(count, dtype=np.int64)
        place = np.repeat(start - stops + count, count) + np.arange(stops[-1])
        return pool[place], count

    def encode_bytes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts one after another -> all ids, and how many each text has."""
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        counts = np.zeros(len(ends), np.int64)
        if not len(data):
            return np.zeros(0, self.dtype), counts
        cut = piece_cuts(data) if self.splits else np.zeros(len(data), bool)
        cut[starts[starts < len(data)]] = True
        cuts = np.flatnonzero(cut)
        out, a = [], 0
        while a < len(cuts):
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + self.SLICE)))
            stop = int(cuts[b]) if b < len(cuts) else len(data)
            ids, count = self._pieces(data[cuts[a] : stop], cuts[a:b] - cuts[a])
            out.append(ids)
            counts += np.bincount(np.searchsorted(ends, cuts[a:b], "right"), count, minlength=len(ends)).astype(np.int64)
            a = b
        return np.concatenate(out), counts

    def plain(self, text: bytes) -> bytes:
        """The ids of one short text by the library itself, without the memory."""
        return np.array(self.lib.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``; for many texts at once, as each call merges what it learns."""
        ids, counts = self.encode_bytes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64))
        raw, width = ids.tobytes(), ids.itemsize
        ends = np.cumsum(counts) * width
        return [raw[e - c * width : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and tokenizer; its memory serves all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_MIX = np.random.default_rng(20240607).integers(1, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """32-bit polynomial hashes of all windows of ``width`` (a power of two) bytes, mixed; empty if there is none."""
    if len(data) < width:
        return np.zeros(0, np.uint32)
    h = _MIX[data]
    step, factor = 1, 0x9E3779B1
    while step < width:
        h = h[:-step] * np.uint32(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h
