"""BPE encoding and decoding of report summaries with content-defined chunks that are encoded once for all reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, partitions
from .pieces import PieceEncoder, encoder, give_back, rolling_hash, splits_like_byte_level, tokenizer_path

#: Rolling-hash window, mean distance of its triggers, and how far a cut may move on to a space, in bytes.
WINDOW, MEAN, REACH = 32, 512, 64
#: Text of a block: reports are encoded block by block, and chunks within a block need no exchange to be shared.
BLOCK_BYTES = 8 << 20


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of spaces behind a printable ASCII character: a cut there never changes the encoding."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1


def cut(text: bytes, whole: bool = False) -> tuple[list[int], list[bool], np.ndarray]:
    """Chunk starts of a text, whether each start is a safe cut, and all safe positions; ``whole``: one chunk.

    A trigger (window hash 0 modulo ``MEAN``) moves on to the next safe space within ``REACH`` bytes; otherwise it cuts
    where it stands, at the next character.
    """
    if whole:
        return [0], [True], np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    safe = safe_cuts(data)
    triggers = np.flatnonzero(rolling_hash(data, WINDOW) % np.uint32(MEAN) == 0) + WINDOW
    triggers = triggers[triggers < len(data)]
    if not len(triggers):
        return [0], [True], safe
    at = np.searchsorted(safe, triggers)
    near = np.append(safe, 1 << 62)[at]
    soft = near <= triggers + REACH
    starts: dict[int, bool] = {0: True}
    for t, n, s in zip(triggers.tolist(), near.tolist(), soft.tolist(), strict=True):
        if not s:
            while t < len(text) and text[t] & 0xC0 == 0x80:
                t += 1
        p = n if s else t
        if p < len(text):
            starts[p] = starts.get(p, False) or s
    order = sorted(starts)
    return order, [starts[p] for p in order], safe


def join_chunks(text: bytes, starts: list[int], is_safe: list[bool], safe: np.ndarray, ids: list[bytes], enc: PieceEncoder) -> bytes:
    """Ids of the whole text from the ids of its chunks, repaired at every join that isn't safe.

    Around such a join the text between the next safe positions (or ends) is encoded anew and replaces what both chunks
    have there. The replaced ids must agree exactly with the encoding of the replaced text; if they don't anywhere, the
    window grows to the whole text.
    """
    if all(is_safe):
        return b"".join(ids)
    ends = [*starts[1:], len(text)]
    marks = np.unique(np.concatenate([[0], safe, [s for s, ok in zip(starts, is_safe, strict=True) if ok], [len(text)]]).astype(np.int64))
    windows: list[list[int]] = []
    for p in (p for p, ok in zip(starts, is_safe, strict=True) if not ok):
        a, b = int(marks[np.searchsorted(marks, p, "right") - 1]), int(marks[np.searchsorted(marks, p)])
        if windows and a < windows[-1][1]:
            windows[-1][1] = max(b, windows[-1][1])
        else:
            windows.append([a, b])

    def over(p: int) -> list[int] | None:
        return next((w for w in windows if w[0] < p < w[1]), None)

    out, done, agreed = [], set(), True
    for s, e, own in zip(starts, ends, ids, strict=True):
        left, right = over(s), over(e)
        kept_from, kept_to = left[1] if left else s, right[0] if right else e
        if kept_from < e or not left:
            head = enc.plain(text[s:kept_from]) if left else b""
            tail = enc.plain(text[kept_to:e]) if right else b""
            agreed &= own[: len(head)] == head and own[len(own) - len(tail) :] == tail
            out.append(own[len(head) : len(own) - len(tail)])
        if right and right[0] not in done:
            done.add(right[0])
            out.append(enc.plain(text[right[0] : right[1]]))
    return b"".join(out) if agreed else enc.plain(text)


def _key(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _texts(block: pa.Table) -> list[bytes]:
    import zstandard

    give_back()
    raw = zstandard.ZstdDecompressor()
    return [raw.decompress(t) for t in block.column("packed").to_pylist()]


def encode_reports(reports: DataFrame, photo_id: str = "photo_id", summary: str = "summary", tokenizer: str | None = None) -> DataFrame:
    """``reports(photo_id, summary)`` -> ``(photo_id, n_tokens, ids)``; ``ids`` are little-endian unsigned 32-bit integers.

    Equal to the tokenizers library's encoding of each whole summary without added special tokens. Summaries are cut into
    chunks by a rolling hash. A chunk that occurs in several blocks of reports is encoded in one of them and its ids are
    joined to the others; within a block every chunk is encoded once. Joins of chunks that could change a token are
    repaired (``join_chunks``). A ``tokenizer`` file that doesn't split texts by the byte-level pattern gets whole texts as
    chunks: where a cut is safe isn't known.

    Null summaries are empty and have no ids; null and repeated ids stay rows of their own; an empty table gives an empty
    one; other columns are ignored; a text of any length is only ever split into chunks. A frequent chunk counts once per
    block, so no key outweighs the number of blocks. Texts are shuffled once, compressed.
    """
    spark = reports.sparkSession
    path = tokenizer or tokenizer_path()
    whole = not splits_like_byte_level(path)
    r = only(reports, photo_id=photo_id, summary=summary).withColumn("summary", F.coalesce("summary", F.lit("")).cast("binary"))
    n_bytes = r.agg(F.sum(F.length("summary"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    kind = r.schema["photo_id"].dataType.simpleString()
    r = r.withColumn("block", F.pmod(F.xxhash64("photo_id", "summary"), F.lit(n_blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([small.compress(t) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed, b.column(2)], ["photo_id", "packed", "block"])

    # this exchange serves all three passes over the blocks
    blocks = r.mapInArrow(pack, f"photo_id {kind}, packed binary, block int").repartition(partitions(spark), "block")

    def list_chunks(block: pa.Table) -> pa.Table:
        keys = set()
        for text in _texts(block):
            starts, _, _ = cut(text, whole)
            keys.update(_key(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True))
        of = block.column("block")[0].as_py()
        return pa.table({"chunk": pa.array(list(keys), pa.binary()), "block": pa.array([of] * len(keys), pa.int32())})

    # the filter that the join below would add, so that both uses of the list share one exchange
    listed = blocks.groupBy("block").applyInArrow(list_chunks, "chunk binary, block int").filter("chunk is not null")
    uses = listed.repartition(partitions(spark), "chunk")
    shared = uses.groupBy("chunk").agg(F.min("block").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk", "owner")

    def encode_shared(block: pa.Table, wanted: pa.Table) -> pa.Table:
        missing = set(wanted.column("chunk").to_pylist())
        found = {}
        for text in _texts(block) if missing else []:
            starts, _, _ = cut(text, whole)
            for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
                key = _key(text[a:b])
                if key in missing:
                    missing.discard(key)
                    found[key] = text[a:b]
        ids = encoder(path).encode(list(found.values()))
        return pa.table({"chunk": pa.array(list(found), pa.binary()), "ids": pa.array(ids, pa.binary())})

    once = blocks.groupBy("block").cogroup(shared.groupBy("owner")).applyInArrow(encode_shared, "chunk binary, ids binary")
    known = uses.join(once, "chunk").select(F.col("block").alias("to"), "chunk", "ids")

    def assemble(block: pa.Table, known: pa.Table) -> pa.Table:
        enc = encoder(path)
        memory = dict(zip(known.column("chunk").to_pylist(), known.column("ids").to_pylist(), strict=True))
        texts = _texts(block) if block.num_rows else []
        cuts = [cut(text, whole) for text in texts]
        chunks = [[t[a:b] for a, b in zip(starts, [*starts[1:], len(t)], strict=True)] for t, (starts, _, _) in zip(texts, cuts, strict=True)]
        keys = [[_key(c) for c in own] for own in chunks]
        new = {k: c for ks, cs in zip(keys, chunks, strict=True) for k, c in zip(ks, cs, strict=True) if k not in memory}
        memory |= zip(new, enc.encode(list(new.values())), strict=True)
        out, counts = [], []
        for text, (starts, is_safe, safe), ks in zip(texts, cuts, keys, strict=True):
            ids = np.frombuffer(join_chunks(text, starts, is_safe, safe, [memory[k] for k in ks], enc), enc.dtype)
            out.append(ids.astype("<u4").tobytes())
            counts.append(len(ids))
        photo = block.column("photo_id") if block.num_rows else pa.array([], block.schema.field("photo_id").type)
        return pa.table({"photo_id": photo, "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(out, pa.large_binary()).cast(pa.binary())})

    return blocks.groupBy("block").cogroup(known.groupBy("to")).applyInArrow(assemble, f"photo_id {kind}, n_tokens bigint, ids binary")


def decode(ids: Column, tokenizer: str | None = None) -> Column:
    """Text of packed ids (as ``encode_reports`` makes them), as the library's decode without skipping special tokens.

    A byte-level token stands for a fixed string of bytes, taken from the library's vocabulary; a text is their
    concatenation, read as UTF-8 with replacement of what is not. Null stays null.
    """
    path = tokenizer or tokenizer_path()

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        table = [b""] * lib.get_vocab_size(with_added_tokens=True)
        for token, k in lib.get_vocab(with_added_tokens=True).items():
            table[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for part in parts:
            yield part.map(lambda x: None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace"))

    return run(ids)
