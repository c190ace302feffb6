"""Repeated passages of report summaries removed byte for byte, by distributed prefix-free parsing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .pieces import give_back, rolling_hash

#: Bytes of a repeated string; bytes of a trigger word; bytes of a phrase left of its trigger's start, and in all.
LENGTH, WORD = 50, 16
LEFT = LENGTH - WORD
PHRASE = LEFT + LENGTH
#: Text of a block, text that is parsed at a time within it, and distinct phrases that meet in one task (about).
BLOCK_BYTES, PART_BYTES, DICTIONARY = 8 << 20, 1 << 20, 1 << 20
#: Phrases around one trigger word from which on its strings are dealt out singly.
FREQUENT = 20_000
#: A null id comes after all others.
LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(771)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, PHRASE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words_hash(rows: np.ndarray, salt: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of equally long rows of bytes (a multiple of 8)."""
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64) if salt is None else salt
    for column in np.ascontiguousarray(rows).view(np.uint64).T:
        h = _mix((h ^ column) * _MUL)
    return h


def trigger_places(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of trigger words: in every ``LENGTH`` bytes that start at a valid place, the word of the smallest rolling hash.

    Which word that is depends on these bytes alone, so equal strings hold a trigger at the same place of theirs.
    """
    h = rolling_hash(data, WORD)
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span, least = 1, key
    while 2 * span <= LEFT + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = LEFT + 1 - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least[valid[: len(least)]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


@dataclass
class Parse:
    """A block's triggers in the order of its reports: report, place in it, phrase; and its distinct phrases.

    ``phrase``: index of each trigger's phrase among the distinct ones, which are ordered by bucket and hash.
    """

    ids: np.ndarray
    texts: list[bytes]
    report: np.ndarray
    place: np.ndarray
    phrase: np.ndarray
    hashes: np.ndarray
    words: np.ndarray
    bucket: np.ndarray
    first: np.ndarray

    def phrase_bytes(self, triggers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases around some triggers, zero-padded beyond their reports, and the ranges of them inside."""
        return _phrases(self.texts, self.report[triggers], self.place[triggers])


def _phrases(texts: list[bytes], report: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    needed = np.unique(report)
    part = [texts[i] for i in needed.tolist()]
    data = np.frombuffer(b"".join(part) or b"\0", np.uint8)
    sizes = np.array([len(t) for t in part], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
    k = np.searchsorted(needed, report)
    lo, hi = np.maximum(0, LEFT - place), np.minimum(PHRASE, sizes[k] - place + LEFT)
    at = (begins[k] + place - LEFT)[:, None] + np.arange(PHRASE)
    rows = data[np.clip(at, 0, len(data) - 1, out=at)]
    del at
    inside = (np.arange(PHRASE) >= lo[:, None]) & (np.arange(PHRASE) < hi[:, None])
    return np.where(inside, rows, 0).astype(np.uint8), lo, hi


def parse(ids: np.ndarray, texts: list[bytes], buckets: int) -> Parse:
    report, place, words, hashes = [], [], [], []

    def add(of: np.ndarray, at: np.ndarray) -> None:
        for a in range(0, len(at), 1 << 14):
            o, p = of[a : a + (1 << 14)], at[a : a + (1 << 14)]
            rows, lo, hi = _phrases(texts, o, p)
            padded = np.zeros((len(rows), -(-PHRASE // 8) * 8), np.uint8)
            padded[:, :PHRASE] = rows
            hashes.append(_words_hash(padded, _mix((lo * 256 + hi).astype(np.uint64) * _MUL)))
            words.append(_words_hash(np.ascontiguousarray(rows[:, LEFT : LEFT + WORD])))
            report.append(o)
            place.append(p)

    def run(group: list[int]) -> None:
        sizes = np.array([len(texts[i]) for i in group], np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        ends = np.cumsum(sizes)
        valid = np.ones(len(data), bool)
        for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
            valid[e - min(s, LENGTH - 1) : e] = False
        at = trigger_places(data, valid)
        k = np.searchsorted(ends, at, "right")
        add(np.array(group, np.int64)[k], at - (ends - sizes)[k])

    group, held = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > PART_BYTES:  # a long text goes part by part, with what the last strings of a part reach into
            seen = np.zeros(0, np.int64)
            for a in range(0, len(t), PART_BYTES):
                data = np.frombuffer(t, np.uint8)[a : a + PART_BYTES + LENGTH - 1]
                valid = np.ones(len(data), bool)
                valid[max(0, len(data) - LENGTH + 1) :] = False
                seen = np.union1d(seen, trigger_places(data, valid) + a)
            add(np.full(len(seen), i, np.int64), seen)
            continue
        group.append(i)
        held += len(t)
        if held > PART_BYTES:
            run(group)
            group, held = [], 0
    if group:
        run(group)
    whole = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((report, np.int64), (place, np.int64), (words, np.uint64), (hashes, np.uint64))]
    report, place, words, hashes = whole
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    heads = order[new]
    first = np.minimum.reduceat(ids[report[order]], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    bucket = ((words[heads] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty(len(by_bucket), np.int64)
    rank[by_bucket] = np.arange(len(by_bucket))
    return Parse(ids, texts, report, place, rank[number], hashes[heads][by_bucket], words[heads][by_bucket], bucket[by_bucket], first[by_bucket])


def _free_hashes(rows: np.ndarray) -> np.ndarray:
    """Hashes of the strings at each place of phrases that are comparable between any places."""
    out = np.zeros((len(rows), LEFT + 1), np.uint64)
    for i in range(LENGTH):
        out += _LETTER[rows[:, i : i + LEFT + 1]] * _PLACE[i]
    return _mix(out)


def suffix_orders(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The suffix array of phrases, place by place from ``LEFT`` down to 0: the phrases in the order of their suffixes there.

    The suffixes from the trigger on are sorted as they are. One place further left, the order follows from the letter
    there and the rank of what comes after it, which is known already.
    """
    right = np.zeros((len(rows), -(-LENGTH // 8) * 8), np.uint8)
    right[:, :LENGTH] = rows[:, LEFT:]
    columns = right.view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    rank = np.zeros(len(rows), np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum((columns[order[1:]] != columns[order[:-1]]).any(1))])[: len(rows)]
    yield LEFT, order
    for a in range(LEFT - 1, -1, -1):
        key = rows[:, a].astype(np.uint64) << np.uint64(32) | rank
        order = np.argsort(key)
        rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])[: len(rows)]
        yield a, order


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _least(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each element the smallest document among those with its key."""
    order = np.argsort(keys, kind="stable")
    starts = _runs(keys[order])
    out = np.empty(len(keys), np.int64)
    if len(keys):
        out[order] = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.append(starts, len(keys))))
    return out


PHRASES = "bucket int, block int, word_low binary, word_high binary, hash_low binary, hash_high binary, first binary"
ANSWERS = "to int, bucket int, kind int, at binary, value binary"
STRINGS = "bucket int, block int, kind int, at binary, hash binary, rows binary, range binary, first binary"


def remove_repeats(reports: DataFrame, photo_id: str = "photo_id", summary: str = "summary", carry: tuple[str, ...] = ()) -> DataFrame:
    """``reports(photo_id, summary)`` -> ``(photo_id, n_bytes, removed, kept[, carried])``; ``carried`` holds the columns named by ``carry``.

    A summary's UTF-8 bytes that a 50-byte string covers which also starts in the summary of a smaller photo id are removed;
    ``removed`` lists the maximal removed runs as ``(start, end)``, ``kept`` is the rest as bytes. Strings are judged on
    the input and never cross reports. Null summaries are empty. A null id counts as larger than all others; rows with
    equal ids don't remove from each other; an empty table gives an empty one; other columns are ignored.

    Prefix-free parsing, distributed. Rolling-hash triggers divide the texts; every 50-byte string holds a trigger that
    its bytes alone choose. The dictionary holds the distinct phrases around triggers (as far as a 50-byte string with the
    trigger reaches), with the smallest report of each; the parse of a report is its sequence of phrases. A report whose
    phrase occurs in a smaller one loses all strings of it. What is left are strings shared by different phrases of the
    dictionary: rival phrases (of one trigger word) meet, their suffix array brings their strings into corpus order, and
    neighbours with 50 equal bytes give each other the smallest report.

    Texts are shuffled once, compressed, into blocks; parsing is repeated for each of three passes over them. Per block a
    phrase counts once, so a frequent one has as many entries as blocks at most. Phrases meet by trigger word; those of a
    frequent word (``FREQUENT``) are instead dealt out string by string, after combining equal strings per block.
    """
    spark = reports.sparkSession
    n = partitions(spark)
    carried = F.struct(*[reports[f"`{c}`"].alias(c) for c in carry]) if carry else F.lit(None).cast("int")
    text = F.coalesce(reports[f"`{summary}`"], F.lit("")).cast("binary")
    r = reports.select(reports[f"`{photo_id}`"].alias("photo_id"), text.alias("summary"), carried.alias("carried"))
    kind_of_carried = r.schema["carried"].dataType.simpleString()
    kind_of_id = r.schema["photo_id"].dataType.simpleString()
    n_bytes = r.agg(F.sum(F.length("summary"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    buckets = max(1, -(-n_bytes // (18 * DICTIONARY)))
    r = r.withColumn("block", F.pmod(F.xxhash64("photo_id", "summary"), F.lit(n_blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([small.compress(t) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed, *b.columns[2:]], ["photo_id", "packed", "carried", "block"])

    # this exchange serves all three passes over the blocks
    blocks = r.mapInArrow(pack, f"photo_id {kind_of_id}, packed binary, carried {kind_of_carried}, block int").repartition(n, "block")

    def parsed(block: pa.Table) -> Parse:
        import zstandard

        give_back()
        raw = zstandard.ZstdDecompressor()
        ids = np.array([LAST if x is None else x for x in block.column("photo_id").to_pylist()], np.int64)
        return parse(ids, [raw.decompress(t) for t in block.column("packed").to_pylist()], buckets)

    def list_phrases(block: pa.Table) -> pa.Table:
        p = parsed(block)
        of = block.column("block")[0].as_py()
        starts = _runs(p.bucket)
        rows = []
        for a, b in zip(starts.tolist(), np.append(starts, len(p.bucket))[1:].tolist(), strict=True):
            w, h, d = p.words[a:b], p.hashes[a:b], p.first[a:b]
            parts = (w.astype(np.uint32), (w >> np.uint64(32)).astype(np.uint8), h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16))
            rows.append([int(p.bucket[a]), of, *(x.tobytes() for x in parts), _pack_ids(d)])
        return _table(rows, PHRASES)

    def dictionary(bucket: pa.Table) -> pa.Table:
        """Which phrases of each block are older elsewhere (1), first here and rivals of others (2), frequent (4)."""
        give_back()
        c = {k: bucket.column(k).to_pylist() for k in bucket.column_names}
        sizes = [len(x) // 4 for x in c["word_low"]]
        words = _join(c["word_low"], np.uint32).astype(np.uint64) | _join(c["word_high"], np.uint8).astype(np.uint64) << np.uint64(32)
        again = np.zeros(len(words), bool)
        order = np.argsort(words)
        same = words[order][1:] == words[order][:-1]
        again[order[1:][same]] = again[order[:-1][same]] = True
        rows = np.flatnonzero(again)  # the others occur once in the corpus
        words = words[rows]
        hashes = (_join(c["hash_low"], np.uint32).astype(np.uint64) | _join(c["hash_high"], np.uint16).astype(np.uint64) << np.uint64(32))[rows]
        docs = np.concatenate([_unpack_ids(x, s) for x, s in zip(c["first"], sizes, strict=True)])[rows]
        order = np.lexsort((hashes, words))
        words, hashes, docs, rows = words[order], hashes[order], docs[order], rows[order]
        new_word = np.concatenate([[True], words[1:] != words[:-1]]) if len(words) else np.zeros(0, bool)
        new = new_word | np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(words) else new_word
        owner = np.repeat(np.minimum.reduceat(docs, np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(docs)))) if len(docs) else docs
        of_word = np.cumsum(new_word) - 1
        rivals = np.bincount(of_word[new])[of_word] if len(words) else np.zeros(0, np.int64)
        flags = (owner < docs) * 1 + ((owner == docs) & (rivals > 1)) * np.where(rivals > FREQUENT, 6, 2)
        out = []
        row_of = np.searchsorted(np.cumsum(sizes), rows, "right")
        back = np.argsort(rows)
        rows, flags, row_of = rows[back], flags[back], row_of[back]
        keep = flags > 0
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for k in np.unique(row_of[keep]).tolist():
            own = keep & (row_of == k)
            at = (rows[own] - begins[k]).astype(np.uint32)
            out.append([c["block"][k], c["bucket"][k], 0, at.tobytes(), flags[own].astype(np.uint8).tobytes()])
        return _table(out, ANSWERS)

    def flags_of(p: Parse, answers: pa.Table) -> np.ndarray:
        flags = np.zeros(len(p.bucket), np.uint8)
        for bucket, kind, at, value in zip(*(answers.column(k).to_pylist() for k in ("bucket", "kind", "at", "value")), strict=True):
            if kind == 0:
                flags[np.searchsorted(p.bucket, bucket) + np.frombuffer(at, np.uint32)] = np.frombuffer(value, np.uint8)
        return flags

    def one_each(p: Parse, phrases: np.ndarray) -> np.ndarray:
        """A trigger of each of these phrases."""
        some = np.zeros(len(p.bucket), np.int64)
        some[p.phrase] = np.arange(len(p.phrase))
        return some[phrases]

    def frequent_strings(p: Parse, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings of the block's frequent phrases: hash, bucket, smallest report; and for each phrase its strings."""
        phrases = np.flatnonzero(flags & 4)
        if not len(phrases):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, phrases, np.zeros((0, LEFT + 1), np.int64)
        found, ok = [], []
        for a in range(0, len(phrases), 1 << 14):
            rows, lo, hi = p.phrase_bytes(one_each(p, phrases[a : a + (1 << 14)]))
            at = np.arange(LEFT + 1)
            found.append(_free_hashes(rows))
            ok.append((at >= lo[:, None]) & (at + LENGTH <= hi[:, None]))
        hashes, ok = np.concatenate(found), np.concatenate(ok)
        docs = np.repeat(p.first[phrases], LEFT + 1).reshape(hashes.shape)
        distinct, where = np.unique(hashes[ok], return_inverse=True)
        least = np.full(len(distinct), LAST, np.int64)
        np.minimum.at(least, where, docs[ok])
        bucket = (distinct >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = np.full(hashes.shape, -1, np.int64)
        number[ok] = rank[where]
        return distinct[order], bucket[order].astype(np.int64), least[order], phrases, number

    def list_strings(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = []
        if block.num_rows and answers.num_rows:
            p = parsed(block)
            of = block.column("block")[0].as_py()
            flags = flags_of(p, answers)
            phrases = np.flatnonzero((flags & 6) == 2)
            starts = _runs(p.bucket[phrases])
            for a, b in zip(starts.tolist(), np.append(starts, len(phrases))[1:].tolist(), strict=True):
                some = phrases[a:b]
                rows, lo, hi = p.phrase_bytes(one_each(p, some))
                bucket = int(p.bucket[some[0]])
                at = (some - np.searchsorted(p.bucket, bucket)).astype(np.uint32)
                out.append([bucket, of, 1, at.tobytes(), b"", rows.tobytes(), np.stack([lo, hi], 1).astype(np.uint8).tobytes(), p.first[some].tobytes()])
            hashes, bucket, least, _, _ = frequent_strings(p, flags)
            starts = _runs(bucket)
            for a, b in zip(starts.tolist(), np.append(starts, len(bucket))[1:].tolist(), strict=True):
                out.append([int(bucket[a]), of, 2, b"", hashes[a:b].tobytes(), b"", b"", least[a:b].tobytes()])
        return _table(out, STRINGS)

    def order_suffixes(bucket: pa.Table) -> pa.Table:
        """Which strings of rival phrases, and which of frequent ones, occur in a smaller report."""
        out = []
        for kind in (1, 2):
            mine = bucket.filter(pa.compute.equal(bucket.column("kind"), kind))
            c = {k: mine.column(k).to_pylist() for k in mine.column_names}
            docs = _join(c["first"], np.int64)
            sizes = [len(x) // 8 for x in c["first"]]
            mask = np.zeros(len(docs), np.uint64)
            if kind == 1:
                rows = _join(c["rows"], np.uint8).reshape(-1, PHRASE)
                lo, hi = _join(c["range"], np.uint8).reshape(-1, 2).T.astype(int)
                for a, order in suffix_orders(rows):
                    order = order[((lo <= a) & (a + LENGTH <= hi))[order]]
                    if len(order):
                        strings = rows[order, a : a + LENGTH]
                        starts = np.flatnonzero(np.concatenate([[True], (strings[1:] != strings[:-1]).any(1)]))
                        least = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.append(starts, len(order))))
                        mask[order] |= (least < docs[order]).astype(np.uint64) << np.uint64(a)
            else:
                mask[:] = _least(_join(c["hash"], np.uint64), docs) < docs
            a = 0
            for k, s in enumerate(sizes):
                hit = np.flatnonzero(mask[a : a + s])
                if len(hit):
                    at = np.frombuffer(c["at"][k], np.uint32)[hit] if kind == 1 else hit.astype(np.uint32)
                    value = mask[a : a + s][hit].tobytes() if kind == 1 else b""
                    out.append([c["block"][k], c["bucket"][k], kind, at.tobytes(), value])
                a += s
        return _table(out, ANSWERS)

    def strip(block: pa.Table, answers: pa.Table) -> pa.Table:
        p = parsed(block)
        flags = flags_of(p, answers)
        mask = np.zeros(len(p.bucket), np.uint64)
        hashes, bucket, least, phrases, number = frequent_strings(p, flags)
        least = np.append(least, LAST)  # for number -1: no string there
        older = np.zeros(len(hashes) + 1, bool)
        for b, kind, at, value in zip(*(answers.column(k).to_pylist() for k in ("bucket", "kind", "at", "value")), strict=True):
            if kind == 1:
                mask[np.searchsorted(p.bucket, b) + np.frombuffer(at, np.uint32)] = np.frombuffer(value, np.uint64)
            elif kind == 2:
                older[np.searchsorted(bucket, b) + np.frombuffer(at, np.uint32)] = True
        for a in range(LEFT + 1):
            older_here = older[number[:, a]] | (least[number[:, a]] < p.first[phrases])
            mask[phrases] |= older_here.astype(np.uint64) << np.uint64(a)
        sizes = np.array([len(t) for t in p.texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        change = np.zeros(begins[-1] + 1, np.int32)
        covered = (p.ids[p.report] > p.first[p.phrase]) | (flags[p.phrase] & 1 > 0)

        def cover(report: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            change[:] += np.bincount(begins[report] + start, minlength=len(change)).astype(np.int32)
            change[:] -= np.bincount(begins[report] + end, minlength=len(change)).astype(np.int32)

        rep, at = p.report[covered], p.place[covered]
        if len(rep):
            cover(rep, np.maximum(0, at - LEFT), np.minimum(at, sizes[rep] - LENGTH) + LENGTH)
        rest = np.flatnonzero(~covered & (mask[p.phrase] > 0))
        if len(rest):
            bits = (mask[p.phrase[rest]][:, None] >> np.arange(LEFT + 1, dtype=np.uint64)) & np.uint64(1)
            k, a = np.nonzero(bits)
            start = p.place[rest[k]] - LEFT + a
            cover(p.report[rest[k]], start, start + LENGTH)
        gone = np.cumsum(change)[:-1] > 0
        removed, kept = [], []
        for t, a, b in zip(p.texts, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            removed.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(t, np.uint8)[~own].tobytes() if len(edge) else t)
        runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        own = {"n_bytes": pa.array(sizes), "removed": pa.array(removed, runs), "kept": pa.array(kept, pa.binary())}
        return pa.table({"photo_id": block.column("photo_id"), **own, "carried": block.column("carried")})

    phrases = blocks.groupBy("block").applyInArrow(list_phrases, PHRASES)
    # this exchange serves the second and the third pass
    first = phrases.groupBy("bucket").applyInArrow(dictionary, ANSWERS).repartition(n, "to")
    strings = blocks.groupBy("block").cogroup(first.groupBy("to")).applyInArrow(list_strings, STRINGS)
    second = strings.groupBy("bucket").applyInArrow(order_suffixes, ANSWERS)
    answers = first.unionByName(second)
    runs = "array<struct<start: bigint, end: bigint>>"
    schema = f"photo_id {kind_of_id}, n_bytes bigint, removed {runs}, kept binary, carried {kind_of_carried}"
    out = blocks.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(strip, schema)
    return out if carry else out.drop("carried")


def _pack_ids(ids: np.ndarray) -> bytes:
    base = int(ids.min())
    near = int(ids.max()) - base < 1 << 32
    return np.int64(base).tobytes() + ((ids - base).astype(np.uint32) if near else ids).tobytes()


def _unpack_ids(packed: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(packed, np.int64, 1)[0]
    if len(packed) == 8 + 8 * n:
        return np.frombuffer(packed, np.int64, offset=8)
    return np.frombuffer(packed, np.uint32, offset=8).astype(np.int64) + base


def _join(parts: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _table(rows: list[list], schema: str) -> pa.Table:
    """Rows as an Arrow table with the columns of a schema of ints and binaries."""
    kinds = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table({name: pa.array(list(col), pa.int32() if kind == "int" else pa.binary()) for (name, kind), col in zip(kinds, columns, strict=True)})
