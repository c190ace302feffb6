"""Periodic runs of words in report summaries, such as a language model that fell into a loop leaves them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import only

#: Bytes of summaries worked on at a time (a longer one alone).
SLICE = 2 << 20


def _ranked(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs more than once, ordered by key and then place, and a dense name for each key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    return at[order[~alone]], np.cumsum(new[~alone]) - 1


def _stretch(word: np.ndarray, low: int, high: int, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` inside [low, high) in which words a period apart are equal."""
    start, step = at, 16
    while start > low:
        a = max(low, start - step)
        bad = np.flatnonzero(word[a:start] != word[a + period : start + period])
        if len(bad):
            start = a + int(bad[-1]) + 1
            break
        start, step = a, step * 4
    end, step = at, 16
    while end + period < high:
        b = min(high - period, end + step)
        bad = np.flatnonzero(word[end:b] != word[end + period : b + period])
        if len(bad):
            end += int(bad[0])
            break
        end, step = b, step * 4
    return start, end + period


def find_loops(word: np.ndarray, first: np.ndarray, least: int = 6, copies: int = 4) -> np.ndarray:
    """Runs in several summaries at once: rows (start, end, period), by start and then period.

    ``word``: the summaries' words one after another, as numbers; ``first``: where each summary starts, and the end of the last.

    The dictionary of basic factors names every stretch of 1, 2, 4, ... words that its summary holds more than once (a longer
    factor of one that stands alone stands alone too). A factor of m words whose next two occurrences are equally far, at
    most 2m words each, proposes that distance as a period; the stretch is then extended word by word. A run of
    smallest period q has a proposal at its first word: for the m with m/2 < q <= m, a factor at the run's start recurs
    after q words and no sooner, and four copies hold three of it. Equal stretches keep their smallest period.
    """
    sizes = np.diff(first)
    low, high = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    found: dict[tuple[int, int], int] = {}
    at, name = _ranked(np.arange(len(word)), low * (int(word.max(initial=0)) + 1) + word)
    m = 1
    while len(at):
        gap = np.zeros(len(word), np.int64)
        d = at[1:] - at[:-1]
        near = (name[1:] == name[:-1]) & (d <= 2 * m) & (2 * d > m)
        gap[at[:-1][near]] = d[near]
        i = np.flatnonzero(gap)
        i = i[gap[i + gap[i]] == gap[i]]
        head = np.ones(len(i), bool)
        head[1:] = (i[1:] != i[:-1] + 1) | (gap[i[1:]] != gap[i[:-1]])
        reached: dict[int, int] = {}
        for a in i[head].tolist():
            q = int(gap[a])
            if a + 2 * q <= reached.get(q, -1):
                continue
            start, end = _stretch(word, int(low[a]), int(high[a]), a, q)
            reached[q] = end
            if end - start >= max(least, copies * q):
                found[start, end] = min(q, found.get((start, end), q))
        named = np.full(len(word), -1, np.int64)
        named[at] = name
        at = np.sort(at)
        at = at[at + 2 * m <= high[at]]
        at = at[named[at + m] >= 0]
        at, name = _ranked(at, named[at] * (int(named.max(initial=0)) + 1) + named[at + m])
        m *= 2
    rows = sorted((start, q, end) for (start, end), q in found.items())
    return np.array([(start, end, q) for start, q, end in rows], np.int64).reshape(-1, 3)


def _loops_of(summary: pa.Array, least: int, copies: int) -> list[pa.Array]:
    """(n_words, loops, collapsed) of a slice of summaries."""
    split = pc.ascii_split_whitespace(summary.cast(pa.string()).fill_null(""))
    words, of = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)
    words, of = words.filter(real), of[real.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(of, minlength=len(summary)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_loops(ids, first, least, copies)
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=len(summary)))])
    collapsed = pc.binary_join(pa.ListArray.from_arrays(left.astype(np.int32), words.filter(pa.array(kept))), " ")
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(summary)))])
    fields = [runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    loops = pa.ListArray.from_arrays(starts.astype(np.int32), pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "length", "period"]))
    return [pa.array(sizes), loops, collapsed]


def summary_loops(reports: DataFrame, photo_id: str = "photo_id", summary: str = "summary", least: int = 6, copies: int = 4) -> DataFrame:
    """Periodic runs of words in each report's summary: (photo_id, n_words, loops[start, length, period], collapsed).

    Words are runs of anything but ASCII white space, numbered from 0. A loop is a stretch of consecutive words with
    smallest period ``period``, at least ``least`` words and ``copies`` periods long, that no neighbouring word continues;
    loops come by start, then period. ``collapsed`` joins by one space the words that are not in any loop beyond that
    loop's first period. ``copies`` may be 4 or more (the search needs three occurrences of a factor up to two periods long).

    A null summary, or one without words, has no loops and an empty collapsed text. Ids may be null or repeat: every row has
    its own result. Extra columns are ignored. Each report is worked on where it lies, without a shuffle.
    """
    if copies < 4:
        raise ValueError("copies must be 4 or more")
    rows = only(reports, **{photo_id: "photo_id", summary: "summary"})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // SLICE)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if j > i:
                    part = b.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([part.column(0), *_loops_of(part.column(1), least, copies)], ["photo_id", "n_words", "loops", "collapsed"])

    kind = rows.schema["photo_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"photo_id {kind}, n_words bigint, loops array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
