"""Near-duplicate report summaries by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, only, partitions
from .components import smallest_reachable
from .pieces import give_back

#: Rows of a band and bands. Each of ROWS * BANDS / 2 permutations gives its minimum and its maximum. For sets of likeness
#: 0.8 both ends of a permutation agree with a probability of 0.64, less for small sets (3/5 for four shingles of five): a pair
#: of sets, one of more than SMALL shingles, misses every band with probability (1 - 0.63^3)^42 < 6e-6.
ROWS, BANDS = 6, 42
#: Sets of up to this many shingles also meet by their rarest shingles, and so for certain.
SMALL = 40
#: Sets that are compared in one task at most, twice this many where two slices of a large cluster meet.
SLICE = 2048

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(90210)
_FACTORS = _rng.integers(1, 1 << 63, ROWS * BANDS // 2, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, ROWS * BANDS // 2, dtype=np.uint64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles, words lower-cased in A-Z; the whole sequence where there are fewer words."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    one = np.array([digest(w) for w in words], np.uint64)
    n = len(one) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-max signatures of non-empty sets, folded into one 64-bit key per band."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    values = np.empty((len(sets), ROWS * BANDS), np.uint64)
    for i, (f, s) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        h = flat * f
        h ^= s + (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        values[:, 2 * i] = np.minimum.reduceat(h, starts)
        values[:, 2 * i + 1] = np.maximum.reduceat(h, starts)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ values[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return (keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def set_links(ids: np.ndarray, sets: list[np.ndarray], keys: list[list[int]], side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect everything the true links among these sets connect, found exactly.

    Only sets that share a band key are compared, and (with ``side``) only those of different sides. A set is compared at
    once with all sets by counting common shingles, and only while a set that it shares a key with lies in another
    component; so a group of copies is settled by its first members.
    """
    n = len(ids)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    mates: dict[int, list[int]] = defaultdict(list)
    for i, row in enumerate(keys):
        for k in row:
            mates[k].append(i)
    groups = [g for g in mates.values() if len(g) > 1]
    of: list[list[int]] = [[] for _ in range(n)]
    for g, members in enumerate(groups):
        for i in members:
            of[i].append(g)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    links = []
    # members of many common bands lie in the middle of their group: they settle most of it
    for i in sorted(range(n), key=lambda i: (-sum(len(groups[g]) for g in of[i]), i)):
        mine = root(i)
        candidates = {j for g in of[i] for j in groups[g] if root(j) != mine and (side is None or side[i] != side[j])}
        if not candidates:
            continue
        a, b = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
        spans = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=n)
        linked = 100 * common >= percent * (sizes + sizes[i] - common)
        for j in candidates:
            if linked[j] and root(j) != root(i):
                parent[root(j)] = root(i)
                links.append((int(ids[i]), int(ids[j])))
    return links


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """``sets(node, few)`` of shingle hashes -> ``(node, rare)``: the rarest shingles of each set, one more than it may lack.

    Of linked sets each holds at least ``percent`` in a hundred of the other's shingles, so that, all sets taking theirs in
    the same order, they share one of these. The order goes by how many sets hold a shingle.
    """
    one = sets.select("node", F.size("few").alias("n"), F.explode("few").alias("g"))
    counts = one.groupBy("g").agg(F.count(F.lit(1)).alias("held"))
    ranked = one.join(counts, "g").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "g"))).alias("all"))  # SMALL at most
    lacks = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return ranked.select("node", F.transform(F.slice("all", F.lit(1), (lacks + 1).cast("int")), lambda x: F.xxhash64(x["g"], F.lit("rare"))).alias("rare"))


def near_copies(
    reports: DataFrame, photo_id: str = "photo_id", summary: str = "summary", words: int = 5, percent: int = 80
) -> DataFrame:
    """``reports(photo_id, summary)`` -> ``(photo_id, n_shingles, component_id, kept)``.

    A summary's set are its distinct ``words``-word shingles (words are runs of non-white ASCII, A-Z lower-cased; the whole
    sequence if there are fewer words). Two reports link when 100 * common >= ``percent`` * union; ``component_id`` is the
    smallest id reachable, ``kept`` tells the report that has it. Summaries that are null or have no words are linked with
    nothing. Null ids stay rows of their own, linked with nothing and kept; rows that repeat an id are one node; an empty
    table gives an empty one; other columns are ignored.

    1. Min-max hashing: every permutation gives a minimum and a maximum; band keys are made of both.
    2. Equal sets collapse to their smallest id, by aggregation; only representatives go on.
    3. Representatives that share a band key form candidate clusters (components over a star per key). Small sets have
       further keys, their rarest shingles (``rare_keys``), by which linked ones always meet.
    4. A cluster meets in one task, a large one slice by slice so that every pair of slices meets once; there full sets
       are compared (``set_links``). Nothing is capped, and a cluster of any size is finished exactly.
    5. Components over the confirmed links.
    """
    spark = reports.sparkSession
    n = partitions(spark)
    r = only(reports, photo_id=photo_id, summary=summary).select(F.col("photo_id").cast("long").alias("photo_id"), F.coalesce("summary", F.lit("")).cast("binary").alias("summary"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(signatures(full)) if full else iter(())
                bands = [next(keys).tolist() if len(s) else [] for s in sets]
                digest = [_digest(s) for s in sets]
                few = [s.view(np.int64).tolist() if 0 < len(s) <= SMALL else None for s in sets]
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, long_list), pa.array(few, long_list)]
                yield pa.RecordBatch.from_arrays(cols, ["photo_id", "n_shingles", "digest", "bands", "few"])
        give_back()

    long_list = pa.list_(pa.int64())
    signed = checkpointed(r.mapInArrow(sign, "photo_id bigint, n_shingles bigint, digest binary, bands array<bigint>, few array<bigint>"))
    usable = signed.filter("n_shingles > 0 and photo_id is not null")
    # an id's rows with different texts are one node: each of its sets stands under the id
    classes = usable.groupBy("digest").agg(F.min("photo_id").alias("rep"), F.first("bands").alias("bands"), F.first("few").alias("few"))
    # nodes of the candidate graph are sets; a set's number is the hash of its digest
    classes = checkpointed(classes.withColumn("node", F.xxhash64("digest")))
    rare = checkpointed(rare_keys(classes.filter("few is not null").select("node", "few"), percent))
    keyed = classes.select("node", F.explode("bands").alias("band")).unionByName(rare.select("node", F.explode("rare").alias("band")))
    # the narrowest rows that do: there are BANDS of them for each set
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").select("band", "hub")
    stars = keyed.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = checkpointed(smallest_reachable(stars))
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n_sets")).withColumnRenamed("root", "of")
    own_keys = F.concat("bands", F.coalesce("rare", F.array().cast("array<bigint>"))).alias("bands")
    members = clusters.join(sizes, F.col("root") == F.col("of")).select(F.col("node").alias("member"), "root", "n_sets")
    members = members.join(classes, F.col("member") == F.col("node")).drop("node", "few")
    members = members.join(rare, F.col("member") == F.col("node"), "left").select("root", "n_sets", "digest", "rep", own_keys)
    # one text for each set: the row with the smallest id
    members = checkpointed(members)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "made", "shingles"])

    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = r.join(wanted, F.col("photo_id") == F.col("id"), "left_semi").select("photo_id", "summary")
    found = texts.mapInArrow(fetch, "id bigint, made binary, shingles binary").dropDuplicates(["id", "made"])
    m = members.join(found, (F.col("rep") == F.col("id")) & (F.col("digest") == F.col("made")))
    slices = F.ceil(F.col("n_sets") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("digest", F.lit(1)), slices).cast("int")
    m = m.select("root", "rep", "bands", "shingles", own.alias("own"), slices.alias("slices"))
    # slices i and j meet in task (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    m = m.select("root", "rep", "bands", "shingles", "own", other).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "bands", "shingles", "own")

    def compare(cell: pa.Table) -> pa.Table:
        give_back()
        sets = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
        keys = cell.column("bands").to_pylist()
        side = cell.column("own").to_numpy() if cell.column("i")[0].as_py() != cell.column("j")[0].as_py() else None
        links = set_links(cell.column("rep").to_numpy(), sets, keys, side, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    links = checkpointed(m.repartition(n, "root", "i", "j").groupBy("root", "i", "j").applyInArrow(compare, "a bigint, b bigint"))
    copies = usable.select("photo_id", "digest").join(classes.select("digest", "rep"), "digest").select("photo_id", "rep").distinct()
    # ids of equal sets hang on the representative; an id with several texts links their representatives
    several = copies.groupBy("photo_id").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("b")).filter("c > 1")
    joined = copies.join(several, "photo_id").select(F.col("rep").alias("a"), "b")
    reps = smallest_reachable(links.unionByName(joined).unionByName(joined.select(F.col("b").alias("a"), F.col("b"))))
    roots = copies.groupBy("photo_id").agg(F.min("rep").alias("rep")).join(reps, F.col("rep") == F.col("node"), "left").select(F.col("photo_id").alias("of"), F.coalesce("root", "rep").alias("root"))
    out = signed.select("photo_id", "n_shingles").join(roots, F.col("photo_id") == F.col("of"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("photo_id"))
    return out.select("photo_id", "n_shingles", F.coalesce(component, "photo_id").alias("component_id"), F.coalesce(component.eqNullSafe(F.col("photo_id")), F.lit(True)).alias("kept"))


def _digest(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
