"""Exact nearest photos of the retrieval index by inner product: a Voronoi join over pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

#: Most pivots (they travel with every task), and rows of a cell or of a block of queries that meet in one task.
MOST_PIVOTS, SLICE, QUERY_BLOCK = 1024, 8_192, 16_384

#: Below any score: marks a query's own row.
OWN = -(2.0**63)


def _matrix(column: pa.Array) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(data)
    return np.frombuffer(b"".join(data.to_pylist()), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point only where that is exact."""
    if float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53:
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


def nearest_photos(
    geo_index: DataFrame, queries: DataFrame, k: int = 10, photo_id: str = "photo_id", embedding: str = "embedding", scale: int = 1024
) -> DataFrame:
    """For each photo of ``queries``, the ``k`` photos of ``geo_index`` with the highest integer inner product.

    Both hold ``(photo_id, embedding)``; components become ``floor(scale * x)``. A photo is never its own neighbour; ties
    go to the smaller id. Returns ``(query_id, rank, photo_id, score)``, fewer than ``k`` ranks where the index holds
    fewer photos. Rows without an id, and embeddings that are null or hold null or non-finite components, take no part;
    shorter embeddings count as padded with zeros; repeated rows of the index are candidates each, repeated equal queries
    are asked once; other columns are ignored; an empty side gives no rows. Scores must fit 63 bits.

    Photos are dealt to the nearest of at most ``MOST_PIVOTS`` pivots, which gives Voronoi cells. A cell's summary holds
    its size, radius and the distances of its ``k`` + 1 innermost photos. For a query q and a photo at distance d from its
    pivot p, q.p - |q| d <= q.x <= q.p + |q| d. The lower bounds from the summaries fix a score that the answer reaches; a
    query is sent only to cells whose upper bound reaches it too, so no answer is lost. Cells are cut into slices and
    queries into blocks of bounded size. In many dimensions few cells can be excluded, and work grows with queries x index.
    """
    spark = geo_index.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        r = only(df, id=photo_id, vec=embedding).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return r.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad)

    index, asked = clean(geo_index), clean(queries)
    seen = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    other = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = max(seen.dim or 0, other.dim or 0, 1)
    n_pivots = max(1, min(MOST_PIVOTS, math.isqrt(seen.n) // 4))
    blocks = max(1, -(-other.n // QUERY_BLOCK))
    first = index.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()

    def whole(vecs: list[list[float]]) -> np.ndarray:
        out = np.zeros((len(vecs), dim))
        for row, v in zip(out, vecs, strict=True):
            row[: len(v)] = v
        return np.floor(out * scale)

    pivots = whole([r.vec for r in first]) if first else np.zeros((1, dim))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(1)
        for b in batches:
            x = whole(b.column(1).to_pylist())
            cell = np.argmin(square - 2 * (x @ pivots.T), 1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(x), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "vec", "cell", "far"])

    dealt = index.mapInArrow(deal, "id bigint, vec binary, cell int, far double")
    # the k + 1 innermost of each cell, found per task first
    inner = Window.partitionBy("cell").orderBy("far")
    nearest = dealt.select("cell", "far").withColumn("at", F.row_number().over(inner)).filter(F.col("at") <= k + 1)
    nearest = nearest.groupBy("cell").agg(F.array_sort(F.collect_list("far")).alias("innermost"))
    extent = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    summary = extent.join(nearest, "cell").collect()  # a row for each pivot
    cells = np.array([s.cell for s in summary], np.int64)
    radius = np.array([s.radius for s in summary])
    slices = np.array([-(-s.n // SLICE) for s in summary], np.int64)
    depth = [(np.full(len(s.innermost), i), np.array(s.innermost)) for i, s in enumerate(summary)]
    of, inside = (np.concatenate(x) for x in zip(*depth, strict=True)) if depth else (np.zeros(0, np.int64), np.zeros(0))
    wide = 1e-9  # rounding of the bounds themselves

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = whole(b.column(1).to_pylist())
            if not len(q) or not len(cells):
                continue
            to_pivot, size = q @ pivots[cells].T, np.sqrt((q**2).sum(1))[:, None]
            lower = to_pivot[:, of] - size * inside
            slack = wide * (np.abs(to_pivot).max(1) + size[:, 0] * (1 + radius.max()) + 1)
            # the query itself may be one of those counted
            reach = np.partition(lower, lower.shape[1] - k - 1, 1)[:, -k - 1] if lower.shape[1] > k else np.full(len(q), -np.inf)
            reach = reach - slack
            at, cell = np.nonzero(to_pivot + size * radius + slack[:, None] >= reach[:, None])
            times = slices[cell]
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), _packed(q).take(pa.array(at)), pa.array(reach[at]), pa.array(cells[cell].astype(np.int32)), pa.array(part.astype(np.int32))],
                ["query_id", "query", "reach", "cell", "part"],
            )

    sizes = spark.createDataFrame([(int(c), int(s)) for c, s in zip(cells, slices, strict=True)], "of int, slices int")
    held = dealt.join(F.broadcast(sizes), F.col("cell") == F.col("of"))
    held = held.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("slices")).cast("int"))
    to = F.array(*[F.lit(i) for i in range(blocks)]) if blocks <= 64 else F.sequence(F.lit(0), F.lit(blocks - 1))
    held = held.select("id", "vec", "cell", "part", F.explode(to).alias("block"))
    sent = asked.dropDuplicates().mapInArrow(send, "query_id bigint, query binary, reach double, cell int, part int")
    sent = sent.withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).cast("int"))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if mine.num_rows and theirs.num_rows:
            mine = mine.sort_by("id")  # so that ties keep the smaller ids
            ids, x = mine.column("id").to_numpy(), _matrix(mine.column("vec"))
            asking, reach = theirs.column("query_id").to_numpy(), theirs.column("reach").to_numpy()
            packed = theirs.column("query").combine_chunks()
            for a in range(0, len(asking), 256):
                s = _scores(_matrix(packed.slice(a, 256)), x)
                s[asking[a : a + 256, None] == ids] = OWN
                least = np.partition(s, s.shape[1] - k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), OWN)
                for query, v, low, far in zip(asking[a:], s, least, reach[a:], strict=False):
                    at = np.flatnonzero((v >= max(low, far)) & (v > OWN))
                    at = at[np.argsort(-v[at], kind="stable")[:k]]
                    out[0].append(np.full(len(at), query))
                    out[1].append(ids[at])
                    out[2].append(v[at].astype(np.int64))
        found = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_id", "photo_id", "score"), found, strict=True)))

    keys = ["cell", "part", "block"]
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, "query_id bigint, photo_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "photo_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "photo_id", "score")
