"""Quality of report summaries: perplexity under an interpolated modified Kneser-Ney model of trusted summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, only, partitions

#: Bytes of an n-gram; an n-gram is one number, its order in the top byte and its bytes below, the last one lowest.
ORDER = 5
#: Text of a block that asks for the probabilities of its n-grams at once.
BLOCK_BYTES = 16 << 20
#: Trusted ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Probabilities travel as logarithms in steps of 1 / LOG_STEPS.
LOG_STEPS = 1000
#: A language's limits: quantiles of trusted summaries' perplexities, found to STEP in the logarithm.
LOW, HIGH, STEP = 0.002, 0.995, 1e-3


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER``-gram that ends at each byte of the texts (zero bytes before their starts), and the texts' sizes."""
    pad = bytes(ORDER - 1)
    data = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
    g = np.zeros(max(0, len(data) - ORDER + 1), np.int64)
    for i in range(ORDER):
        g = g << 8 | data[i : i + len(g)]
    sizes = np.array([len(t) for t in texts], np.int64)
    real = np.repeat(np.arange(len(texts)) * (ORDER - 1), sizes) + np.arange(sizes.sum())
    return g[real], sizes


def count_grams(reports: DataFrame) -> DataFrame:
    """``(summary binary)`` -> ``(g, c)``: how often each ``ORDER``-gram occurs; counted per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                g, _ = grams(b.column(0).slice(at, 2048).to_pylist())
                keys, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["g", "c"])

    return reports.mapInArrow(count, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``(g, c)`` -> ``(key, p, back)`` for n-grams of all orders.

    ``p`` is the interpolated probability of the n-gram's last byte after the others, ``back`` the weight that the n-gram,
    as a context, leaves to the next shorter one. Lower orders count distinct bytes to the left; the discounts of counts
    one, two and more come from each order's counts of counts. Every step is a join or an aggregation by n-gram.
    """
    levels = {ORDER: checkpointed(counts)}
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit(_mask(n)))
        levels[n] = checkpointed(levels[n + 1].groupBy(shorter.alias("g")).agg(F.count(F.lit(1)).alias("c")))
    model, below = None, None
    for n in range(1, ORDER + 1):
        c = levels[n]
        n1, n2, n3, n4 = (max(1, x or 0) for x in c.agg(*[F.sum(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2)
        d = [min(k, max(0.1 * k, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("g", 8)
        of = c.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("left"))
        seen = c.join(of, context == F.col("h")).select("g", ((F.col("c") - cut) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("back"))
        if below is None:
            p = seen.select("g", (F.col("own") + F.col("back") / 256).alias("p"))
        else:
            low = below.select(F.col("g").alias("s"), F.col("p").alias("q"))
            p = seen.join(low, F.col("g").bitwiseAND(F.lit(_mask(n - 1))) == F.col("s")).select("g", (F.col("own") + F.col("back") * F.col("q")).alias("p"))
        below = checkpointed(p)
        none = F.lit(None).cast("double")
        rows = below.select((F.col("g") + F.lit(n << 56)).alias("key"), "p", none.alias("back"))
        rows = rows.unionByName(of.select((F.col("h") + F.lit(n - 1 << 56)).alias("key"), none.alias("p"), (F.col("left") / F.col("total")).alias("back")))
        model = rows if model is None else model.unionByName(rows)
    return model.groupBy("key").agg(F.max("p").alias("p"), F.max("back").alias("back"))


def perplexities(reports: DataFrame, model: DataFrame, photo_id: str = "photo_id", summary: str = "summary") -> DataFrame:
    """``reports(photo_id, summary)`` -> ``(photo_id, n_bytes, perplexity)``, per byte; null for empty summaries.

    Blocks of reports list their distinct n-grams, packed by shard of the model; each shard answers every block; a block
    backs off to shorter n-grams where one was never seen. Texts are shuffled once, compressed; no task holds more of the
    model than one shard.
    """
    spark = reports.sparkSession
    shards = partitions(spark)
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

    blocks = r.mapInArrow(pack, f"photo_id {kind}, packed binary, block int").repartition(shards, "block")

    def texts_of(block: pa.Table) -> list[bytes]:
        import zstandard

        raw = zstandard.ZstdDecompressor()
        return [raw.decompress(t) for t in block.column("packed").to_pylist()]

    def asked(texts: list[bytes]) -> list[np.ndarray]:
        """Distinct n-grams of each order from 0 on, with the contexts they fall back through."""
        parts = [pd.unique(grams(texts[a : a + 512])[0]) for a in range(0, len(texts), 512)]
        own = [np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]))]
        for n in range(ORDER - 1, -1, -1):
            own.append(np.unique(np.concatenate([own[-1] & _mask(n), own[-1] >> 8])))
        return own[::-1]

    def dealt(keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)

    def list_grams(block: pa.Table) -> pa.Table:
        keys = np.concatenate([g + (n << 56) for n, g in enumerate(asked(texts_of(block)))])
        shard = dealt(keys)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        full = [s for s in range(shards) if ends[s] < ends[s + 1]]
        # ascending within a shard, so their differences are short numbers
        packed = [_squeeze(np.diff(keys[order[ends[s] : ends[s + 1]]], prepend=0)) for s in full]
        of = block.column("block")[0].as_py()
        return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([of] * len(full), pa.int32()), "keys": pa.array(packed, pa.binary())})

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key").to_numpy()
        order = np.argsort(key)
        key = key[order]
        p, back = (np.nan_to_num(known.column(c).to_numpy().astype(np.float64)[order]).astype(np.float32) for c in ("p", "back"))
        values = []
        for packed in asks.column("keys").to_pylist():
            k = np.cumsum(_expand(packed, np.int64))
            at = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
            hit = key[at] == k if len(key) else np.zeros(len(k), bool)
            found = [np.where(hit, x[at], 0) if len(key) else np.zeros(len(k)) for x in (p, back)]
            logs = [np.where(x > 0, np.clip(np.rint(-LOG_STEPS * np.log(np.where(x > 0, x, 1))), 0, 32766) + 1, 0) for x in found]
            values.append(_squeeze(np.stack(logs).astype(np.int16)))
        return pa.table({"to": asks.column("block"), "shard": asks.column("shard"), "value": pa.array(values, pa.binary())})

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(block)
        own = asked(texts)
        keys = np.concatenate([g + (n << 56) for n, g in enumerate(own)])
        shard = dealt(keys)
        order = np.argsort(shard, kind="stable")
        starts = np.searchsorted(shard[order], np.arange(shards + 1))
        value = np.zeros((2, len(keys)), np.float32)
        for s, packed in zip(answers.column("shard").to_pylist(), answers.column("value").to_pylist(), strict=True):
            logs = _expand(packed, np.int16).reshape(2, -1).astype(np.float32)
            value[:, order[starts[s] : starts[s + 1]]] = np.where(logs > 0, np.exp((1 - logs) / LOG_STEPS), 0)
        at = 0
        p, back = [], []
        for g in own:
            p.append(value[0, at : at + len(g)].astype(float))
            back.append(np.where(value[1, at : at + len(g)] > 0, value[1, at : at + len(g)], 1).astype(float))
            at += len(g)
        p[0][:] = 1 / 256
        for n in range(1, ORDER + 1):
            fallback = back[n - 1][np.searchsorted(own[n - 1], own[n] >> 8)] * p[n - 1][np.searchsorted(own[n - 1], own[n] & _mask(n - 1))]
            p[n] = np.where(p[n] > 0, p[n], fallback)
        log_p = np.log(p[ORDER])
        total = np.zeros(len(texts))
        for a in range(0, len(texts), 512):
            g, sizes = grams(texts[a : a + 512])
            codes, distinct = pd.factorize(g)
            each = log_p[np.searchsorted(own[ORDER], distinct)][codes]
            full = np.flatnonzero(sizes)
            total[a + full] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[full]) if len(full) else 0
        sizes = np.array([len(t) for t in texts], np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            ppl = np.exp(-total / np.maximum(sizes, 1))
        return pa.table({"photo_id": block.column("photo_id"), "n_bytes": pa.array(sizes), "perplexity": pa.array(ppl, mask=sizes == 0)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(dealt(b.column(0).to_numpy())), *b.columns], ["shard", "key", "p", "back"])

    placed = model.select("key", "p", "back").mapInArrow(place, "shard int, key bigint, p double, back double")
    asks = blocks.groupBy("block").applyInArrow(list_grams, "shard int, block int, keys binary")
    answers = asks.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(answer, "to int, shard int, value binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(score, f"photo_id {kind}, n_bytes bigint, perplexity double")


def _squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _expand(packed: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _bin(perplexity: Column) -> Column:
    return F.floor(F.log(perplexity) / STEP)


def classify(
    reports: DataFrame, trusted: DataFrame, photo_id: str = "photo_id", summary: str = "summary", lang: str = "lang", low: float = LOW, high: float = HIGH
) -> DataFrame:
    """``reports(photo_id, summary, lang)`` and ``trusted(photo_id)`` -> ``(photo_id, lang, n_bytes, perplexity, low, high, kept)``.

    The model counts byte n-grams in four fifths of the trusted summaries (by a hash of the id); the other fifth sets the
    limits: exact ``low`` and ``high`` quantiles of its perplexities for each language, and over all languages for those
    without any (null is a language of its own). A language with fewer than ``1 / low`` (500) or ``1 / (1 - high)`` (200)
    such summaries has too few for that quantile; the fewer, the more its limit is drawn outwards to the limit over all
    languages, or to that limit's distance from the median laid at the language's own median. A report is kept if its perplexity lies within its language's limits: text
    that no trusted one resembles lies above, endless repetition below.

    Empty and null summaries have no perplexity and are not kept; without trusted summaries all others are kept. Null and
    repeated ids stay rows of their own (null ones are never trusted); an empty table gives an empty one; other columns
    are ignored.
    """
    r = only(reports, photo_id=photo_id, summary=summary, lang=lang)
    known = trusted.select(F.col("photo_id").alias("known")).filter("known is not null").distinct()
    test = F.pmod(F.xxhash64("known"), F.lit(5)) == 0
    taught = known.filter(~test)
    # a checked broadcast spares a shuffle of the texts
    taught = F.broadcast(taught) if taught.count() <= BROADCAST_IDS else taught
    learn = r.join(taught, F.col("photo_id") == F.col("known"), "left_semi").select(F.coalesce("summary", F.lit("")).cast("binary").alias("summary"))
    ids = r.select(F.struct("photo_id", "lang").alias("photo_id"), "summary")
    scored = checkpointed(perplexities(ids, kneser_ney(count_grams(learn))).select("photo_id.*", "n_bytes", "perplexity"))
    held = scored.join(known.filter(test), F.col("photo_id") == F.col("known"), "left_semi").filter("perplexity is not null")
    # exact quantiles on a grid: a few thousand bins a language at most
    bins = held.groupBy("lang", _bin(F.col("perplexity")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def limits(b: DataFrame, by: list[str]) -> DataFrame:
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        upto = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        b = b.select(*by, "bin", upto.alias("upto"), F.sum("n").over(part).alias("all"))
        ends = [
            ((F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bin"))) + k) * STEP).alias(name) for q, k, name in ((low, 0, "low"), (0.5, 0.5, "mid"), (high, 1, "high"))
        ]
        return b.groupBy(*by).agg(*ends, F.max("all").alias("rows"))

    every = limits(bins.groupBy("bin").agg(F.sum("n").alias("n")), []).first()
    own = limits(bins, ["lang"])
    if every["rows"]:
        # too few rows for a quantile: the wider of all languages' limit and its distance from their middle, laid at the language's own
        ends = []
        for end, tail, wider in (("low", low, F.least), ("high", 1 - high, F.greatest)):
            sure = F.least(F.lit(1.0), F.col("rows") * tail)
            lent = wider(F.lit(every[end]), F.col("mid") + F.lit(every[end] - every["mid"]))
            ends.append(F.exp(sure * F.col(end) + (1 - sure) * wider(F.col(end), lent)).alias(end))
        own = own.select("lang", *ends)
    own = own.select(F.col("lang").alias("of"), "low", "high")
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    bounds = {k: F.coalesce(k, F.lit(math.exp(every[k]) if every["rows"] else None).cast("double")) for k in ("low", "high")}
    out = out.withColumns(bounds)
    within = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("photo_id", "lang", "n_bytes", "perplexity", "low", "high", within.alias("kept"))
