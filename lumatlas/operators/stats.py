"""Grouped statistics that stay exact without gathering a group in one task.

Every first step is a plain grouped sum, so a key holding a large share of the rows is reduced on the map side before
it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096
EXP_STEP = 64.0


def logsumexp(df: DataFrame, keys: list[str], x: str, out: str = "lse") -> DataFrame:
    """Stable log Σ exp(x) per key: sums per exponent band first, so no maximum has to be known in advance."""
    band = F.floor(F.col(x) / EXP_STEP)
    part = df.groupBy(*keys, band.alias("_b")).agg(F.sum(F.exp(F.col(x) - F.floor(F.col(x) / EXP_STEP) * EXP_STEP)).alias("_s"))
    top = part.groupBy(*keys).agg(F.max("_b").alias("_m"), F.collect_list(F.struct("_b", "_s")).alias("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda a, e: a + e["_s"] * F.exp((e["_b"] - F.col("_m")) * EXP_STEP))
    return top.select(*keys, (F.col("_m") * EXP_STEP + F.log(total)).alias(out))


def _bucketed(df: DataFrame, keys: list[str], value: str, weight) -> DataFrame:
    """Distinct values per key with their weight and an equal-width bucket number."""
    c = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.sum(weight).alias("_w"))
    b = c.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    c = c.join(b, keys) if keys else c.withColumn("_lo", b.select("_lo").scalar()).withColumn("_hi", b.select("_hi").scalar())
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS))).otherwise(0)
    return c.select(*keys, "_v", "_w", bucket.cast("int").alias("_k"))


def _histogram(c: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket weights with what lies before each bucket and in all: at most BUCKETS rows per key."""
    h = c.groupBy(*keys, "_k").agg(F.sum("_w").alias("_bw"))
    w = W.partitionBy(*(keys or [F.lit(1)]))
    run = F.sum("_bw").over(w.orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow))
    return h.withColumn("_before", run - F.col("_bw")).withColumn("_all", F.sum("_bw").over(w))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str = "quantile") -> DataFrame:
    """First value whose cumulative weight share reaches q, per key; 0 when the weights sum to nothing."""
    c = _bucketed(df, keys, value, F.col(weight))
    h = _histogram(c, keys)
    goal = F.col("_all") * q
    pick = h.filter((F.col("_before") < goal) & (F.col("_before") + F.col("_bw") >= goal * (1 - 1e-12)))
    w = W.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = c.join(pick, [*keys, "_k"]).withColumn("_cum", F.col("_before") + F.sum("_w").over(w))
    hit = inner.filter(F.col("_cum") / F.col("_all") >= q - 1e-12)
    return hit.groupBy(*keys).agg(F.min("_v").alias(out))


def percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per key, one column per entry of ``qs``."""
    c = _bucketed(df, keys, value, F.lit(1))
    h = _histogram(c, keys)
    ranks = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("name"), (F.floor((F.col("_all") - 1) * q) + off).alias("rank"), F.lit(off).alias("off"))
                for n, q in qs.items()
                for off in (0, 1)
            ]
        )
    )
    want = h.select("*", ranks.alias("r")).withColumn("_rank", F.least(F.col("r.rank"), F.col("_all") - 1))
    want = want.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bw")))
    w = W.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hot = want.select(*keys, "_k", "_before").distinct()
    inner = c.join(hot, [*keys, "_k"]).withColumn("_end", F.col("_before") + F.sum("_w").over(w))
    inner = inner.select(*keys, "_k", "_v", "_w", "_end")
    got = want.drop("_before", "_bw").join(inner, [*keys, "_k"]).filter(
        (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_w"))
    )
    aggs = []
    for n, q in qs.items():
        lo = F.max(F.when((F.col("r.name") == n) & (F.col("r.off") == 0), F.col("_v")))
        hi = F.max(F.when((F.col("r.name") == n) & (F.col("r.off") == 1), F.col("_v")))
        pos = (F.max("_all") - 1) * F.lit(q)
        aggs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(n))
    return got.groupBy(*keys).agg(*aggs)
