"""Accuracy, calibration and latency reports over whole prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .stats import percentiles

THRESHOLDS_KM = (1, 25, 200, 750, 2500)
BINS = 10


def with_truth(predictions: DataFrame) -> DataFrame:
    """Adds error_km and whether the truth lies inside the stated radius."""
    err = haversine_km("lat", "lon", "true_lat", "true_lon")
    p = predictions.withColumn("error_km", err)
    return p.withColumn("inside", F.col("error_km") * 1000.0 <= F.col("radius_m"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: n, median error, share within each threshold."""
    p = with_truth(predictions)
    counts = p.agg(
        F.count("*").alias("n"), *[F.avg((F.col("error_km") <= t).cast("double")).alias(f"acc_{t}km") for t in THRESHOLDS_KM]
    )
    median = percentiles(p, [], "error_km", {"median_error_km": 0.5})
    return counts.withColumn("median_error_km", median.scalar())


def calibration(predictions: DataFrame) -> DataFrame:
    """Reliability table: (bin, n, stated, observed) over ten confidence bins, the last one closed."""
    p = with_truth(predictions).withColumn("c", F.col("confidence") / 100.0)
    b = sum(((F.col("c") >= F.lit(i * 0.1)).cast("int") for i in range(1, BINS)), F.lit(0))
    return p.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("c").alias("stated"), F.avg(F.col("inside").cast("double")).alias("observed")
    )


def ece(predictions: DataFrame) -> DataFrame:
    """Expected calibration error: Σ share · |stated - observed|."""
    t = calibration(predictions)
    return t.agg((F.sum(F.col("n") * F.abs(F.col("stated") - F.col("observed"))) / F.sum("n")).alias("ece"))


def latency(log: DataFrame, status: str, ms: str, ts: str) -> DataFrame:
    """Per status: requests, p50/p95/p99 latency and requests per second over the status's time span."""
    span = (F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))) / 1e6
    n = log.groupBy(status).agg(F.count("*").alias("n"), (F.count("*") / span).alias("per_second"))
    return n.join(percentiles(log, [status], ms, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), status)


def latest_result(events: DataFrame) -> DataFrame:
    """(request, seq, type): the last result or refined event of each request."""
    e = events.filter(F.col("type").isin("result", "refined"))
    return e.groupBy("request").agg(F.max(F.struct("seq", "type")).alias("e")).select("request", "e.seq", "e.type")
