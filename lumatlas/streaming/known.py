"""An index of ids already seen, so that a batch reads what its own ids touch and not the whole store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import BATCH


class KnownIds:
    """Ids by hash bucket, with a Bloom filter for each bucket, in a folder that batches add to.

    ``ids/batch=<n>/bucket=<b>`` holds ids, ``bloom/batch=<n>/bucket=<b>`` the set words of the bucket's filter (word, bits); a batch that runs
    again replaces its own folders. :meth:`split` first asks the filters of the batch's buckets: an id whose bits aren't all set is
    new for certain. Only buckets that may hold one of the others are read, and joined on the ids themselves, so the answer equals
    the anti join with the whole store. Numbers of buckets and bits are fixed when the index is made: some 5,000 ids
    a bucket keep false hits near 1 % with the default 2^16 bits; more ids cost reads, never a wrong answer.
    The driver sees bucket numbers only, at most ``buckets`` of them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "image_id", kind: str = "bigint", buckets: int = 1024, bits: int = 1 << 16, hashes: int = 5):
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind
        self.buckets, self.bits, self.hashes = buckets, bits, hashes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _places(self) -> Column:
        """The id's places in its bucket's filter: (word, bit) of ``hashes`` hashes."""
        spots = [F.pmod(F.xxhash64(F.lit(k), F.col(self.key)), F.lit(self.bits)).cast("int") for k in range(1, self.hashes + 1)]
        one = [F.struct(F.shiftright(s, 6).alias("word"), s.bitwiseAND(63).alias("bit")) for s in spots]
        return F.explode(F.array_distinct(F.array(*one)))

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, {BATCH} bigint, bucket int").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/{part}")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Take a batch's new ids in. Null ids are never known. Files follow the buckets that the batch touches."""
        fresh = ids.select(self.key).filter(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket())
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/{BATCH}={batch_id}")
        kept = self.spark.read.schema(f"{self.key} {self.kind}, bucket int").parquet(f"{self.path}/ids/{BATCH}={batch_id}")
        set_bits = kept.select("bucket", self._places().alias("p")).groupBy("bucket", "p.word").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
        set_bits.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/bloom/{BATCH}={batch_id}")

    def _maybe(self, asked: DataFrame, batch_id: int | None) -> DataFrame:
        """Distinct asked ids whose bits are all set in their bucket's filter: (key, bucket)."""
        touched = [r.bucket for r in asked.select("bucket").distinct().collect()]
        words = self._read("bloom", "word int, bits bigint").filter(F.col("bucket").isin(touched))
        if batch_id is not None:
            words = words.filter(F.col(BATCH) != batch_id)
        words = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        places = asked.select(self.key, "bucket", self._places().alias("p")).select(self.key, "bucket", "p.word", "p.bit")
        hits = places.join(words, ["bucket", "word"], "left")
        is_set = F.coalesce(F.expr("(bits & shiftleft(1L, bit)) != 0"), F.lit(False))
        return hits.groupBy(self.key, "bucket").agg(F.min(is_set).alias("all_set")).filter("all_set").select(self.key, "bucket")

    def ids_in(self, buckets: list[int], batch_id: int | None = None) -> DataFrame:
        """Stored ids of the given buckets; those of batch ``batch_id`` itself left out."""
        ids = self._read("ids", f"{self.key} {self.kind}").filter(F.col("bucket").isin(buckets))
        return ids if batch_id is None else ids.filter(F.col(BATCH) != batch_id)

    def split(self, rows: DataFrame, batch_id: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(known, new) rows. With ``batch_id``, what that batch itself added before a retry doesn't count."""
        asked = rows.select(self.key).filter(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket())
        if not self.exists():
            return rows.limit(0), rows
        maybe = self._maybe(asked, batch_id)
        hit = [r.bucket for r in maybe.select("bucket").distinct().collect()]
        known = self.ids_in(hit, batch_id).select(self.key).distinct()
        return rows.join(known, self.key, "left_semi"), rows.join(known, self.key, "left_anti")

    def exists(self) -> bool:
        from pyspark.errors import AnalysisException

        try:
            self.spark.read.schema("x int").parquet(f"{self.path}/bloom")
        except AnalysisException:
            return False
        return True
