"""Token-ID files: report summaries as Parquet lists of ids, in id order, readable by range and without the ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, partitions
from .pieces import encoder, tokenizer_path

#: Row groups and pages of the files: a reader of some ids decodes some pages, found by the page index that Spark's
#: Parquet writer always adds. Ids are dictionary-encoded (16 bits an id, then zstd); the rest is delta-encoded.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def encoded(reports: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """``(photo_id, summary)`` -> ``(photo_id, n_tokens, ids)``, row by row, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            text = batch.column(1).cast(pa.string())
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            flat, counts = enc.encode_bytes(data, ends[1:] - ends[0])
            if end_id is not None:
                flat = np.insert(flat.astype(np.int32), np.cumsum(counts), end_id)
                counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), lists], ["photo_id", "n_tokens", "ids"])

    kind = reports.schema["photo_id"].dataType.simpleString()
    reports = reports.select("photo_id", F.coalesce("summary", F.lit("")).alias("summary"))
    return reports.mapInArrow(run, f"photo_id {kind}, n_tokens bigint, ids array<int>")


def write_token_files(
    reports: DataFrame, path: str, photo_id: str = "photo_id", summary: str = "summary", tokenizer: str | None = None, end_id: int | None = 0
) -> None:
    """Write ``reports(photo_id, summary)`` as token files under ``path``, in ascending id order over the files.

    Null summaries are empty; each report ends with ``end_id`` unless that is None. Null ids come first, equal ids in the
    order of their texts. A ``tokenizer`` file that doesn't split texts by the byte-level pattern encodes whole texts. An empty table makes files without rows. Other columns are ignored. The texts, not the larger
    ids, are shuffled, once, into id ranges; no task holds more than an Arrow batch of ids.
    """
    r = only(reports, photo_id=photo_id, summary=summary)
    r = r.repartitionByRange(partitions(r.sparkSession), "photo_id").sortWithinPartitions("photo_id", "summary")
    encoded(r, tokenizer or tokenizer_path(), end_id).write.mode("overwrite").options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``(photo_id, n_tokens, ids)`` of the reports with ids from ``first`` to ``last``; the range reaches the page index."""
    r = spark.read.schema("photo_id bigint, n_tokens bigint, ids array<int>").parquet(path)
    if first is not None:
        r = r.filter(F.col("photo_id") >= first)
    return r if last is None else r.filter(F.col("photo_id") <= last)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(photo_id, start, n_tokens, ids_crc32)`` of every report in the files under ``path``.

    ``start`` counts the ids before the report in file order: rows are counted within their file, files are placed by the
    sums of those before them. ``ids_crc32`` is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    ``n_tokens`` is the length of the list that was read.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["file", "at", "photo_id", "n_tokens", "ids_crc32"])

    r = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), "photo_id", "ids")
    r = r.mapInArrow(check, "file string, at bigint, photo_id bigint, n_tokens bigint, ids_crc32 bigint")
    # the sums need the counts only, not the ids
    sums = spark.read.schema("n_tokens bigint").parquet(path).groupBy(F.col("_metadata.file_name").alias("of")).agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("of", r"part-(\d+)", 1).cast("bigint")  # as text, part-100000 would come before part-99999
    before = Window.orderBy(number, "of").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums = sums.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    r = r.join(sums, F.col("file") == F.col("of"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return r.select("photo_id", start.alias("start"), "n_tokens", "ids_crc32")
