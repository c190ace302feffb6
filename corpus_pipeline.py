"""Training-corpus pipeline over ``documents``: toxic ones go, near and exact repetition goes, sources are mixed, text becomes ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatlas.llm import bpe, mixing, nearcopies, passages, toxicity
from lumatlas.llm.common import ship
from lumatlas.llm.queries import source_quality, toxicity_model
from lumatlas.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 (all without words among them), by the machine fitted on the folder's labels."""
    ship(spark)
    scored = toxicity.score_comments(docs, toxicity_model(spark, sf_dir), feedback_id="doc_id", comment="text", carry=("lang", "source", "n_chars"))
    return scored.filter("score < 0.5").select(F.col("feedback_id").alias("doc_id"), F.col("comment").alias("text"), "carried.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose five-word shingles link at 0.8; one row of each id.

    Documents without an id, or without words, belong to no group and stay.
    """
    ship(spark)
    kept = nearcopies.near_copies(docs, photo_id="doc_id", summary="text").filter("kept and photo_id is not null").select("photo_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = docs.join(kept, F.col("doc_id") == F.col("photo_id"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", "row.*").unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that smaller ids have too; one of which nothing is left goes.

    A cut inside a character drops what is left of the character; ``n_chars`` counts the text that stays.
    """
    ship(spark)

    @F.pandas_udf("string")
    def text_of(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    r = passages.remove_repeats(docs, photo_id="doc_id", summary="text", carry=("text", "lang", "source", "n_chars"))
    untouched = F.size("removed") == 0
    r = r.filter(untouched | (F.length("kept") > 0))
    text = F.when(untouched, F.col("carried.text")).otherwise(text_of("kept"))
    r = r.select(F.col("photo_id").alias("doc_id"), text.alias("text"), "carried.lang", "carried.source", untouched.alias("same"), F.col("carried.n_chars").alias("n"))
    return r.select("doc_id", "text", "lang", "source", F.when(F.col("same"), F.col("n")).otherwise(F.char_length("text")).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), photo_id="doc_id", summary="text", quality=source_quality(spark, sf_dir))
    return mixing.repeated(mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers); ``exact``: they decode to its text."""
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.struct("doc_id", "source", F.xxhash64(text).alias("hash")).alias("photo_id"), text.alias("summary"))
    r = bpe.encode_reports(whole)
    exact = F.xxhash64(bpe.decode(F.col("ids"))) == F.col("photo_id.hash")
    return r.select("photo_id.doc_id", "photo_id.source", "n_tokens", "ids", exact.alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("passage_dedup", drop_passages),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can't express a learned machine, a sampling key by hash or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's ``documents``; each but the last is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
