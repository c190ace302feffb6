"""Secrets in the texts that photos were ever given, by an incremental ledger of scanned blobs. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import let, only

# ---- fixed values: rules in the order of their kinds (kind, version, pattern, group whose length counts, least length) ----
RULES = [
    (
        "assign", 1,
        """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    ("access", 1, "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", 1, "[0-9a-f]{24,}", 0, 0),
    ("pem", 1, "-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----", 0, 0),
    ("github", 1, "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", 1, "xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", 1, "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,400}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0),
]
BASE = ("assign", "access", "hex")

#: A blob that holds more than one in this many of all paths is met in several tasks.
SHARE = 4000
FOUND = "array<struct<kind: string, version: int, start: int, end: int>>"


def _before(sizes: Column) -> Column:
    """The sum of all earlier elements at each element, in blocks of about the root of their number."""

    def blocks(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int"))

        def total(part: Column) -> Column:
            return F.aggregate(part, F.lit(0), lambda n, x: n + x)

        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(a, b * width + 1, width)))
        bases = let(sums, lambda s: F.transform(s, lambda x, i: total(F.slice(s, F.lit(1), i))))
        return let(bases, lambda s: F.transform(a, lambda x, i: F.get(s, F.floor(i / width).cast("int")) + total(F.slice(a, i - i % width + 1, i % width))))

    return let(sizes, blocks)


def _places(text: Column, kind: str, version: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap, as code points: what lies between matches and the matches' own lengths add up."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.char_length(g) + F.char_length(h))
    ends = F.zip_with(_before(sizes), sizes, lambda b, s: b + s)
    parts = F.arrays_zip(ends.alias("end"), hits.alias("hit"), counted.alias("counted"))
    kept = F.filter(parts, lambda p: F.char_length(p["counted"]) >= least)
    found = F.transform(
        kept,
        lambda p: F.struct(
            F.lit(kind).alias("kind"), F.lit(version).alias("version"), (p["end"] - F.char_length(p["hit"])).alias("start"), p["end"].alias("end")
        ),
    )
    return F.when(text.rlike(pattern), found.cast(FOUND)).otherwise(F.array().cast(FOUND))


def rule_name(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


def with_blob(changes: DataFrame, photo_id: str = "photo_id", seq: str = "seq", field: str = "field", value: str = "value") -> DataFrame:
    """(photo_id, seq, field, value, blob): every version of every text field with its content address; null is the empty text."""
    c = only(changes, **{photo_id: "photo_id", seq: "seq", field: "field", value: "value"})
    c = c.withColumn("value", F.coalesce("value", F.lit("")))
    return c.withColumn("blob", F.unhex(F.sha2("value", 256)))


def scan_unseen(changes: DataFrame, ledger: DataFrame | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """Ledger rows of the blobs and rule versions not in ``ledger``: (blob, rules, found).

    ``changes`` as from :func:`with_blob`. Copies of a text combine before the one shuffle that brings each distinct text to a
    task; the ledger meets it there. A blob known to some rules only is scanned by the others. No row for a blob that
    all rules know.
    """
    blobs = changes.groupBy("blob").agg(F.first("value").alias("value"))
    names = F.array(*[F.lit(rule_name(r)) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("rules", names)
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))))
        blobs = blobs.filter(F.size("rules") > 0)
    nothing = F.array().cast(FOUND)
    found = [F.when(F.array_contains("rules", rule_name(r)), _places(F.col("value"), *r)).otherwise(nothing) for r in rules]
    return blobs.select("blob", "rules", F.concat(*found).alias("found"))


def findings_of_paths(changes: DataFrame, ledger: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(photo_id, seq, field, blob, found): what the ledger's rows say of each path's text, by start, then kind as listed.

    A blob that more than 1 in ``SHARE`` paths hold (there are at most ``SHARE``, so they are broadcast) is dealt over several tasks, and
    its ledger row to each of them.
    """
    paths = changes.select("photo_id", "seq", "field", "blob")
    order = F.array(*[F.lit(r[0]) for r in rules])
    current = F.array(*[F.lit(rule_name(r)) for r in rules])
    hits = ledger.select("blob", F.explode("found").alias("f")).filter(F.array_contains(current, F.concat("f.kind", F.lit("@"), F.col("f.version").cast("string"))))
    one = F.struct("f.start", F.array_position(order, F.col("f.kind")).alias("rank"), "f.end", "f.kind", "f.version")
    of_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_set(one)).alias("found"))
    counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    total = F.broadcast(paths.agg(F.count(F.lit(1)).alias("total")))
    most = counts.join(total, F.col("copies") * SHARE > F.col("total"))
    hot = F.broadcast(most.select("blob", F.ceil(F.col("copies") * SHARE / F.col("total")).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("photo_id", "seq", "field", F.spark_partition_id()), F.col("parts"))
    dealt = paths.join(hot, "blob", "left").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("parts")
    spread = of_blob.join(hot, "blob", "left").select("blob", "found", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long"))).alias("part"))
    found = F.coalesce(F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["version"].alias("version"), f["start"].alias("start"), f["end"].alias("end"))), F.array().cast(FOUND))
    return dealt.join(spread, ["blob", "part"], "left").select("photo_id", "seq", "field", "blob", found.alias("found"))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a ledger folder; none yet: an empty ledger."""
    schema = f"blob binary, rules array<string>, found {FOUND}, batch string"
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def scan_changes(
    changes: DataFrame,
    path: str | None = None,
    batch: str = "0",
    rules: list[tuple] = RULES,
    photo_id: str = "photo_id",
    seq: str = "seq",
    field: str = "field",
    value: str = "value",
) -> DataFrame:
    """Secrets in every version of photos' text fields: (photo_id, seq, field, blob, found[kind, version, start, end]).

    ``changes`` is a change log of photos, a row for each text a field was ever given. Each distinct text (by SHA-256) is scanned once
    for each rule version: what the ledger in folder ``path`` lacks is scanned and added to it as ``batch`` (a batch
    that is written again replaces itself), then all rows get the findings of their text. Without ``path`` a new ledger is
    kept in the cluster's shared folder. ``start`` and ``end`` (exclusive) are code points; findings come by start, then by
    the order of ``rules``; those of rules or versions not asked for are left out.

    Null and empty texts hold nothing. Repeated rows each keep their own row, null ids too. No changes: no rows. Extra
    columns, whatever their names, are ignored.
    """
    spark = changes.sparkSession
    versions = with_blob(changes, photo_id, seq, field, value)
    known = None
    if path is None:
        path = f"{checkpoint_dir(spark).rstrip('/')}/blob-ledger-{uuid.uuid4().hex}"
    else:
        from pyspark.errors import AnalysisException

        try:
            known = ledger_at(spark, path).filter(F.col("batch") != batch)
            known.schema  # noqa: B018 - raises where the folder doesn't exist yet
        except AnalysisException:
            known = None
    scan_unseen(versions, known, rules).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return findings_of_paths(versions, ledger_at(spark, path), rules)
