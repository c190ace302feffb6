"""One-permutation MinHash fingerprints of report summaries, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, only, partitions

#: Bins of the single permutation, low-order bits kept of each bin's minimum (two hexadecimal digits), words of a shingle.
BINS, BITS, SHINGLE = 128, 8, 5
#: Hashed probes of an empty bin before the full probe order of all bins takes over.
PROBES = 24


def _shingle_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the text's word 5-grams; the whole sequence where there are fewer words."""

    def grams(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(n >= SHINGLE, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.sort_array(let(F.transform(words, lambda w: F.xxhash64(w)), grams))


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 57) + BINS // 2).cast("int")


def _probe(i: Column, t: Column | int) -> Column:
    return F.xxhash64(i, F.lit(t) if isinstance(t, int) else t).bitwiseAND(BINS - 1).cast("int")


def fingerprint(text: Column) -> Column:
    """Fingerprint of one text: 128 bins x 8 bits as 256 hexadecimal digits; '' for a text without words.

    Shingle hashes are binned once by their leading bits, and each bin keeps the low byte of its minimum. An empty bin
    takes the value of the first filled bin on its own fixed probe sequence (hashed probes, then all bins in a hashed
    order), so that two texts meet in a bin with the probability of their likeness, however short they are.
    """

    def minima(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))

    def row(x: Column, done: Column) -> Column:
        gap = F.repeat(F.lit(".."), _bin(x) - F.length(done) / 2)
        return F.concat(done, gap, F.lower(F.lpad(F.hex(x.bitwiseAND(2**BITS - 1)), 2, "0")))

    def densified(s: Column) -> Column:
        def filled(cells: Column) -> Column:
            def far(i: Column) -> Column:
                order = F.transform(
                    F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(cells, j) != ".."),
                    lambda j: F.struct(F.xxhash64(i, F.lit(-1), j).alias("k"), F.get(cells, j).alias("v")),
                )
                return F.array_min(order)["v"]

            def one(c: Column, i: Column) -> Column:
                tries = [F.nullif(F.get(cells, _probe(i, t)), F.lit("..")) for t in range(PROBES)]
                return F.when(c != "..", c).otherwise(F.coalesce(*tries, far(i)))

            return F.concat_ws("", F.transform(cells, one))

        cells = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(s, i * 2 + 1, F.lit(2)))
        return F.when(F.instr(s, ".") == 0, s).otherwise(let(cells, filled))

    def packed(mins: Column) -> Column:
        laid = F.aggregate(mins, F.lit(""), lambda done, x: row(x, done))
        return F.when(F.size(mins) == 0, F.lit("")).otherwise(let(F.rpad(laid, 2 * BINS, "."), densified))

    return let(_shingle_hashes(F.coalesce(text, F.lit(""))), lambda h: let(minima(h), packed))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1: matching bins, corrected for chance matches of 8 bits."""
    step = F.sequence(F.lit(1), F.lit(2 * BINS - 1), F.lit(2))
    same = F.size(F.filter(step, lambda i: F.substring(a, i, F.lit(2)) == F.substring(b, i, F.lit(2)))) / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(corrected)


def fingerprint_reports(reports: DataFrame, photo_id: str = "photo_id", summary: str = "summary") -> DataFrame:
    """``reports(photo_id, summary)`` -> ``(photo_id, n_chars, fingerprint)``, one row per report.

    A null summary counts as empty; a text without words has the fingerprint ''. Null and repeated ids stay rows of
    their own, an empty table gives an empty one, other columns are ignored. No shuffle.
    """
    r = only(reports, photo_id=photo_id, summary=summary)
    text = F.coalesce(F.col("summary"), F.lit(""))
    return r.select("photo_id", F.char_length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def compare_with_next(reports: DataFrame, photo_id: str = "photo_id", summary: str = "summary") -> DataFrame:
    """Fingerprints of each report, of its edited text and of the next report, and their likenesses.

    The next report is the one with the next smaller id (null ids come last, equal ids by text; after the last comes the
    first). The edited text has its last third (code points, rounded down) replaced by as many leading ones of the next
    report's summary, or all there are. Returns ``(photo_id, n_chars, summary_edited, fingerprint, edited_fingerprint,
    near_edited, near_next)``. Null summaries are empty; a table of one row is its own next.

    Reports are dealt to ranges of the id found by approximate quantiles; the texts are shuffled once. Only the first
    row of each range crosses to its neighbour.
    """
    spark = reports.sparkSession
    r = only(reports, id=photo_id, text=summary).select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    n = partitions(spark)
    share = ", ".join(f"{k / n:.8f}D" for k in range(1, n)) or "0.5D"
    cuts = only(reports, id=photo_id).agg(F.expr(f"percentile_approx(cast(id as bigint), array({share}), 10000)").alias("q")).first().q or []
    cuts = sorted({c for c in cuts if c is not None})
    ranged = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    part = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(ranged)
    r = r.select("id", "text", part.alias("part"), fingerprint(F.col("text")).alias("fp"))
    # repartition() fixes the exchange, so that the ranges' first rows below reuse it
    r = r.repartition(n, "part")
    w = Window.partitionBy("part").orderBy(F.desc_nulls_last("id"), "text")
    ahead = F.struct("text", "fp")
    r = r.select("*", F.lead(ahead).over(w).alias("within"), F.row_number().over(w).alias("at"))
    firsts = r.filter("at = 1").select("part", ahead.alias("head"))
    by_part = Window.orderBy(F.desc("part"))  # one row per range
    all_parts = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select(F.col("part").alias("of"), F.coalesce(F.lead("head").over(by_part), F.first("head").over(all_parts)).alias("head"))
    r = r.join(heads, (F.col("part") == F.col("of")) & F.col("within").isNull(), "left")
    following = F.coalesce("within", "head")
    r = r.select("id", "text", "fp", F.char_length("text").alias("n"), following["text"].alias("next"), following["fp"].alias("next_fp"))
    third = F.floor(F.col("n") / 3).cast("int")
    r = r.select("*", F.concat(F.expr("left(text, n - cast(floor(n / 3) as int))"), F.substring(F.col("next"), F.lit(1), third)).alias("edited"))
    r = r.select("id", "n", "edited", "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return r.select(
        F.col("id").alias("photo_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.col("edited").alias("summary_edited"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
