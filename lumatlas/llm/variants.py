"""Spelling variants among the words read off photos, by permuterm rotations."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Letters of a word: ASCII and the Latin-1 range from U+00C0 on.
LETTERS = "[A-Za-zÀ-ÿ]+"
END = "$"


def read_words(text: Column) -> Column:
    """Runs of letters of a line, with A-Z lower-cased (no other letter changes)."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(LETTERS), F.lit(0))


def word_counts(text_lines: DataFrame, text: str = "text", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points read at least ``least_count`` times in all lines."""
    long_ones = F.filter(read_words(text_lines[f"`{text}`"]), lambda w: F.char_length(w) >= least_length)
    words = text_lines.select(F.explode(long_ones).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """Rotations of each end-marked word: (rotation, word, n, skips, counts).

    The whole rotations, and those that start after one letter and stop before it: a prefix one letter short, which all
    words share that differ in that letter only, and which is a whole rotation of the word without it. ``counts``: of equal
    letters in a row, deleting the first stands for all of them.
    """
    w, size = F.col("word"), F.char_length("word")

    def turn(i: Column, skipped: int) -> Column:
        return F.concat(F.substr(w, i + 1 + skipped, size), F.lit(END), F.substr(w, F.lit(1), i))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turn(i, 0).alias("rotation"), F.lit(False).alias("skips"), F.lit(False).alias("counts")))
    short = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            turn(i, 1).alias("rotation"), F.lit(True).alias("skips"), (F.substr(w, i + 1, F.lit(1)) != F.when(i > 0, F.substr(w, i, F.lit(1))).otherwise("")).alias("counts")
        ),
    )
    return words.select("word", "n", F.explode(F.concat(whole, short)).alias("r")).select("r.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, n_near): how many words are one insertion, deletion or replacement away, and the commonest of them.

    ``near``: struct (fewer, word) with fewer = -n; of equally common words the smallest by code points; null without any.
    Words that share a short rotation are all one edit apart, and there is at most one for each letter in a place, so
    the sorted rotations are scanned group by group: a word's commonest neighbour is the group's first, or for that
    one the second. Each pair of words meets in exactly one rotation that counts.
    """
    group = Window.partitionBy("rotation")
    ordered = group.orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("fewer"), "word")
    scanned = _rotations(words).select(
        "word", "n", "skips", "counts",
        F.first(one).over(ordered).alias("first"), F.nth_value(one, 2).over(ordered).alias("second"),
        F.count(F.when(F.col("skips"), 1)).over(ordered).alias("n_skip"),
        F.count(F.when(F.col("counts"), 1)).over(ordered).alias("n_count"),
        F.count(F.lit(1)).over(ordered).alias("n_all"),
    )
    met = scanned.filter("n_all > 1 and n_skip > 0").select(
        "word", "n",
        F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("near"),
        F.when(F.col("skips"), F.col("n_skip") - 1 + F.when(F.col("counts"), F.col("n_all") - F.col("n_skip")).otherwise(0))
        .otherwise(F.col("n_count")).alias("links"),
    )
    alone = words.select("word", "n", F.lit(None).cast("struct<fewer:bigint,word:string>").alias("near"), F.lit(0).cast("long").alias("links"))
    return met.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.min("near").alias("near"), F.sum("links").alias("n_near"))


def spelling_variants(
    text_lines: DataFrame, text: str = "text", least_length: int = 7, least_count: int = 2, ratio: int = 10
) -> DataFrame:
    """Words read off photos with their usual spelling: (word, form, root, n, n_near, form_n).

    ``text_lines`` holds what was read, a line a row. Words are runs of ASCII and Latin-1 letters, of at least ``least_length``
    code points, read ``least_count`` times or more. ``n_near`` counts the words one inserted, deleted or replaced code point
    away; ``form`` is the commonest of them (of equally common ones the first in code-point order) if it was read
    at least ``ratio`` times as often, else null; ``root`` follows forms to the last, and is the word itself without a form.

    Null and empty lines hold no words; repeated rows count as often as they occur; other columns, whatever their names, are ignored; no lines
    give no rows. Counting combines before the shuffle, so a word on a third of all lines is a row a task; a group of
    rotations has at most one word a letter and one more. Following forms takes a number of joins logarithmic
    in the longest chain, itself logarithmic in the commonest word's count.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead back")
    words = checkpointed(word_counts(text_lines, text, least_length, least_count))
    common = -F.col("near.fewer") >= ratio * F.col("n")
    known = checkpointed(
        neighbours(words).select(
            "word", F.when(common, F.col("near.word")).alias("form"), "n", "n_near", F.when(common, -F.col("near.fewer")).alias("form_n")
        )
    )
    steps = known.filter("form is not null").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("form_n")).first()[0] or 1
    chain = 1 + int(math.log(most, ratio))
    for _ in range(math.ceil(math.log2(chain + 1))):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return known.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
