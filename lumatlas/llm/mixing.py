"""Mixing photo sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: No source is repeated more often than this, and so no report either.
MOST_EPOCHS = 3
#: Rows of a source that are ordered together; larger sources are cut into key ranges of about so many rows.
RUN_ROWS = 2_000


def n_words(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST_EPOCHS) -> DataFrame:
    """``sizes(source, source_size, n_rows)`` -> the same with ``target``: words each source gives to the mix.

    Sources in code-point order, null last, weigh ``weights``, repeated. All sizes together are shared out by weight; a
    source stops at ``most`` times its size, and its excess is shared again by weight until none is above. That state is
    found directly: with the sources in ascending order of cap / weight, a source is full exactly if sharing what the
    earlier (full) ones leave would lift it to its cap. One row per source, so one ordered pass.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # cap / weight rises along the order and so does the level that is left while sources fill up: the first source that
    # does not fill fixes the level of all that follow
    s = s.withColumn("open_level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "n_rows", target.alias("target"))


def mix_sources(
    photos: DataFrame,
    photo_id: str = "photo_id",
    source: str = "source",
    summary: str = "summary",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    seed: int = 17,
    out: str = "mix",
) -> DataFrame:
    """How often each photo's report enters a mix whose sources have target weights.

    ``photos(photo_id, source, summary)`` -> all its columns plus a struct ``out``: ``(size, source_size, target, copies,
    taken)``. ``size`` is the number of words of the summary (null: 0). Each source gives ``floor(target / source_size)``
    complete epochs; what is left of its target is filled by weighted sampling without replacement: reports are ordered by
    the Efraimidis-Spirakis key -ln(u) / quality, u drawn from a hash of id, text and seed, and taken while the middle of a
    report lies within the remainder. Reruns agree. ``quality(photo_id, quality)`` holds positive weights, larger is
    likelier to be taken early (of repeated ids the largest counts; null, below 0.001 or absent: 0.001, 0.001 and 1).

    Rows with equal id and text draw equal keys and stay rows of their own. Null sources form a source, null ids are
    allowed, sources without words take nothing, an empty table gives an empty one. Input columns may have any names but
    that of ``out``.

    A source of any size is cut into ranges of the key, each ordered on its own and placed by the sums of the ranges
    before it; no task holds a whole source.
    """
    names = photos.columns
    text, of = F.col(f"`{summary}`"), F.col(f"`{source}`")
    r = photos.select(
        *[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(names)],
        F.col(f"`{photo_id}`").alias("id"),
        of.alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(F.col(f"`{photo_id}`"), text, F.lit(seed)).alias("draw"),
    )
    good = F.lit(1.0)
    if quality is not None:
        known = quality.groupBy(F.col("photo_id").alias("known")).agg(
            F.greatest(F.coalesce(F.max(F.col("quality").cast("double")), F.lit(0.001)), F.lit(0.001)).alias("good")
        )
        r = r.join(known, r["id"] == known["known"], "left").drop("known")
        good = F.coalesce(F.col("good"), F.lit(1.0))
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / F.lit(2.0**53)
    r = r.withColumn("key", -F.log(u) / good)
    # one row per source: its size and the number of its rows
    sizes = photos.groupBy(of.alias("source")).agg(F.sum(n_words(text)).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goals = checkpointed(source_targets(sizes, weights)).withColumnRenamed("source", "goal_of")
    goals = F.broadcast(goals) if goals.count() <= 10_000 else goals
    r = r.join(goals, F.col("source").eqNullSafe(F.col("goal_of"))).drop("goal_of")
    # uniform for quality 1, near enough for weights around it
    runs = F.ceil(F.col("n_rows") / F.lit(RUN_ROWS))
    r = r.withColumn("run", F.least(F.floor((1 - F.exp(-F.col("key"))) * runs), runs - 1).cast("int"))
    r = r.withColumn("source_key", F.xxhash64("source"))
    before = Window.partitionBy("k", "s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = r.groupBy(F.col("source_key").alias("k"), F.col("source").alias("s"), F.col("run").alias("g")).agg(F.sum("size").alias("run_size"))
    totals = totals.select("k", "s", "g", F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("offset"))
    same = (F.col("source_key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("g"))
    r = r.join(totals, same).drop("k", "s", "g")
    within = Window.partitionBy("source_key", "source", "run").orderBy("key", "draw", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("middle", F.col("offset") + F.sum("size").over(within) - F.col("size") / 2)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when((F.col("size") > 0) & (F.col("middle") <= rest), 1).otherwise(0)
    mix = F.struct("size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    return r.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(names)], mix.alias(out))


def repeated(mixed: DataFrame, mix: str = "mix") -> DataFrame:
    """The mix itself: each row of ``mix_sources`` as often as it is taken, without the ``mix`` column."""
    times = F.sequence(F.lit(1), F.col(f"`{mix}`.copies"))
    return mixed.filter(F.col(f"`{mix}`.copies") > 0).withColumn("__copy", F.explode(times)).drop("__copy", mix)
