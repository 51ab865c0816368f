"""Mixing sources to target weights along a curriculum.

Sizes are words.  Sources in code-point order, null last, weigh WEIGHTS in turn
and share SHARE of all words; a target stops at MAX_EPOCHS times its source, and
the excess is shared anew by weight.

Each source's documents form a stream in the order of a digest of doc_id and text.  The
source's weight schedule (linear between knots over training time 0 to 1) is
integrated to its cumulative demand of words; the inverse of that demand at a
document's place in the stream is its training position.  A stream that is used
up starts again, up to the target; the last document taken may be taken in part.

Running sums are taken within buckets of a source's stream, whose number follows
the source's rows, so that no task gets all of a source.

A null text has size 0; documents of size 0 and empty sources take nothing and
have no position; a null doc_id is ordered as the empty text.  Rows that share an id,
and repeated rows, are each a document; of rows equal in id and text it doesn't matter
which comes first.  Empty tables give no rows.  Columns of the input with the names of
the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS = 1.5, 2
#: By weight: knots (time, level) of the schedule; its integral is scaled to the target.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (1.0, 1.5))}
#: Rows of a bucket of a source's stream, about; a source has as many as it needs.
BUCKET_ROWS = 1024
RESULTS = ["size", "source_size", "target", "taken", "position", "placements"]
_ORDER_BITS = 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to those with weight and target: a row a source.

    In the order of size by weight, a source is at its limit as long as its
    limit is no more than its share of what those before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    up_to = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.col("source_size") * epochs).withColumn("ratio", F.col("most") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(up_to), F.lit(0))
    left = F.sum("source_size").over(every) * F.lit(share) - before("most")
    ranked = ranked.withColumn("level", left / (F.sum("weight").over(every) - before("weight")))
    ranked = ranked.withColumn("open", F.col("most") > F.col("weight") * F.col("level"))
    # levels of open sources: that of the first holds, and none after it is lower in rank
    first = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    target = F.when(first.isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * first))
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def position_of(part: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of the schedule reaches this part of the whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, below, out = sum(areas), 0.0, None
    if total <= 0 or min(level for _, level in knots) < 0:
        raise ValueError("a schedule's levels must not be negative, nor all be 0")
    steps = []
    for (t0, m0), (t1, m1), area in zip(knots, knots[1:], areas, strict=False):
        slope, x = (m1 - m0) / (t1 - t0), part * F.lit(total) - F.lit(below)
        if area > 0:
            inside = x / F.lit(m0) if slope == 0 else (F.sqrt(F.lit(m0 * m0) + F.lit(2 * slope) * x) - F.lit(m0)) / F.lit(slope)
            steps.append((below, F.lit(t0) + inside))
        below += area
    for begin, at in steps:
        out = at if out is None else F.when(part * F.lit(total) >= F.lit(begin), at).otherwise(out)
    return out


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS,
    schedules: dict | None = None, text_col: str = "text", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` with RESULTS; placements: (pass, words, position) of each time
    that the mix takes a document, position: the first of them or null."""
    schedules = schedules or SCHEDULES
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    # the text's digest too, so that rows without an id are spread as well
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    digest = F.conv(F.substring(F.md5(named.cast("binary")), 1, _ORDER_BITS // 4), 16, 10)
    # a key that is never null, so that the window's partitioning serves the join too
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    # a row a source: small, so that Spark sends it to all tasks while it is
    rows = common.stored(docs.select(key.alias("_key")).groupBy("_key").agg(F.count("*").alias("_n")), "sources")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / bucket_rows))).cast("int")
    sized = common.without(docs, RESULTS).withColumns({"size": size, "_order": digest.cast("long"), "_key": key})
    sized = sized.join(rows.select("_key", bits.alias("_bits")), "_key")
    sized = sized.withColumn("_bucket", F.expr(f"shiftright(_order, {_ORDER_BITS} - _bits)")).drop("_bits")

    # one aggregation for both uses: the source's name is in the key
    sums = sized.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    in_order = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_words").over(in_order), F.lit(0)))
    whole = sums.groupBy("_key").agg(F.sum("_words").alias("source_size"))
    named = whole.select(F.when(F.col("_key") != "", F.expr("substr(_key, 2)")).alias("source"), "source_size")
    goals = targets(named, weights, share, epochs).withColumn("_key", key).drop("source")
    places = offsets.drop("_words").join(goals, "_key")

    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(places, ["_key", "_bucket"])

    before = F.col("_before") + F.col("_offset")
    goal = F.least(F.floor(F.col("target") + F.lit(0.5)), F.col("source_size") * epochs)
    passes = F.when(F.col("source_size") > 0, F.expr("_goal div source_size")).otherwise(F.lit(0))
    placed = placed.withColumn("_before", before).withColumn("_goal", goal).withColumn("_passes", passes)
    rest = F.greatest(F.lit(0), F.least(F.col("_goal") - F.col("_passes") * F.col("source_size") - F.col("_before"), F.col("size")))
    placed = placed.withColumn("_rest", rest).withColumn("taken", F.col("_passes") * F.col("size") + F.col("_rest"))

    def at(k: Column) -> Column:
        part = (k * F.col("source_size") + F.col("_before")) / F.col("target")
        out = F.lit(None).cast("double")
        for weight in sorted(set(weights)):
            out = F.when(F.col("weight") == weight, position_of(part, schedules[weight])).otherwise(out)
        return out

    times = F.col("_passes") + F.when(F.col("_rest") > 0, 1).otherwise(0)
    one = lambda k: F.struct(k.cast("int").alias("pass"), F.when(k < F.col("_passes"), F.col("size")).otherwise(F.col("_rest")).alias("words"), at(k).alias("position"))
    made = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), one)).otherwise(F.array())
    placed = placed.withColumn("placements", made).withColumn("position", F.try_element_at("placements", F.lit(1))["position"])
    return placed.select(*[f"`{c}`" for c in docs.columns if c.lower() not in RESULTS], *RESULTS)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each placement, range-sorted by position: columns pass, words,
    position take the place of placements."""
    out = common.without(mixed, ["pass", "words", "position"]).withColumn("_p", F.explode("placements")).drop("placements")
    out = out.select("*", "_p.pass", "_p.words", "_p.position").drop("_p")
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def sorted_documents(mixed: DataFrame) -> DataFrame:
    """A row for each document, range-sorted by first position; those that the
    mix doesn't take come last, spread by the digest of their id."""
    key = F.coalesce(F.col("position"), F.lit(1) + F.abs(F.xxhash64("doc_id") % 1024) / 1024)
    return mixed.repartitionByRange(key, F.col("doc_id")).sortWithinPartitions(key, "doc_id")
