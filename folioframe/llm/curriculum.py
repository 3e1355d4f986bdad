"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that changes over the training run, given as a piecewise linear schedule over time 0 to 1.
Its integral is the source's demand up to a moment. The documents of a source follow each other in a fixed pseudo-random
order, and the words before a document, put through the inverse of the demand, give the moment at which it is read.
Running word counts come from range partitions, so a source of any size is spread over many tasks.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm import arrays
from folioframe.operators.ranking import number_rows
from folioframe.session import materialize

WEIGHTS = (3, 1, 2)
# (time, relative weight) knots for each of WEIGHTS: fading, growing, and peaking in the middle.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)))
SHARE = 1.5
REPEATS = 2


def _sizes(batches):
    for batch in batches:
        sizes = [np.zeros(0, np.int64)]
        for piece in arrays.pieces(batch.column("text")):
            piece.words()
            sizes.append(np.diff(piece.first))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(sizes), pa.int64())],
            ["doc_id", "source", "size"],
        )


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, pattern) of every source, its null included.

    Sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words. A target stops at
    ``REPEATS`` times its source's size; the excess is shared again by weight until no target is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("last", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit("")))
    numbered = number_rows(totals, ["last", "name"], "place")
    pattern = ((F.col("place") - 1) % len(WEIGHTS)).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), pattern)
    sources = materialize(
        numbered.select("source", "source_size", pattern.alias("pattern"), weight.alias("weight"))
    )
    cap = F.col("source_size") * float(REPEATS)
    left = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # ``level`` only grows, so what was above a former level is above this one, too.
        above = F.col("weight") * level > cap
        full, free = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        following = (left - full) / free if free else level
        if following <= level or not left:
            break
        level = following
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def _moment(pattern: Column, share: Column, schedules: tuple = SCHEDULES) -> Column:
    """Time at which the integral of a schedule reaches ``share`` of its total."""
    result = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        demand = share * sum(areas)
        moment, before = F.lit(knots[-1][0]), sum(areas)
        for (start, low), (end, high), area in reversed(list(zip(knots, knots[1:], areas))):
            before -= area
            rest = demand - before
            slope = (high - low) / (end - start)
            step = rest / low if slope == 0 else (F.sqrt(F.greatest(F.lit(low * low) + 2 * slope * rest, F.lit(0.0))) - low) / slope
            moment = F.when(demand < before + area, F.lit(start) + step).otherwise(moment)
        result = F.when(pattern == number, moment).otherwise(result)
    return F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_position, second_position), sorted by first position.

    Size is the number of words (runs without ASCII white space); null texts have none. A source is read from its first
    document on, again from the start when it ends, until its target, rounded down, is reached; the document at that
    point is taken in part. ``taken`` counts the words of a document that are read, repeats included, and is at most
    twice its size. A position is the moment in 0 to 1 at which a pass over the document begins; null where there is
    none. Rows without id come first in their source. Rows that repeat an id are read each for itself; where all their
    values agree they are interchangeable. Without words nothing is taken. Reruns give the same rows.
    """
    sized = materialize(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.col(text_column).alias("text"),
            F.col(source_column).cast("string").alias("source"),
        ).mapInArrow(_sizes, "doc_id long, source string, size long")
    )
    targets = source_targets(sized)
    order = ["source", "draw", "doc_id", "size"]
    dealt = materialize(
        sized.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    run = Window.partitionBy("source", "part").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    parts = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(
        parts["source"].alias("of"), F.col("part").alias("at"), "offset", "source_size", "target", "pattern"
    )
    placed = dealt.withColumn("within", F.sum("size").over(run) - F.col("size")).join(
        parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    )
    before = F.col("offset") + F.col("within")
    wanted = F.floor("target")
    once = F.greatest(F.least(wanted - before, F.col("size")), F.lit(0))
    again = F.greatest(F.least(wanted - F.col("source_size") - before, F.col("size")), F.lit(0))

    def position(taken: Column, words: Column) -> Column:
        return F.when(taken > 0, _moment(F.col("pattern"), words / F.col("target")))

    return (
        placed.select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (once + again).cast("long").alias("taken"),
            position(once, before).alias("first_position"),
            position(again, before + F.col("source_size")).alias("second_position"),
        )
        .repartitionByRange("first_position", "doc_id")
        .sortWithinPartitions("first_position", "doc_id")
    )
