"""Ordinals and nested lists that stay spread out when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import materialize

# monotonically_increasing_id keeps the row number inside a partition in its low 33 bits.
_ROW_BITS = 33


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start + 1`` in ``order`` without a single-task window.

    Rows are range partitioned and sorted; a row's number is its place inside the partition plus
    the sizes of the partitions before it. The numbered table is written once, because range
    bounds must not be computed a second time. Only the per-partition sizes reach the driver.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return number_in_order(ranged, name, start)


def number_in_order(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start + 1`` in the order that the rows of ``df`` have."""
    table = materialize(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS).cast("int")
    sizes = {r["part"]: r["count"] for r in table.groupBy(part.alias("part")).count().collect()}
    before, seen = [], start
    for index in range(max(sizes, default=0) + 1):
        before.append(seen)
        seen += sizes.get(index, 0)
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), part)
    place = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return table.withColumn(name, offset + place + 1).drop("_place")


# Groups up to this size are ranked by a plain window in one task.
WINDOW_ROWS = 1_000_000


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    largest: int | None = None,
    window_limit: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` that survives a hot group.

    The largest group is counted first, unless the caller knows a bound (``largest``). While it is
    small a plain window is the cheapest plan.
    Otherwise the rank is the row's overall number in (keys, order) minus the first number of its
    group; the first numbers are one row per key, and a hot key only splits the large side of
    that join.
    """
    if largest is None:
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= (WINDOW_ROWS if window_limit is None else window_limit):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    numbered = number_rows(df, [*keys, *order], "_number")
    first = numbered.groupBy(*keys).agg(F.min("_number").alias("_first"))
    return (
        numbered.join(first, keys)
        .withColumn(name, F.col("_number") - F.col("_first") + 1)
        .drop("_number", "_first")
    )


def collect_in_parts(
    df: DataFrame,
    keys: list[str],
    item: Column,
    order: list[str],
    name: str,
    page_items: int = 100_000,
) -> DataFrame:
    """Ordered lists of ``item`` per key, as (keys, part, list).

    Every group is cut into pages of ``page_items`` consecutive items: part 0 holds the first ones,
    part 1 the next. Put together by part, the lists are the whole group in ``order``, and no task
    holds more than a page.
    """
    entry = F.struct(F.col("_place").alias("place"), item.alias("item"))
    return (
        rank_in_group(df, keys, order, "_place")
        .withColumn("part", F.floor((F.col("_place") - 1) / page_items).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
        .select(*keys, "part", F.transform("_entries", lambda e: e["item"]).alias(name))
    )
