"""Removal of boilerplate lines by distinct-site spread, in DataFrame functions only.

The sites of every line hash are gathered in HyperLogLog sketches, which partial aggregation merges before and after
the shuffle, so a line on a third of all pages costs one sketch for each task. Sketches decide the lines far from the
threshold; lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.fitting import free_name
from folioframe.session import materialize

MIN_SITES = 10
# A sketch of 2**12 registers errs by 1.6 % (one standard deviation); a quarter is far beyond its reach.
SKETCH_BITS = 12
MARGIN = 1.25


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column) -> list[Column]:
    """128 bits that stand for a line without its outer spaces."""
    return [F.xxhash64(F.trim(line)), F.xxhash64(F.trim(line), F.lit(1))]


def wide_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_column: str = "source") -> DataFrame:
    """(a, b) hashes of the lines found on at least ``min_sites`` distinct sites, exactly."""
    lines = docs.select(
        F.col(site_column).cast("string").alias("site"), F.explode(_lines(F.col("text"))).alias("line")
    ).filter((F.trim("line") != "") & F.col("site").isNotNull())
    hashed = lines.select("site", *[h.alias(n) for h, n in zip(_digest(F.col("line")), "ab", strict=True)])
    hashed = materialize(hashed)
    spread = materialize(
        hashed.groupBy("a", "b")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
        .filter(F.col("sites") >= min_sites / MARGIN)
    )
    sure = spread.filter(F.col("sites") >= min_sites * MARGIN).select("a", "b")
    near = spread.filter(F.col("sites") < min_sites * MARGIN).select("a", "b")
    exact = (
        hashed.join(near, ["a", "b"], "left_semi")
        .groupBy("a", "b")
        .agg(F.countDistinct("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("a", "b")
    )
    return materialize(sure.union(exact))


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, site_column: str = "source", id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` with cleaned ``text``, plus ``n_lines`` and ``n_removed``.

    A line goes wherever it stands if, without its outer spaces, it occurs on ``min_sites`` or more distinct sites.
    Empty and blank lines stay; a row without site adds no site, but is cleaned. A text that loses nothing stays as it
    is, byte for byte; a text that loses all lines is empty. Null texts stay null and have no lines. Rows that share
    an id, or have none, are cleaned each by its own lines. All columns of ``docs`` are kept, but for columns named
    ``n_lines`` or ``n_removed``, which the operator's own replace.
    """
    key, gone_set, rest = (free_name(docs.columns, n) for n in ("_key", "_gone", "_kept"))
    wide = wide_lines(docs, min_sites, site_column)
    named = docs.select(
        F.col(id_column).alias(key),
        F.explode(F.array_distinct(_lines(F.col("text")))).alias("_line"),
    ).select(key, *[h.alias(n) for h, n in zip(_digest(F.col("_line")), "ab", strict=True)])
    found = named.join(wide, ["a", "b"]).groupBy(key).agg(F.collect_set("a").alias(gone_set))
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(gone_set, F.xxhash64(F.trim(x))))
    joined = docs.join(found, F.col(id_column).eqNullSafe(F.col(key)), "left").withColumn(
        rest, F.when(F.col(gone_set).isNotNull(), kept)
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(
        *[
            F.when(F.col(rest).isNotNull() & F.col("text").isNotNull(), F.array_join(rest, "\n"))
            .otherwise(F.col("text"))
            .alias("text")
            if c == "text"
            else F.col(c)
            for c in docs.columns
            if c not in ("n_lines", "n_removed")
        ],
        n_lines.alias("n_lines"),
        F.when(F.col(rest).isNotNull() & F.col("text").isNotNull(), F.size(lines) - F.size(rest))
        .otherwise(0)
        .cast("long")
        .alias("n_removed"),
    )
