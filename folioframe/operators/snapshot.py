"""Difference of two listings and the counts that describe it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import extension
from folioframe.schemas import FORMATS


def ignored_extensions(setting: str) -> list[str]:
    """Comma-separated setting -> trimmed lower-case extensions."""
    return [e for e in (part.strip().lower() for part in setting.split(",")) if e]


def select_listing(
    files: DataFrame, formats: list[str] = FORMATS, ignore: str = ""
) -> DataFrame:
    """Listing rows (path, format, size_bytes, modified_at) of known, not ignored formats."""
    wanted = [f for f in formats if f not in ignored_extensions(ignore)]
    return files.select(
        "path", F.lower(extension(F.col("path"))).alias("format"), "size_bytes", "modified_at"
    ).filter(F.col("format").isin(wanted))


def is_unchanged(size_a: Column, size_b: Column, time_a: Column, time_b: Column) -> Column:
    """Same size and modification times less than one second apart."""
    gap = F.abs(F.unix_micros(time_a) - F.unix_micros(time_b))
    return (size_a == size_b) & (gap < 1_000_000)


def snapshot_diff(listing: DataFrame, known: DataFrame) -> DataFrame:
    """One row per path of either side with ``change``: added, updated, unchanged or missing.

    ``known`` needs path, size_bytes, modified_at and missing; its columns come back as known_*.
    """
    before = known.select(
        "path", *[F.col(c).alias(f"known_{c}") for c in known.columns if c != "path"]
    ).withColumn("_known", F.lit(True))
    now = listing.withColumn("_listed", F.lit(True))
    unchanged = is_unchanged(
        F.col("size_bytes"), F.col("known_size_bytes"), F.col("modified_at"), F.col("known_modified_at")
    )
    change = (
        F.when(F.col("_listed").isNull(), "missing")
        .when(F.col("_known").isNull(), "added")
        .when(F.coalesce(unchanged, F.lit(False)), "unchanged")
        .otherwise("updated")
    )
    return (
        now.join(before, "path", "full_outer").withColumn("change", change).drop("_known", "_listed")
    )


def scan_summary(diff: DataFrame) -> DataFrame:
    """Counts of one scan; only rows that were not missing before count as marked missing."""
    newly = (F.col("change") == "missing") & ~F.coalesce(F.col("known_missing"), F.lit(False))
    return diff.agg(
        *[
            F.count_if(F.col("change") == name).alias(name)
            for name in ("added", "updated", "unchanged")
        ],
        F.count_if(newly).alias("marked_missing"),
        F.count_if(F.col("change") != "missing").alias("total_files"),
    )


def to_extract(diff: DataFrame) -> DataFrame:
    """Rows whose contents must be read again."""
    return diff.filter(F.col("change").isin("added", "updated"))


def paths_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of ``left`` that ``right`` does not have."""
    return left.select("path").join(right.select("path"), "path", "left_anti")
