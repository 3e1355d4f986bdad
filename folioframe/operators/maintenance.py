"""Catalog upkeep: orphans, purges, cascades, moved roots and dangling references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.views import entity_ids


def orphans(entities: DataFrame, members: DataFrame) -> DataFrame:
    """Entities without members."""
    return entities.join(entity_ids(members), "id", "left_anti")


def without_orphans(entities: DataFrame, members: DataFrame) -> DataFrame:
    return entities.join(entity_ids(members), "id", "left_semi")


def cascade(dependent: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of a dependent table (``book_id``) whose entity still exists."""
    return dependent.join(entities.select(F.col("id").alias("book_id")), "book_id", "left_semi")


def purge_missing(entities: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, members) without missing members and the entities that thereby lose all."""
    kept = members.filter(~F.coalesce("missing", F.lit(False)))
    return without_orphans(entities, kept), kept


def rebase_path(path: Column, old_root: str, new_root: str) -> Column:
    """Replace the root of a path; paths elsewhere are unchanged."""
    old, new = old_root.rstrip("/") + "/", new_root.rstrip("/") + "/"
    return F.when(
        path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))
    ).otherwise(path)


def rebase(
    members: DataFrame, journal: DataFrame, old_root: str, new_root: str
) -> tuple[DataFrame, DataFrame]:
    """(members, journal) after the library moved from one root to another."""
    moved = members.withColumn("path", rebase_path(F.col("path"), old_root, new_root))
    replayed = journal.withColumns(
        {c: rebase_path(F.col(c), old_root, new_root) for c in ("old_path", "new_path")}
    )
    return moved, replayed


def clear_dangling(entities: DataFrame, assets: DataFrame, column: str = "cover_path") -> DataFrame:
    """Null a reference whose target is not in ``assets`` (path)."""
    hits = assets.select(F.col("path").alias(column)).distinct().withColumn("_hit", F.lit(True))
    return (
        entities.join(hits, column, "left")
        .withColumn(column, F.when(F.col("_hit"), F.col(column)))
        .select(*entities.columns)
    )
