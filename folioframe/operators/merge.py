"""Fold member metadata into one row per entity and decide which entity a group belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.fields import has_items
from folioframe.schemas import EDIT_FIELDS, FILL_FIELDS


def first_known(value: Column, order: Column, known: Column | None = None) -> Column:
    """Aggregate: the value with the smallest ``order`` among the known ones.

    ``min_by`` ignores rows whose order is null, so unknown values drop out of the ordering. It
    combines on the map side; no group is ever sorted or gathered.
    """
    known = value.isNotNull() if known is None else known
    return F.min_by(value, F.when(known, order))


def merge_metadata(
    records: DataFrame, keys: list[str], order: list[str], fields: list[str] = EDIT_FIELDS
) -> DataFrame:
    """First known value of every field per key, in ``order``; authors: first non-empty list."""
    return records.groupBy(*keys).agg(*merged_fields(order, fields))


def merged_fields(order: list[str], fields: list[str] = EDIT_FIELDS) -> list[Column]:
    """The aggregates of ``merge_metadata``, to be combined with others in one pass."""
    by = F.struct(*order)
    return [
        first_known(F.col(f), by, has_items(F.col(f)) if f == "authors" else None).alias(f)
        for f in fields
    ]


def owner_votes(members: DataFrame, group: str, owner: str) -> DataFrame:
    """(group, owner, votes): members of a group that already belong to each entity."""
    return (
        members.filter(F.col(owner).isNotNull())
        .groupBy(group, owner)
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def elect_owner(members: DataFrame, group: str, owner: str) -> DataFrame:
    """(group, owner, votes): the entity that owns most members; ties go to the lowest id."""
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.col(owner).alias("o")))
    return (
        owner_votes(members, group, owner)
        .groupBy(group)
        .agg(best.alias("best"))
        .select(group, F.col("best.o").alias(owner), (-F.col("best.v")).alias("votes"))
    )


def concat_notes(records: DataFrame, keys: list[str], note: str, order: list[str]) -> DataFrame:
    """(keys, notes): all notes joined by ``; `` in order; keys without notes have no row.

    The result is one text value, so all notes of a key meet in one row whatever the plan.
    """
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(note).alias("note"))
    notes = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["note"])
    present = records.filter(F.col(note).isNotNull())
    return present.groupBy(*keys).agg(F.array_join(notes, "; ").alias("notes"))


def fill_empty(
    current: DataFrame,
    found: DataFrame,
    key: str = "id",
    carry: list[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Fill only empty fields of ``current`` from ``found``; adds ``filled``, their names.

    The title is never filled: an entity always has one. ``carry`` names further columns of
    ``found`` to keep; ``how`` is the kind of join.
    """
    fields = ["authors", *FILL_FIELDS]
    new = found.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], *(carry or []))
    joined = current.join(new, key, how)

    def empty(f: str) -> Column:
        return ~has_items(F.col(f)) if f == "authors" else F.col(f).isNull()

    def offered(f: str) -> Column:
        column = F.col(f"new_{f}")
        return has_items(column) if f == "authors" else column.isNotNull()

    filled = F.array_compact(
        F.array(*[F.when(empty(f) & offered(f), F.lit(f)) for f in fields])
    )
    values = {f: F.when(empty(f) & offered(f), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}
    return (
        joined.withColumn("filled", filled)
        .withColumns(values)
        .drop(*[f"new_{f}" for f in fields])
    )
