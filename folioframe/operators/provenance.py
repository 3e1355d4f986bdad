"""Where every field of an entity came from, as a long table (book_id, field, source, fetched_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import iso_timestamp
from folioframe.schemas import EDIT_FIELDS

KEYS = ["book_id", "field"]


def latest(records: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """Last write per (entity, field). Ties are broken by ``tiebreak`` columns, then by source."""
    order = F.struct("fetched_at", *(tiebreak or []), "source")
    return (
        records.groupBy(*KEYS)
        .agg(F.max(order).alias("last"))
        .select(*KEYS, F.col("last.source").alias("source"), F.col("last.fetched_at").alias("fetched_at"))
    )


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` replace records with the same key; both sides have unique keys."""
    return current.join(changes, KEYS, "left_anti").unionByName(changes)


def insert_if_absent(current: DataFrame, additions: DataFrame) -> DataFrame:
    return current.unionByName(additions.join(current, KEYS, "left_anti"))


def of_entities(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records of the entities that still exist; absorbed and purged entities take theirs along."""
    ids = entities.select(F.col("id").alias("book_id"))
    return records.join(ids, "book_id", "left_semi").select(*records.columns)


def as_records(changed: DataFrame, source: Column, fetched_at: Column) -> DataFrame:
    """(id, fields array) -> one record per changed field."""
    return changed.select(
        F.col("id").alias("book_id"),
        F.explode("fields").alias("field"),
        source.alias("source"),
        fetched_at.alias("fetched_at"),
    )


def field_map(records: DataFrame) -> DataFrame:
    """(book_id, provenance map field -> struct(source, fetched_at)).

    A field occurs once per entity, so the list holds at most one entry per known field name.
    """
    value = F.struct("source", iso_timestamp(F.col("fetched_at")).alias("fetched_at"))
    return (
        records.groupBy("book_id")
        .agg(F.array_sort(F.collect_list(F.struct("field", value.alias("value")))).alias("entries"))
        .select("book_id", F.map_from_entries("entries").alias("provenance"))
    )


def manual_fields(records: DataFrame) -> DataFrame:
    """(id, manual_fields): fields a person has set, which automatic updates never touch."""
    return (
        records.filter(F.col("source") == "manual")
        .groupBy(F.col("book_id").alias("id"))
        .agg(F.array_sort(F.collect_set("field")).alias("manual_fields"))
    )


def edit_diff(edited: DataFrame, original: DataFrame, fields: list[str] = EDIT_FIELDS) -> DataFrame:
    """(id, fields): names of the fields whose value differs between two versions of a row."""
    old = original.select("id", *[F.col(f).alias(f"old_{f}") for f in fields])
    changed = F.array_compact(
        F.array(
            *[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]
        )
    )
    return (
        edited.join(old, "id")
        .select("id", changed.alias("fields"))
        .filter(F.size("fields") > 0)
    )
