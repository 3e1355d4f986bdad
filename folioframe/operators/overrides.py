"""Manual decisions: merge entities, take an entity apart, split one member off, edit fields.

Manual grouping is kept as tokens on members: members with one token are one entity, whatever the
automatic rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.fields import completeness, has_items, metadata_status
from folioframe.functions.identifiers import filename_guess
from folioframe.functions.text import author_sort_key, stem, title_sort_key
from folioframe.operators.merge import first_known
from folioframe.operators.ranking import number_rows
from folioframe.schemas import FILL_FIELDS


def manual_token(seed: Column) -> Column:
    """A token derived from what it marks, so that a recomputed task yields the same one."""
    return F.concat(F.lit("manual-"), F.md5(seed))


def entity_completeness() -> Column:
    return completeness(
        *[
            F.col(c)
            for c in ("authors", "year", "isbn13", "isbn10", "cover_path", "description")
        ]
    )


def merge_survivors(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per merge request (merge_id, id): the surviving id and every field filled.

    Survivors are the most complete entities, then the lowest ids; empty fields come from the
    other entities in that order. All of it is one aggregation per request.
    """
    order = F.struct((-entity_completeness()).alias("c"), F.col("id"))
    chosen = entities.join(requests, "id").withColumn("_order", order)
    fields = [*FILL_FIELDS, "cover_path"]
    authors = F.struct("authors", "author_sort")
    by = F.col("_order")
    return (
        chosen.groupBy("merge_id")
        .agg(
            F.min_by("id", by).alias("id"),
            F.count(F.lit(1)).alias("n_entities"),
            *[F.min_by(c, by).alias(c) for c in ("title", "title_sort", "created_at")],
            first_known(authors, by, has_items(F.col("authors"))).alias("_authors"),
            F.min_by(authors, by).alias("_own"),
            F.min_by("parse_error_note", by).alias("parse_error_note"),
            *[first_known(F.col(f), by).alias(f) for f in fields],
        )
        .filter(F.col("n_entities") >= 2)
        .withColumn("_authors", F.coalesce("_authors", "_own"))
        .select("*", "_authors.authors", "_authors.author_sort")
        .drop("_authors", "_own")
        .withColumn("group_method", F.lit("manual"))
        .withColumn("metadata_status", status_column())
    )


def status_column() -> Column:
    return metadata_status(
        F.col("title"), F.col("authors"), F.col("year"), F.col("isbn13"), F.col("isbn10")
    )


def merge_entities(
    entities: DataFrame, members: DataFrame, requests: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Apply merge requests: (entities, members) with absorbed entities gone.

    Members of all merged entities move to the survivor and share one token. Provenance of the
    absorbed entities goes with them: ``provenance.of_entities`` keeps what belongs to the rest.
    """
    survivors = merge_survivors(entities, requests)
    targets = requests.join(
        survivors.select("merge_id", F.col("id").alias("survivor_id")), "merge_id"
    ).select(
        F.col("id").alias("book_id"),
        "survivor_id",
        manual_token(F.concat_ws(":", F.lit("merge"), "merge_id", "survivor_id")).alias("token"),
    )
    merged = survivors.withColumn("updated_at", now).select(*entities.columns)
    kept = entities.join(targets.select(F.col("book_id").alias("id")), "id", "left_anti")
    moved = (
        members.join(targets, "book_id", "left")
        .withColumn("manual_group_id", F.coalesce("token", "manual_group_id"))
        .withColumn("book_id", F.coalesce("survivor_id", "book_id"))
        .select(*members.columns)
    )
    return kept.unionByName(merged), moved


def seed_entities(split: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Entity rows for members that became entities of their own.

    ``split`` has id (the new entity id), path and the member's own metadata columns. The title
    falls back to the file-name guess.
    """
    guess = filename_guess(stem(F.col("path")))
    seeded = split.withColumn("_guess", guess).select(
        "id",
        F.coalesce("title", "_guess.title").alias("title"),
        F.when(has_items(F.col("authors")), F.col("authors"))
        .when(F.col("_guess.author").isNotNull(), F.array("_guess.author"))
        .otherwise(F.array().cast("array<string>"))
        .alias("authors"),
        *FILL_FIELDS,
        "parse_error_note",
    )
    complete = seeded.withColumns(
        {
            "title_sort": title_sort_key(F.col("title")),
            "author_sort": author_sort_key(F.col("authors")),
            "metadata_status": status_column(),
            "group_method": F.lit("manual"),
            "cover_path": F.lit(None).cast("string"),
            "created_at": now,
            "updated_at": now,
        }
    )
    return complete.select(*entities.columns)


def seed_provenance(split: DataFrame, now: Column) -> DataFrame:
    """Provenance of seeded entities: the file for what it held, the file name for the rest."""
    guess = filename_guess(stem(F.col("path")))
    entry = lambda name, source: F.struct(F.lit(name).alias("field"), source.alias("source"))
    embedded, filename = F.lit("embedded"), F.lit("filename")
    entries = F.array_compact(
        F.array(
            entry("title", F.when(F.col("title").isNotNull(), embedded).otherwise(filename)),
            F.when(has_items(F.col("authors")), entry("authors", embedded)).when(
                guess["author"].isNotNull(), entry("authors", filename)
            ),
            *[F.when(F.col(f).isNotNull(), entry(f, embedded)) for f in FILL_FIELDS],
        )
    )
    return (
        split.select(F.col("id").alias("book_id"), F.explode(entries).alias("e"))
        .select("book_id", "e.field", "e.source", now.alias("fetched_at"))
    )


def detach_members(
    entities: DataFrame,
    members: DataFrame,
    metadata: DataFrame,
    detached: DataFrame,
    next_id: int,
    now: Column,
    pinned: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Give every path of ``detached`` an entity of its own: (entities, members, new provenance).

    Paths of ``pinned`` only get a token of their own. The member table is joined once.
    """
    numbered = number_rows(detached.select("path"), ["path"], "id", start=next_id - 1)
    seeds = numbered.join(metadata, "path", "left")
    created = seed_entities(seeds, entities, now)
    changes = numbered.select("path", F.col("id").alias("_new"), F.lit(True).alias("_own"))
    if pinned is not None:
        changes = changes.union(
            pinned.select("path", F.lit(None).cast("long"), F.lit(True))
        )
    moved = (
        members.join(changes, "path", "left")
        .withColumn(
            "manual_group_id",
            F.when(F.col("_own"), manual_token(F.col("path"))).otherwise(F.col("manual_group_id")),
        )
        .withColumn("book_id", F.coalesce("_new", "book_id"))
        .select(*members.columns)
    )
    return entities.unionByName(created), moved, seed_provenance(seeds, now)


def ungroup(
    entities: DataFrame,
    members: DataFrame,
    metadata: DataFrame,
    requests: DataFrame,
    next_id: int,
    now: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take the entities of ``requests`` (id) apart: one entity per member.

    The first member by path keeps the original entity and its metadata; every member gets its own
    token so that automatic grouping never joins them again. Entities with one member stay as
    they are.
    """
    asked = members.join(requests.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    groups = (
        asked.groupBy("book_id")
        .agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= 2)
    )
    detached = asked.join(groups, "book_id").filter(F.col("path") != F.col("first_path"))
    entities, members, created = detach_members(
        entities,
        members,
        metadata,
        detached,
        next_id,
        now,
        pinned=groups.select(F.col("first_path").alias("path")),
    )
    marked = groups.select(F.col("book_id").alias("id"), F.lit(True).alias("_marked"))
    entities = (
        entities.join(marked, "id", "left")
        .withColumn(
            "group_method",
            F.when(F.col("_marked"), F.lit("manual")).otherwise(F.col("group_method")),
        )
        .withColumn("updated_at", F.when(F.col("_marked"), now).otherwise(F.col("updated_at")))
        .drop("_marked")
    )
    return entities, members, created


def split_members(
    entities: DataFrame,
    members: DataFrame,
    metadata: DataFrame,
    requests: DataFrame,
    next_id: int,
    now: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split the members of ``requests`` (path) off; a member that is alone stays where it is.

    When every member of an entity is asked for, the first by path keeps it.
    """
    asked = members.join(requests.select("path"), "path", "left_semi")
    sizes = (
        members.join(requests.select("path", F.lit(True).alias("_asked")), "path", "left")
        .groupBy("book_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("_asked").alias("n_asked"),
            F.min(F.when(F.col("_asked"), F.col("path"))).alias("first_asked"),
        )
        .filter((F.col("n") >= 2) & (F.col("n_asked") > 0))
    )
    detached = (
        asked.join(sizes, "book_id")
        .filter((F.col("n_asked") < F.col("n")) | (F.col("path") != F.col("first_asked")))
        .select("path")
    )
    return detach_members(entities, members, metadata, detached, next_id, now)


def apply_edits(entities: DataFrame, edited: DataFrame, now: Column) -> DataFrame:
    """Replace entity rows by their edited versions and refresh what is derived from them."""
    fresh = (
        edited.withColumn("title_sort", title_sort_key(F.col("title")))
        .withColumn("author_sort", author_sort_key(F.col("authors")))
        .withColumn("metadata_status", status_column())
        .withColumn("updated_at", now)
        .select(*entities.columns)
    )
    return entities.join(edited.select("id"), "id", "left_anti").unionByName(fresh)
