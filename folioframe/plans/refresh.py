"""Refresh a catalog from a new listing: diff, group, merge and write back, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.fields import has_items
from folioframe.functions.identifiers import filename_guess
from folioframe.operators import merge, provenance
from folioframe.operators.grouping import identity, resolve_groups, resolve_touched
from folioframe.operators.overrides import status_column
from folioframe.operators.ranking import number_rows
from folioframe.operators.snapshot import scan_summary, snapshot_diff
from folioframe.schemas import EDIT_FIELDS, FILL_FIELDS
from folioframe.session import materialize


@dataclass
class Catalog:
    """The tables of one catalog version."""

    entity: DataFrame
    member: DataFrame
    provenance: DataFrame


@dataclass
class Refresh:
    catalog: Catalog
    summary: DataFrame
    # Parse notes of this run, one row per member, whatever their number.
    notes: DataFrame
    # (path, component, method) of the members that were resolved in this run.
    groups: DataFrame


def refresh_catalog(
    listing: DataFrame,
    metadata: DataFrame,
    catalog: Catalog,
    overrides: DataFrame | None = None,
    now=None,
    only_touched: bool = False,
) -> Refresh:
    """New catalog version for ``listing``.

    ``metadata`` holds the extracted fields of added and updated files by path (other paths are
    ignored). A file without metadata yet keeps what was known of it and is stored as not read, so
    that the next run reads it. Members that vanished stay, marked missing. ``overrides`` (path,
    manual_group_id) replace the tokens of the files they name, new ones included; they and the
    catalog are read after ``metadata`` has been written, so decisions made while files were being
    read are respected.

    With ``only_touched`` the members of entities that nothing in this run touches are not resolved
    again (``resolve_touched``): every member comes to the entity that a full run gives it, and
    entities left alone keep their row as it is, ``updated_at`` and ``group_method`` included.
    """
    now = F.current_timestamp() if now is None else now
    metadata = materialize(metadata)
    diff = snapshot_diff(listing, catalog.member).withColumn("repinned", F.lit(False))
    if overrides is not None:
        tokens = overrides.select("path", F.col("manual_group_id").alias("_token"))
        diff = (
            diff.join(tokens, "path", "left")
            .withColumn(
                "repinned",
                F.col("_token").isNotNull() & ~F.col("_token").eqNullSafe(F.col("known_manual_group_id")),
            )
            .withColumn("known_manual_group_id", F.coalesce("_token", "known_manual_group_id"))
            .drop("_token")
        )
    extracted = metadata.withColumn("_fresh", F.lit(True))
    fresh = F.col("fresh")
    state = materialize(
        diff.join(extracted, "path", "left")
        .withColumn("fresh", F.col("change").isin("added", "updated") & F.coalesce("_fresh", F.lit(False)))
        .withColumns({f: F.when(F.col("fresh"), F.col(f)) for f in [*EDIT_FIELDS, "parse_error_note"]})
        .withColumns(
            {
                # A file that has not been read keeps the keys it had.
                "key_isbn": F.when(fresh, F.coalesce("isbn13", "isbn10")).otherwise(
                    F.col("known_embedded_isbn")
                ),
                "key_author": F.when(
                    fresh, F.when(has_items(F.col("authors")), X.author_set_key(F.col("authors")))
                ).otherwise(F.col("known_embedded_author_key")),
                "format": F.coalesce("format", "known_format"),
                "stem": X.stem(F.col("path")),
            }
        )
        .drop("_fresh")
    )
    # Titles can be long: their keys are not stored, and digests of them tell files apart.
    digest = F.md5(F.nullif(key_title(), F.lit("")))
    identities = state.select(
        *identity(
            F.col("path"),
            F.col("format"),
            F.col("stem"),
            F.col("key_isbn"),
            digest,
            F.col("key_author"),
            F.col("known_manual_group_id"),
        ),
        F.col("known_book_id").alias("owner"),
        (F.col("known_book_id").isNull() | F.col("fresh") | F.col("repinned")).alias("changed"),
    )
    if only_touched:
        groups = materialize(resolve_touched(identities))
    else:
        groups = resolve_groups(identities.drop("owner", "changed"))
    grouped = state.select("path", "known_book_id").join(groups, "path")

    # Groups that own known members keep an entity id; the others get new ids in path order.
    owners = merge.elect_owner(grouped, "component", "known_book_id").select(
        "component", F.col("known_book_id").alias("entity_id")
    )
    unowned = groups.select("component").distinct().join(owners, "component", "left_anti")
    last = catalog.entity.agg(F.max("id")).first()[0] or 0
    created = number_rows(unowned, ["component"], "entity_id", start=last)
    ids = owners.withColumn("is_new", F.lit(False)).unionByName(
        created.withColumn("is_new", F.lit(True))
    )
    # Only paths and ids are stored here; what else is known of a file joins them where it is wanted.
    assigned = state.join(materialize(groups.join(ids, "component")), "path")

    # Two groups can elect one entity: they are folded in the order of their first paths.
    order = ["component", "path"]
    by = F.struct(*order)
    folded = assigned.groupBy(F.col("entity_id").alias("id")).agg(
        *merge.merged_fields(order),
        F.max_by("method", "component").alias("_method"),
        F.min_by("stem", by).alias("_stem"),
        F.bool_or("is_new").alias("_is_new"),
        F.bool_or("fresh").alias("_any_fresh"),
    )
    notes = merge.concat_notes(assigned, ["entity_id"], "parse_error_note", order).select(
        F.col("entity_id").alias("id"), F.col("notes").alias("_notes")
    )
    groups_now = materialize(folded.join(notes, "id", "left"))

    guess = filename_guess(F.col("_stem"))
    created_rows = (
        groups_now.filter("_is_new")
        .withColumn("_guess", guess)
        .withColumns(
            {
                "_title_embedded": F.col("title").isNotNull(),
                "_authors_embedded": has_items(F.col("authors")),
                "title": F.coalesce("title", "_guess.title"),
                "authors": F.when(has_items(F.col("authors")), F.col("authors"))
                .when(F.col("_guess.author").isNotNull(), F.array("_guess.author"))
                .otherwise(F.array().cast("array<string>")),
            }
        )
        .withColumns(
            {
                "author_sort": X.author_sort_key(F.col("authors")),
                "cover_path": F.lit(None).cast("string"),
                "created_at": now,
                "filled": F.array_compact(
                    F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FILL_FIELDS])
                ),
                "_old_note": F.lit(None).cast("string"),
            }
        )
    )
    kept_rows = (
        merge.fill_empty(
            catalog.entity.withColumnRenamed("parse_error_note", "_old_note").drop(
                "group_method", "metadata_status", "title_sort", "updated_at"
            ),
            groups_now.filter(~F.col("_is_new")),
            carry=["_method", "_is_new", "_any_fresh", "_notes"],
            how="inner",
        )
        .withColumn(
            "author_sort",
            F.when(
                F.array_contains("filled", "authors"), X.author_sort_key(F.col("authors"))
            ).otherwise(F.col("author_sort")),
        )
        .withColumn("_title_embedded", F.lit(None).cast("boolean"))
        .withColumn("_authors_embedded", F.lit(None).cast("boolean"))
    )
    columns = [
        "id", "title", "authors", "author_sort", *FILL_FIELDS, "cover_path", "created_at", "filled",
        "_method", "_notes", "_any_fresh", "_old_note", "_is_new", "_title_embedded",
        "_authors_embedded",
    ]
    rows = materialize(
        created_rows.select(*columns)
        .unionByName(kept_rows.select(*columns))
        .withColumns(
            {
                "group_method": F.col("_method"),
                "metadata_status": status_column(),
                "updated_at": now,
                # A run that read no file of an entity again has nothing to say about its note.
                "parse_error_note": F.when(~F.col("_any_fresh"), F.col("_old_note")).otherwise(
                    F.col("_notes")
                ),
            }
        )
    )
    # Entities that lost every member to other groups disappear with their provenance.
    entity = rows.withColumn("title_sort", X.title_sort_key(F.col("title"))).select(*catalog.entity.columns)
    members = assigned
    if only_touched:
        rest = state.join(groups.select("path"), "path", "left_anti").withColumn("entity_id", F.col("known_book_id"))
        alone = rest.select(F.col("entity_id").alias("id")).distinct()
        entity = entity.unionByName(
            catalog.entity.join(alone, "id", "left_semi").select(*catalog.entity.columns)
        )
        members = assigned.unionByName(rest, allowMissingColumns=True)

    filled = provenance.as_records(
        rows.select("id", F.col("filled").alias("fields")), F.lit("embedded"), now
    )
    is_new = F.col("_is_new")
    source = lambda embedded: F.when(F.col(embedded), "embedded").otherwise("filename")
    named = F.array_compact(
        F.array(
            F.struct(F.lit("title").alias("field"), source("_title_embedded").alias("source")),
            F.when(
                has_items(F.col("authors")),
                F.struct(F.lit("authors").alias("field"), source("_authors_embedded").alias("source")),
            ),
        )
    )
    named_records = (
        rows.filter(is_new)
        .select(F.col("id").alias("book_id"), F.explode(named).alias("e"))
        .select("book_id", "e.field", "e.source", now.alias("fetched_at"))
    )
    records = provenance.upsert(
        provenance.insert_if_absent(catalog.provenance, filled), named_records
    ).join(entity.select(F.col("id").alias("book_id")), "book_id", "left_semi")

    return Refresh(
        catalog=Catalog(entity, upsert_members(members, catalog.member), records),
        summary=scan_summary(state),
        notes=assigned.filter(F.col("parse_error_note").isNotNull()).select(
            F.col("entity_id").alias("book_id"), "path", "parse_error_note"
        ),
        groups=groups,
    )


def key_title() -> Column:
    """Title key of a row of the state; a file that has not been read keeps the one it had."""
    return F.when(F.col("fresh"), X.key(F.col("title"))).otherwise(F.col("known_embedded_title_key"))


def upsert_members(assigned: DataFrame, current: DataFrame) -> DataFrame:
    """New member table: known rows updated, new rows numbered, vanished rows marked missing."""
    listed = F.col("change") != "missing"
    # What has not been read keeps the size and time it was last read with, or none.
    read = F.col("fresh") | (F.col("change") == "unchanged")
    rows = assigned.select(
        F.col("known_id").alias("id"),
        F.col("entity_id").alias("book_id"),
        "path",
        "format",
        F.when(read, F.col("size_bytes")).otherwise(F.col("known_size_bytes")).alias("size_bytes"),
        F.when(read, F.col("modified_at")).otherwise(F.col("known_modified_at")).alias("modified_at"),
        (~listed).alias("missing"),
        F.col("known_manual_group_id").alias("manual_group_id"),
        F.col("key_isbn").alias("embedded_isbn"),
        key_title().alias("embedded_title_key"),
        F.col("key_author").alias("embedded_author_key"),
    )
    last = current.agg(F.max("id")).first()[0] or 0
    # Paths alone are numbered; the first number of a path and the place among its rows, if it has several, make the id.
    paths = assigned.filter(F.col("known_id").isNull()).select("path")
    firsts = number_rows(paths, ["path"], "_first", start=last).groupBy("path").agg(F.min("_first").alias("_first"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("path")) - 1
    fresh = (
        rows.filter(F.col("id").isNull())
        .drop("id")
        .join(firsts.hint("merge"), "path")
        .withColumn("id", F.col("_first") + place)
    )
    return rows.filter(F.col("id").isNotNull()).select(*current.columns).unionByName(fresh.select(*current.columns))
