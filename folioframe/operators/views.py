"""Search, filters, sort orders and summaries over entities and their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.fields import review_chips
from folioframe.functions.text import filename, key
from folioframe.operators.ranking import collect_in_parts


def entity_ids(members: DataFrame) -> DataFrame:
    """Distinct entity ids of members; combined before the shuffle, so a hot entity is one row."""
    return members.select(F.col("book_id").alias("id")).distinct()


def member_facts(members: DataFrame) -> DataFrame:
    """One row per entity: counts, sizes, formats and missing flags of its members."""
    missing = F.coalesce("missing", F.lit(False))
    return members.groupBy(F.col("book_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.array_sort(F.collect_set("format")).alias("formats"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"),
        F.bool_or(missing).alias("any_missing"),
        F.bool_and(missing).alias("all_missing"),
    )


def catalog_view(entities: DataFrame, members: DataFrame) -> DataFrame:
    """Every entity with its member facts; an entity without members has zero of everything."""
    return entities.join(member_facts(members), "id", "left").withColumns(
        {
            "n_files": F.coalesce("n_files", F.lit(0)),
            "formats": F.coalesce("formats", F.array().cast("array<string>")),
            "total_size": F.coalesce("total_size", F.lit(0)),
            "any_missing": F.coalesce("any_missing", F.lit(False)),
            "all_missing": F.coalesce("all_missing", F.lit(False)),
        }
    )


# Columns of one file inside an entity.
FILE_FIELDS = ["path", "format", "size_bytes", "modified_at", "missing"]


def files_by_entity(
    members: DataFrame, item: Column | None = None, page_files: int = 100_000
) -> DataFrame:
    """(id, part, files): file structs in path order, in pages of ``page_files`` files."""
    item = F.struct(*FILE_FIELDS) if item is None else item
    renamed = members.withColumn("_entity", F.col("book_id"))
    return collect_in_parts(renamed, ["_entity"], item, ["path"], "files", page_files).select(
        F.col("_entity").alias("id"), "part", "files"
    )


def load_catalog(entities: DataFrame, members: DataFrame, page_files: int = 100_000) -> DataFrame:
    """Entities with their pages of files, ordered by sort title; without files one empty page."""
    files = files_by_entity(members, page_files=page_files)
    empty = F.array().cast(files.schema["files"].dataType)
    return (
        entities.join(files, "id", "left")
        .withColumn("files", F.coalesce("files", empty))
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .orderBy("title_sort", "id", "part")
    )


def entity_texts() -> Column:
    """What a search looks at in an entity itself."""
    return F.array_compact(
        F.concat(
            F.array("title"),
            F.coalesce("authors", F.array().cast("array<string>")),
            F.array("series", "isbn13", "isbn10"),
        )
    )


def search(entities: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """Entities with ``text`` in a title, author, series, identifier or file name.

    Both sides are compared as matching keys; empty text finds everything.
    """
    if text == "":
        return entities
    needle = key(F.lit(text))
    found_in = lambda c: F.contains(key(c), needle)
    in_files = (
        members.filter(found_in(filename(F.col("path"))))
        .groupBy(F.col("book_id").alias("id"))
        .agg(F.lit(True).alias("_in_files"))
    )
    return (
        entities.join(in_files, "id", "left")
        .filter(F.coalesce("_in_files", F.lit(False)) | F.exists(entity_texts(), found_in))
        .drop("_in_files")
    )


def with_format(entities: DataFrame, members: DataFrame, format: str) -> DataFrame:
    ids = entity_ids(members.filter(F.col("format") == format))
    return entities.join(ids, "id", "left_semi")


def with_status(entities: DataFrame, status: str) -> DataFrame:
    return entities if status == "all" else entities.filter(F.col("metadata_status") == status)


def with_missing_member(entities: DataFrame, members: DataFrame) -> DataFrame:
    ids = entity_ids(members.filter("missing"))
    return entities.join(ids, "id", "left_semi")


def all_members_missing(entities: DataFrame, members: DataFrame) -> DataFrame:
    """Entities that have members and have lost all of them."""
    lost = (
        members.groupBy(F.col("book_id").alias("id"))
        .agg(F.bool_and(F.coalesce("missing", F.lit(False))).alias("lost"))
        .filter("lost")
    )
    return entities.join(lost, "id", "left_semi")


def auto_grouped(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("group_method") == "filename")


def duplicate_formats(entities: DataFrame, members: DataFrame) -> DataFrame:
    """Entities with more than one member of one format."""
    repeated = members.groupBy("book_id", "format").count().filter("count > 1")
    return entities.join(entity_ids(repeated), "id", "left_semi")


def selection(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("id"), "id", "left_semi")


def chips(view: DataFrame) -> DataFrame:
    """(id, chips): why an entity of ``catalog_view`` should be looked at."""
    return view.select(
        "id",
        review_chips(
            *[
                F.col(c)
                for c in ("metadata_status", "group_method", "any_missing", "parse_error_note")
            ]
        ).alias("chips"),
    )


def sort_view(view: DataFrame, by: str = "title", ascending: bool = True) -> DataFrame:
    """Order a ``catalog_view``; the id makes the order total."""
    columns = {
        "title": [F.col("title_sort")],
        "author": [F.col("author_sort"), F.col("title_sort")],
        "year": [F.coalesce("year", F.lit(0)), F.col("title_sort")],
        "date_added": [F.col("created_at")],
        "size": [F.col("total_size")],
    }[by]
    return view.orderBy(*[c.asc() if ascending else c.desc() for c in [*columns, F.col("id")]])


def selection_summary(view: DataFrame) -> DataFrame:
    """One row: entities, files and bytes of a view."""
    return view.agg(
        F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("bytes"),
    )


def template_preview(entities: DataFrame, members: DataFrame, template: str, n: int = 3) -> DataFrame:
    """Rendered names of the first ``n`` entities, by sort title, that have files."""
    from folioframe.operators.renames import rendered_names

    first = members.groupBy(F.col("book_id").alias("id")).agg(F.min("path").alias("path"))
    chosen = entities.join(first, "id").orderBy("title_sort", "id").limit(n)
    sample = chosen.select(
        F.col("id").alias("book_id"), "id", "path", F.lit(False).alias("missing")
    )
    return rendered_names(chosen, sample, template).select(
        F.col("book_id").alias("id"), "current_name", "proposed", "tokens"
    )
