"""Export a catalog: one JSON object or one CSV row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import csv_field, iso_timestamp, number_text
from folioframe.operators.provenance import field_map
from folioframe.operators.views import files_by_entity

# CSV columns and the version of the JSON layout.
CSV_COLUMNS = [
    "title", "authors", "series", "series_index", "publisher", "year", "language", "isbn10",
    "isbn13", "formats", "files", "total_size_bytes", "metadata_status", "group_method",
]
SCHEMA_VERSION = 1
JSON_FIELDS = [
    "title", "title_sort", "authors", "author_sort", "metadata_status", "group_method", "series",
    "series_index", "publisher", "year", "language", "isbn10", "isbn13", "description",
]


def json_rows(
    entities: DataFrame, members: DataFrame, provenance: DataFrame, page_files: int = 100_000
) -> DataFrame:
    """Nested export rows; null fields are left out by the writer.

    ``files`` comes in pages of ``page_files`` files in path order, numbered by ``part`` from 0; the
    objects of one entity repeat its other fields.
    """
    file = F.struct(
        "path",
        "format",
        "size_bytes",
        iso_timestamp(F.col("modified_at")).alias("modified_date"),
        "missing",
    )
    files = files_by_entity(members, file, page_files)
    maps = field_map(provenance).withColumnRenamed("book_id", "id")
    empty = F.array().cast(files.schema["files"].dataType)
    return (
        entities.join(maps, "id", "left")
        .join(files, "id", "left")
        .select(
            "id",
            *JSON_FIELDS,
            "provenance",
            F.coalesce("files", empty).alias("files"),
            F.coalesce("part", F.lit(0)).alias("part"),
        )
    )


def manifest(entities: DataFrame, exported_at: Column | None = None) -> DataFrame:
    """One row: layout version, time and number of entities."""
    now = F.current_timestamp() if exported_at is None else exported_at
    return entities.agg(F.count(F.lit(1)).alias("book_count")).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        iso_timestamp(now).alias("exported_at"),
        "book_count",
    )


def export_json(
    entities: DataFrame,
    members: DataFrame,
    provenance: DataFrame,
    folder: str,
    exported_at: Column | None = None,
    scope: DataFrame | None = None,
) -> None:
    """Write ``folder/books`` (one object per line) and ``folder/manifest``.

    ``scope`` holds the ids to export, such as a selection or the result of a filter; without it
    everything is exported.
    """
    entities, members = scoped(entities, members, scope)
    json_rows(entities, members, provenance).drop("id").write.json(f"{folder}/books")
    manifest(entities, exported_at).write.json(f"{folder}/manifest")


def scoped(entities: DataFrame, members: DataFrame, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Entities with an id in ``scope`` and their members."""
    if scope is None:
        return entities, members
    ids = scope.select("id").distinct()
    own = members.join(ids.withColumnRenamed("id", "book_id"), "book_id", "left_semi")
    return entities.join(ids, "id", "left_semi"), own.select(*members.columns)


def _file_facts(members: DataFrame) -> DataFrame:
    """(id, formats, total): every file's format, sorted, and the size of all files."""
    per_format = members.groupBy(F.col("book_id").alias("id"), "format").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("size")
    )
    listed = F.sort_array(F.collect_list(F.struct("format", "n")))
    repeated = F.flatten(F.transform(listed, lambda f: F.array_repeat(f["format"], f["n"].cast("int"))))
    return per_format.groupBy("id").agg(
        F.array_join(repeated, ";").alias("formats"), F.sum("size").alias("total")
    )


def csv_rows(
    entities: DataFrame,
    members: DataFrame,
    multi_value_separator: str = "; ",
    page_files: int = 100_000,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Flat export rows with the CSV columns as text, plus id and part.

    ``files`` comes in pages of ``page_files`` names in path order, numbered by ``part`` from 0. The
    other columns, formats and size of all files included, are the same in every row of an entity.
    """
    entities, members = scoped(entities, members, scope)
    files = files_by_entity(members, F.col("path"), page_files)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        entities.join(_file_facts(members), "id", "left")
        .join(files, "id", "left")
        .select(
            "id",
            F.coalesce("part", F.lit(0)).alias("part"),
            text(F.col("title")).alias("title"),
            text(F.array_join("authors", multi_value_separator)).alias("authors"),
            text(F.col("series")).alias("series"),
            text(number_text(F.col("series_index"))).alias("series_index"),
            text(F.col("publisher")).alias("publisher"),
            text(F.col("year")).alias("year"),
            text(F.col("language")).alias("language"),
            text(F.col("isbn10")).alias("isbn10"),
            text(F.col("isbn13")).alias("isbn13"),
            text(F.col("formats")).alias("formats"),
            text(F.array_join("files", multi_value_separator)).alias("files"),
            F.coalesce("total", F.lit(0)).cast("string").alias("total_size_bytes"),
            F.col("metadata_status"),
            F.col("group_method"),
        )
    )


# The row number inside a partition is in the low 33 bits of a monotonically increasing id.
_FIRST_ROW = (1 << 33) - 1
_MARK = "\ufeff"


def export_csv(
    entities: DataFrame,
    members: DataFrame,
    folder: str,
    delimiter: str = ",",
    multi_value_separator: str = "; ",
    scope: DataFrame | None = None,
) -> None:
    """Write RFC 4180 CSV part files: UTF-8 with byte order mark, header, CRLF after every record.

    Fields keep their own line breaks. ``scope`` holds the ids to export; without it everything is.
    """
    rows = csv_rows(entities, members, multi_value_separator, scope=scope)
    line = F.concat_ws(delimiter, *[csv_field(F.col(c), delimiter) for c in CSV_COLUMNS])
    header = F.lit(_MARK + delimiter.join(CSV_COLUMNS) + "\r\n")
    opening = F.monotonically_increasing_id().bitwiseAND(F.lit(_FIRST_ROW)) == 0
    rows.select(F.concat(F.when(opening, header).otherwise(""), line).alias("value")).write.text(
        folder, lineSep="\r\n"
    )
