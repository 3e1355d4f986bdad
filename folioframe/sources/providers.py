"""Responses of external catalogs: JSON text -> candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.fields import cover_link, largest_image
from folioframe.functions.identifiers import isbn_assign, parse_year
from folioframe.functions.text import similarity
from folioframe.schemas import IDENTIFIERS_PER_RECORD

VOLUMES_SCHEMA = (
    "items ARRAY<STRUCT<id: STRING, volumeInfo: STRUCT<title: STRING, authors: ARRAY<STRING>, "
    "publisher: STRING, publishedDate: STRING, description: STRING, "
    "industryIdentifiers: ARRAY<STRUCT<type: STRING, identifier: STRING>>, language: STRING, "
    "imageLinks: STRUCT<extraLarge: STRING, large: STRING, medium: STRING, small: STRING, "
    "thumbnail: STRING, smallThumbnail: STRING>>>>, _corrupt_record STRING"
)
WORKS_SCHEMA = (
    "docs ARRAY<STRUCT<key: STRING, title: STRING, author_name: ARRAY<STRING>, "
    "first_publish_year: INT, publisher: ARRAY<STRING>, isbn: ARRAY<STRING>, "
    "language: ARRAY<STRING>, cover_i: BIGINT>>, _corrupt_record STRING"
)


def _none(type_: str) -> Column:
    return F.lit(None).cast(type_)


def _decoded(responses: DataFrame, schema: str) -> DataFrame:
    """Responses that decode; the others give no rows. A nested field of another type is null."""
    return responses.withColumn("doc", F.from_json("body", schema)).filter(
        F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull()
    )


def _title_similarity(title: Column) -> Column:
    asked = F.col("query_title")
    return F.when(asked.isNull(), F.lit(1.0)).otherwise(similarity(asked, title))


def volumes_candidates(responses: DataFrame) -> DataFrame:
    """Candidates of the volumes feed from (entity_id, query_title, body)."""
    incomplete = F.exists(
        "doc.items",
        lambda i: i["id"].isNull()
        | i["volumeInfo"].isNull()
        | F.coalesce(
            F.exists(
                i["volumeInfo"]["industryIdentifiers"],
                lambda n: n["type"].isNull() | n["identifier"].isNull(),
            ),
            F.lit(False),
        ),
    )
    items = (
        _decoded(responses, VOLUMES_SCHEMA)
        .filter(~F.coalesce(incomplete, F.lit(False)))
        .select("entity_id", "query_title", F.explode("doc.items").alias("item"))
        .select("entity_id", "query_title", "item.id", F.col("item.volumeInfo").alias("info"))
        .filter(F.col("info.title").isNotNull())
    )
    identifiers = F.coalesce(
        F.transform("info.industryIdentifiers", lambda n: n["identifier"]),
        F.array().cast("array<string>"),
    )
    return items.select(
        "entity_id",
        F.concat(F.lit("gb-"), "id").alias("candidate_id"),
        F.lit("google_books").alias("source"),
        "info.title",
        F.coalesce("info.authors", F.array().cast("array<string>")).alias("authors"),
        parse_year(F.col("info.publishedDate")).alias("year"),
        "info.publisher",
        "info.language",
        isbn_assign(identifiers, 10).alias("isbn10"),
        isbn_assign(identifiers, 13).alias("isbn13"),
        "info.description",
        largest_image(F.col("info.imageLinks")).alias("cover_url"),
        _title_similarity(F.col("info.title")).alias("similarity"),
        _none("string").alias("error"),
    )


def works_candidates(responses: DataFrame) -> DataFrame:
    """Candidates of the works feed from (entity_id, query_title, body).

    A record without a key is named by its content.
    """
    docs = (
        _decoded(responses, WORKS_SCHEMA)
        .select("entity_id", "query_title", F.explode("doc.docs").alias("d"))
        .filter(F.col("d.title").isNotNull())
    )
    identifiers = F.slice(
        F.coalesce("d.isbn", F.array().cast("array<string>")), 1, IDENTIFIERS_PER_RECORD
    )
    return docs.select(
        "entity_id",
        F.concat(F.lit("ol-"), F.coalesce("d.key", F.md5(F.to_json("d")))).alias("candidate_id"),
        F.lit("open_library").alias("source"),
        "d.title",
        F.coalesce("d.author_name", F.array().cast("array<string>")).alias("authors"),
        F.col("d.first_publish_year").alias("year"),
        F.get("d.publisher", F.lit(0)).alias("publisher"),
        F.get("d.language", F.lit(0)).alias("language"),
        isbn_assign(identifiers, 10).alias("isbn10"),
        isbn_assign(identifiers, 13).alias("isbn13"),
        _none("string").alias("description"),
        F.when(F.col("d.cover_i").isNotNull(), cover_link(F.col("d.cover_i"))).alias("cover_url"),
        _title_similarity(F.col("d.title")).alias("similarity"),
        _none("string").alias("error"),
    )


def failed_lookups(failures: DataFrame) -> DataFrame:
    """(entity_id, source, error) as candidate rows that carry nothing but the error."""
    strings = ["title", "publisher", "language", "isbn10", "isbn13", "description", "cover_url"]
    return failures.select(
        "entity_id",
        _none("string").alias("candidate_id"),
        "source",
        _none("array<string>").alias("authors"),
        _none("int").alias("year"),
        *[_none("string").alias(c) for c in strings],
        _none("double").alias("similarity"),
        "error",
    )
