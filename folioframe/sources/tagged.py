"""Tagged records (path, ord, tag, value): one metadata row per file, with a rule per tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.identifiers import isbn_normalize, looks_like_isbn, parse_year
from folioframe.functions.text import split_authors, trim_space

# Numbered record types of the binary container and the tags they stand for.
NUMBERED_TAGS = {
    "100": "creator",
    "101": "publisher",
    "103": "description",
    "104": "isbn",
    "106": "date",
    "503": "updated_title",
    "524": "language",
}


def named_tags(tagged: DataFrame) -> DataFrame:
    """Numbered tags by name; other tags are kept."""
    names = F.create_map(*[F.lit(x) for pair in NUMBERED_TAGS.items() for x in pair])
    return tagged.withColumn("tag", F.coalesce(names[F.col("tag")], F.col("tag")))


def fold_tags(tagged: DataFrame) -> DataFrame:
    """Metadata rows: first title, language, publisher, year and description; creators in order;
    last updated title and series; identifiers that are ISBNs.

    Everything but the creators combines on the map side. A file names a handful of creators, and
    they are collected per file, so no list grows with the table.
    """
    value = trim_space(F.col("value"))
    rows = named_tags(tagged).withColumn("value", value).filter(F.col("value") != "")
    tag = F.col("tag")
    rows = rows.withColumns(
        {
            "year": F.when(tag == "date", parse_year(F.col("value"))),
            "isbn": F.when(
                (tag == "isbn") | ((tag == "identifier") & looks_like_isbn(F.col("value"))),
                isbn_normalize(F.col("value")),
            ),
        }
    )

    def first(column: str, condition: Column) -> Column:
        return F.min_by(column, F.when(condition, F.col("ord")))

    def last(column: str, condition: Column) -> Column:
        return F.max_by(column, F.when(condition, F.col("ord")))

    creators = F.collect_list(F.when(tag == "creator", F.struct("ord", "value")))
    names = F.transform(F.array_sort(creators), lambda c: c["value"])
    # A single joined author string (info dictionaries) is split instead.
    joined = F.min_by("value", F.when(tag == "author", F.col("ord")))
    return rows.groupBy("path").agg(
        F.coalesce(last("value", tag == "updated_title"), first("value", tag == "title")).alias("title"),
        F.concat(names, F.coalesce(split_authors(joined), F.array().cast("array<string>"))).alias("authors"),
        last("value", tag == "series").alias("series"),
        last("value", tag == "series_index").try_cast("double").alias("series_index"),
        first("value", tag == "publisher").alias("publisher"),
        first("year", F.col("year").isNotNull()).alias("year"),
        first("value", tag == "language").alias("language"),
        first("isbn", F.length("isbn") == 10).alias("isbn10"),
        first("isbn", F.length("isbn") == 13).alias("isbn13"),
        first("value", tag == "description").alias("description"),
    )
