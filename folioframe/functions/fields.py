"""Rules over the metadata fields of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.text import trim_space


def has_items(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def metadata_status(
    title: Column, authors: Column, year: Column, isbn13: Column, isbn10: Column
) -> Column:
    """complete: title, author and (year or isbn); partial: title and author; else unresolved."""
    named = F.coalesce(trim_space(title) != "", F.lit(False)) & has_items(authors)
    extra = year.isNotNull() | isbn13.isNotNull() | isbn10.isNotNull()
    return (
        F.when(named & extra, F.lit("complete"))
        .when(named, F.lit("partial"))
        .otherwise(F.lit("unresolved"))
    )


def completeness(
    authors: Column,
    year: Column,
    isbn13: Column,
    isbn10: Column,
    cover_path: Column,
    description: Column,
) -> Column:
    """How much is known about an entity: authors and isbn count 2, the others 1."""
    parts = [
        (has_items(authors), 2),
        (year.isNotNull(), 1),
        (isbn13.isNotNull() | isbn10.isNotNull(), 2),
        (cover_path.isNotNull(), 1),
        (description.isNotNull(), 1),
    ]
    score = F.lit(0)
    for known, weight in parts:
        score = score + F.when(known, weight).otherwise(0)
    return score


def populated_fields(fields: dict[str, Column], arrays: tuple[str, ...] = ("authors",)) -> Column:
    """Names of the fields that hold a value, in the order given."""
    return F.array_compact(
        F.array(
            *[
                F.when(has_items(value) if name in arrays else value.isNotNull(), F.lit(name))
                for name, value in fields.items()
            ]
        )
    )


def largest_image(links: Column) -> Column:
    """Largest available image link, always over https."""
    # Link names from largest to smallest.
    sizes = ["extraLarge", "large", "medium", "small", "thumbnail", "smallThumbnail"]
    best = F.coalesce(*[links.getField(size) for size in sizes])
    return F.replace(best, F.lit("http://"), F.lit("https://"))


def cover_link(cover_id: Column) -> Column:
    """Cover address of a numeric cover id."""
    # Fixed value: address format.
    return F.format_string("https://covers.openlibrary.org/b/id/%d-L.jpg", cover_id)


def review_chips(
    status: Column, method: Column, any_missing: Column, note: Column
) -> Column:
    """Reasons why an entity should be looked at."""
    return F.array_compact(
        F.array(
            F.when(status == "unresolved", F.lit("unresolved")),
            F.when(method == "filename", F.lit("auto_grouped")),
            F.when(any_missing, F.lit("missing")),
            F.when(note.isNotNull(), F.lit("parse_note")),
        )
    )
