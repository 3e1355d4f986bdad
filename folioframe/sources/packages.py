"""Package documents: archive bytes -> document text -> metadata rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.fields import has_items
from folioframe.functions.identifiers import isbn_assign, looks_like_isbn, parse_year
from folioframe.functions.text import clean_authors, clean_title, trim_space
from folioframe.schemas import EMBEDDED_FORMATS, FILL_FIELDS

# Where a package names its document.
CONTAINER = "META-INF/container.xml"
_TEXT = "ARRAY<STRUCT<_VALUE: STRING>>"
PACKAGE_SCHEMA = (
    "metadata STRUCT<"
    f"`dc:title`: {_TEXT}, `dc:creator`: {_TEXT}, `dc:language`: {_TEXT}, "
    f"`dc:publisher`: {_TEXT}, `dc:date`: {_TEXT}, `dc:description`: {_TEXT}, "
    "`dc:identifier`: ARRAY<STRUCT<_VALUE: STRING, `_opf:scheme`: STRING, _scheme: STRING>>, "
    "meta: ARRAY<STRUCT<_VALUE: STRING, _name: STRING, _content: STRING>>>"
)


# The notes below say why an archive could not be read.
def package_text(content: bytes) -> tuple[str | None, str | None]:
    """(document text, note) of one archive; a bad archive gives a note instead of text."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return None, "EPUB parse failed: Not a valid EPUB (zip) archive"
    missing = f"EPUB parse failed: {CONTAINER} not found"
    try:
        root = ElementTree.fromstring(archive.read(CONTAINER))
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile):
        return None, missing
    files = [e.get("full-path") for e in root.iter() if e.tag.split("}")[-1] == "rootfile"]
    target = next((f for f in files if f), None)
    if target is None:
        return None, missing
    try:
        return archive.read(target).decode("utf-8", "replace"), None
    except (KeyError, zipfile.BadZipFile):
        return None, f"EPUB parse failed: OPF package document not found: {target}"


def package_documents(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, opf, parse_error_note), one row per archive.

    Large archives travel in small Arrow batches; nothing is grouped or shuffled.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [package_text(bytes(content)) for content in batch["content"]]
            yield pd.DataFrame(
                {
                    "path": batch["path"],
                    "opf": [text for text, _ in rows],
                    "parse_error_note": [note for _, note in rows],
                }
            )

    return files.select("path", "content").mapInPandas(
        unpack, "path STRING, opf STRING, parse_error_note STRING"
    )


def _texts(name: str) -> Column:
    values = F.transform(F.col(f"doc.metadata.`{name}`"), lambda e: trim_space(e["_VALUE"]))
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def _first(name: str) -> Column:
    return F.get(_texts(name), F.lit(0))


def _meta(name: str) -> Column:
    named = F.filter("doc.metadata.meta", lambda m: m["_name"] == name)
    return F.element_at(F.transform(named, lambda m: F.coalesce(m["_content"], F.lit(""))), -1)


def package_metadata(documents: DataFrame) -> DataFrame:
    """(path, opf, parse_error_note) -> metadata rows.

    The first title, language, publisher, year and description count, creators keep their order,
    the last series entry counts. Identifiers count when they look like an ISBN.
    """
    # Namespace declarations are irrelevant: names are matched with their prefix.
    parsed = documents.withColumn(
        "doc", F.from_xml("opf", PACKAGE_SCHEMA, {"attributePrefix": "_", "valueTag": "_VALUE"})
    )
    identifiers = F.transform(
        F.filter(
            F.coalesce(
                F.col("doc.metadata.`dc:identifier`"),
                F.array().cast("array<struct<_VALUE:string,`_opf:scheme`:string,_scheme:string>>"),
            ),
            lambda i: looks_like_isbn(
                F.coalesce(trim_space(i["_VALUE"]), F.lit("")),
                F.coalesce(i["_opf:scheme"], i["_scheme"]),
            ),
        ),
        lambda i: i["_VALUE"],
    )
    years = F.filter(F.transform(_texts("dc:date"), parse_year), lambda y: y.isNotNull())
    return parsed.select(
        "path",
        _first("dc:title").alias("title"),
        _texts("dc:creator").alias("authors"),
        _meta("calibre:series").alias("series"),
        _meta("calibre:series_index").try_cast("double").alias("series_index"),
        _first("dc:publisher").alias("publisher"),
        F.get(years, F.lit(0)).alias("year"),
        _first("dc:language").alias("language"),
        isbn_assign(identifiers, 10).alias("isbn10"),
        isbn_assign(identifiers, 13).alias("isbn13"),
        _first("dc:description").alias("description"),
        "parse_error_note",
    )


def cleaned(metadata: DataFrame) -> DataFrame:
    """Metadata without titles and authors that say nothing."""
    return metadata.withColumns(
        {
            "title": clean_title(F.col("title")),
            "authors": clean_authors(
                F.when(has_items(F.col("authors")), F.col("authors")).otherwise(
                    F.array().cast("array<string>")
                )
            ),
        }
    )


def extract_metadata(files: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """Metadata rows of (path, format, content), routed by format.

    Archives are unpacked here. Formats whose container another tool decodes contribute their
    tags through ``tagged`` (path, ord, tag, value). Other formats give empty rows; a file that
    cannot be read gives a note.
    """
    from folioframe.sources.tagged import fold_tags

    archives = files.filter(F.col("format") == "epub")
    rows = package_metadata(package_documents(archives))
    others = files.filter(F.col("format") != "epub").select("path", "format")
    if tagged is None:
        folded = rows.limit(0).drop("parse_error_note")
    else:
        known = F.col("format").isin([f for f in EMBEDDED_FORMATS if f != "epub"])
        folded = fold_tags(tagged.join(others.filter(known).select("path"), "path", "left_semi"))
    columns = ["path", "title", "authors", *FILL_FIELDS]
    rest = (
        others.select("path")
        .join(folded.select(*columns), "path", "left")
        .withColumn("parse_error_note", F.lit(None).cast("string"))
    )
    return cleaned(rows.select(*columns, "parse_error_note").unionByName(rest))
