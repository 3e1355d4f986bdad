"""Table schemas (as DDL strings), enumerations and default parameters."""

from __future__ import annotations

# Fixed values.
FORMATS = ["epub", "pdf", "mobi", "azw3", "djvu", "cbz", "cbr", "fb2", "txt"]
EMBEDDED_FORMATS = ["epub", "pdf", "mobi", "azw3"]
STATUSES = ["unresolved", "partial", "complete"]
METHODS = ["isbn", "metadata", "filename", "manual", "single"]
SOURCES = ["embedded", "google_books", "open_library", "manual", "filename"]
DEFAULT_TEMPLATE = "{author} - {title}.{ext}"
DEFAULT_PROVIDER_ORDER = ["google_books", "open_library"]
CONFIDENCE_THRESHOLD = 0.6
CONFIDENCE_MARGIN = 0.3
CANDIDATES_PER_SOURCE = 10
IDENTIFIERS_PER_RECORD = 20
NAME_BYTES = 255

LISTING = (
    "path STRING, format STRING, size_bytes BIGINT, modified_at TIMESTAMP"
)
IDENTITY = (
    "path STRING, format STRING, stem STRING, isbn STRING, title_key STRING, author_key STRING, "
    "manual_group_id STRING"
)
METADATA = (
    "path STRING, title STRING, authors ARRAY<STRING>, series STRING, series_index DOUBLE, "
    "publisher STRING, year INT, language STRING, isbn10 STRING, isbn13 STRING, "
    "description STRING, parse_error_note STRING"
)
TAGGED_METADATA = ("path STRING, ord INT, tag STRING, value STRING")
ENTITY = (
    "id BIGINT, title STRING, title_sort STRING, authors ARRAY<STRING>, author_sort STRING, "
    "series STRING, series_index DOUBLE, publisher STRING, year INT, language STRING, "
    "isbn10 STRING, isbn13 STRING, description STRING, cover_path STRING, "
    "metadata_status STRING, group_method STRING, parse_error_note STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
MEMBER = (
    "id BIGINT, book_id BIGINT, path STRING, format STRING, size_bytes BIGINT, "
    "modified_at TIMESTAMP, missing BOOLEAN, manual_group_id STRING, embedded_isbn STRING, "
    "embedded_title_key STRING, embedded_author_key STRING"
)
PROVENANCE = (
    "book_id BIGINT, field STRING, source STRING, fetched_at TIMESTAMP"
)
RENAME_JOURNAL = (
    "id BIGINT, batch_id STRING, file_id BIGINT, old_path STRING, new_path STRING, "
    "executed_at TIMESTAMP, reverted BOOLEAN"
)
OVERRIDE = ("path STRING, manual_group_id STRING")
CANDIDATE = (
    "entity_id BIGINT, candidate_id STRING, source STRING, title STRING, authors ARRAY<STRING>, "
    "year INT, publisher STRING, language STRING, isbn10 STRING, isbn13 STRING, "
    "description STRING, cover_url STRING, similarity DOUBLE, error STRING"
)
CHANGE_EVENT = ("root STRING, ts TIMESTAMP, path STRING")

# Scalar metadata fields that may be filled from files or candidates, in provenance order.
FILL_FIELDS = [
    "series",
    "series_index",
    "publisher",
    "year",
    "language",
    "isbn10",
    "isbn13",
    "description",
]
EDIT_FIELDS = ["title", "authors", *FILL_FIELDS]
# Order in which a chosen candidate is applied.
CANDIDATE_FIELDS = [
    "publisher",
    "year",
    "language",
    "isbn10",
    "isbn13",
    "description",
    "series",
    "series_index",
]
