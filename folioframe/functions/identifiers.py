"""ISBN, year, filename-guess and lookup-query rules."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.text import clean_stem_for_display, trim_space


@lru_cache(maxsize=1)
def _digit_table() -> tuple[str, str]:
    """Every decimal digit of the basic plane outside ASCII, with its ASCII digit."""
    digits = [c for c in map(chr, range(0x80, 0xD800)) if unicodedata.decimal(c, None) is not None]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


def ascii_digits(text: Column) -> Column:
    source, target = _digit_table()
    return F.translate(text, source, target)


def isbn_normalize(raw: Column) -> Column:
    """Digits and X of an identifier, when there are 10 or 13 of them; else null."""
    bare = F.regexp_replace(raw, r"(?i)urn:isbn:", "")
    bare = F.upper(F.regexp_replace(bare, r"[^\p{N}Xx]", ""))
    return F.when(F.length(bare).isin(10, 13), bare)


def isbn_is_plausible(isbn: Column) -> Column:
    """Valid check digit and not one repeated character. Null in, null out."""
    text = ascii_digits(isbn)

    def digit(i: int) -> Column:
        return F.ascii(F.substring(text, i + 1, 1)) - 48

    def total(terms: list[Column]) -> Column:
        out = terms[0]
        for term in terms[1:]:
            out = out + term
        return out

    sum13 = total([digit(i) * (1 if i % 2 == 0 else 3) for i in range(13)])
    last10 = F.when(F.substring(text, 10, 1) == "X", F.lit(10)).otherwise(digit(9))
    sum10 = total([digit(i) * (10 - i) for i in range(9)] + [last10])
    return (
        F.when(text.rlike(r"^(.)\1*$"), False)
        .when(text.rlike(r"^[0-9]{13}$"), sum13 % 10 == 0)
        .when(text.rlike(r"^[0-9]{9}[0-9X]$"), sum10 % 11 == 0)
        .when(text.isNotNull(), False)
    )


def isbn_assign(identifiers: Column, digits: int) -> Column:
    """First normalized identifier of the given length in an array of raw identifiers."""
    fitting = F.filter(
        F.transform(identifiers, isbn_normalize), lambda i: F.coalesce(F.length(i) == digits, F.lit(False))
    )
    return F.get(fitting, F.lit(0))


def looks_like_isbn(text: Column, scheme: Column | None = None) -> Column:
    """Whether a document identifier is an ISBN, keeping UUIDs out."""
    lowered = F.lower(text)
    uuid = lowered.contains("uuid") | (text.contains("-") & (F.length(text) > 20))
    count = F.length(F.regexp_replace(text, r"[^\p{N}Xx]", ""))
    named = lowered.contains("isbn")
    if scheme is not None:
        named = named | F.coalesce(F.lower(scheme) == "isbn", F.lit(False))
    return named | (isbn_normalize(text).isNotNull() & ~uuid & count.isin(10, 13))


def parse_year(text: Column) -> Column:
    """First run of exactly four digits between 1000 and 2999."""
    found = F.regexp_extract(text, r"(?<!\p{N})([12][0-9]{3})(?!\p{N})", 1)
    return F.when(found != "", found).cast("int")


def filename_guess(stem: Column) -> Column:
    """Struct (title, author) guessed from a stem of the form ``A - B``."""
    cleaned = clean_stem_for_display(stem)
    at = F.locate(" - ", cleaned)
    first = trim_space(F.substring(cleaned, F.lit(1), at - 1))
    rest = trim_space(F.substring(cleaned, at + 3, F.length(cleaned)))
    short = F.size(F.filter(F.split(first, " "), lambda w: w != "")) <= 4
    is_author = short & ~first.rlike(r"\p{Nd}")
    return F.struct(
        F.when(at == 0, cleaned).when(is_author, rest).otherwise(first).alias("title"),
        F.when(at == 0, F.lit(None)).when(is_author, first).otherwise(rest).alias("author"),
    )


def lookup_query(isbn13: Column, isbn10: Column, title: Column, authors: Column) -> Column:
    """Struct (isbn, title, author, is_empty) used to look an entity up."""
    isbn = F.coalesce(isbn13, isbn10)
    return F.struct(
        isbn.alias("isbn"),
        title.alias("title"),
        F.get(authors, F.lit(0)).alias("author"),
        (isbn.isNull() & (F.coalesce(title, F.lit("")) == "")).alias("is_empty"),
    )
