"""File names from a template: token values, rendering, sanitizing and the byte cap."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import SPACE, last_first, number_text, stem, trim_space
from folioframe.schemas import NAME_BYTES

# The tokens a template may use.
TOKENS = [
    "title", "author", "authors", "author_sort", "year", "series", "series_index", "isbn",
    "language", "publisher", "ext",
]


class TemplateError(ValueError):
    """A template that cannot be rendered; raised before any job runs."""


@dataclass
class Part:
    """Literal text, a token, or (when ``inner`` is a list) a conditional segment."""

    text: str
    is_token: bool = False
    inner: list[Part] | None = None


@dataclass
class _Open:
    head: str = ""
    inner: list[Part] | None = None
    parts: list[Part] = field(default_factory=list)


def parse_template(template: str) -> list[Part]:
    """Parts of a template; ``{token}`` and ``{token? text with {tokens}}`` are recognized."""
    top: list[Part] = []
    stack: list[_Open] = []

    def emit(part: Part) -> None:
        target = stack[-1].inner if stack else top
        target.append(part)

    def checked(name: str) -> str:
        if name.strip() not in TOKENS:
            raise TemplateError(f"Unknown token '{{{name.strip()}}}'")
        return name.strip()

    if template.count("{") > template.count("}"):
        raise TemplateError("Unclosed '{' in template")
    for piece in re.findall(r"[{}]|[^{}]+", template):
        if piece == "{":
            if stack and stack[-1].inner is None:
                raise TemplateError(f"Unknown token '{{{stack[-1].head}{{'")
            stack.append(_Open())
        elif piece == "}" and stack:
            done = stack.pop()
            if done.inner is None:
                emit(Part(checked(done.head), is_token=True))
            else:
                emit(Part(done.head, inner=done.inner))
        elif stack and stack[-1].inner is None:
            head, question, rest = piece.partition("?")
            stack[-1].head = head
            if question:
                stack[-1].head = checked(head)
                stack[-1].inner = [Part(rest)] if rest else []
        else:
            emit(Part(piece))
    if stack:
        raise TemplateError("Unclosed '{' in template")
    return top


def token_values(
    title: Column,
    authors: Column,
    year: Column,
    series: Column,
    series_index: Column,
    isbn13: Column,
    isbn10: Column,
    language: Column,
    publisher: Column,
    ext: Column,
) -> dict[str, Column]:
    """Text of every token; null when it has no value."""
    first = F.get(authors, F.lit(0))
    values = {
        "title": title,
        "author": first,
        "authors": F.array_join(authors, ", "),
        "author_sort": last_first(first),
        "year": year.cast("string"),
        "series": series,
        "series_index": number_text(series_index),
        "isbn": F.coalesce(isbn13, isbn10),
        "language": language,
        "publisher": publisher,
        "ext": F.lower(ext),
    }
    return {name: F.when(trim_space(value) != "", value) for name, value in values.items()}


def render(template: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """(text, missing) of a template: ``missing`` lists required tokens without a value."""

    def text_of(parts: list[Part]) -> Column:
        columns = []
        for part in parts:
            if part.inner is not None:
                columns.append(
                    F.when(values[part.text].isNotNull(), text_of(part.inner)).otherwise("")
                )
            elif part.is_token:
                columns.append(F.coalesce(values[part.text], F.lit("")))
            else:
                columns.append(F.lit(part.text))
        return F.concat(*columns) if columns else F.lit("")

    def missing_of(parts: list[Part], active: Column) -> list[Column]:
        columns = []
        for part in parts:
            if part.inner is not None:
                columns += missing_of(part.inner, active & values[part.text].isNotNull())
            elif part.is_token:
                columns.append(F.when(active & values[part.text].isNull(), F.lit(part.text)))
        return columns

    parts = parse_template(template)
    missing = missing_of(parts, F.lit(True))
    return text_of(parts), (
        F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
    )


def tidy_name(raw: Column) -> Column:
    """Separators tidied and control characters dropped; may be empty or too long."""
    name = F.translate(raw, "/:", "--")
    name = F.regexp_replace(name, r"[\p{Cc}\p{Cf}]", "")
    name = F.regexp_replace(name, SPACE + "{2,}", " ")
    name = F.regexp_replace(name, rf"\({SPACE}*\)", "")
    name = F.regexp_replace(name, rf"\[{SPACE}*\]", "")
    name = F.regexp_replace(name, "-( -)+", "-")
    name = F.regexp_replace(name, SPACE + r"+\.", ".")
    name = F.regexp_replace(name, SPACE + "{2,}", " ")
    name = F.regexp_replace(name, "^[ _-]+|[ _-]+$", "")
    return F.regexp_replace(name, r"^\.+", "")


def with_legal_name(df: DataFrame, raw: Column, ext: Column, out: str) -> DataFrame:
    """Add ``out``: a legal file name of at most 255 bytes, never empty.

    Every step is a column of its own, so that no step's text is computed more than once.
    """
    untitled = F.concat(F.lit("Untitled."), F.lower(ext))
    return (
        df.withColumn("_tidy", tidy_name(raw))
        .withColumn("_full", F.when(F.col("_tidy") == "", untitled).otherwise(F.col("_tidy")))
        .withColumns({"_stem": stem(F.col("_full")), "_suffix": suffix(F.col("_full"))})
        .withColumn("_budget", F.lit(NAME_BYTES) - F.octet_length("_suffix"))
        .withColumn(
            out,
            F.when(
                F.octet_length("_full") > NAME_BYTES,
                F.concat(trim_to_bytes(F.col("_stem"), F.col("_budget")), F.col("_suffix")),
            ).otherwise(F.col("_full")),
        )
        .drop("_tidy", "_full", "_stem", "_suffix", "_budget")
    )


def suffix(name: Column) -> Column:
    """Extension with its dot; empty when the name has none."""
    return F.regexp_extract(name, r"^[^/]+(\.[^./\s]+)$", 1)


def trim_to_bytes(text: Column, budget: Column) -> Column:
    """Longest run of whole graphemes within ``budget`` (at most 255) UTF-8 bytes, then trimmed.

    A grapheme that reaches past the first 256 characters cannot fit, so the rest is not split.
    """
    head = F.substring(text, 1, NAME_BYTES + 1)
    graphemes = F.regexp_extract_all(head, F.lit(r"(\X)"), F.lit(1))
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def step(state: Column, grapheme: Column) -> Column:
        longer = F.concat(state["kept"], grapheme)
        fits = ~state["full"] & (F.octet_length(longer) <= budget)
        return F.struct(
            F.when(fits, longer).otherwise(state["kept"]).alias("kept"), (~fits).alias("full")
        )

    cut = F.aggregate(graphemes, start, step, lambda state: trim_space(state["kept"]))
    return F.when(F.octet_length(text) > budget, cut).otherwise(text)


def counted(stem: Column, suffix: Column, counter: Column) -> Column:
    """A name with `` (n)`` before its suffix; the cap shortens the stem, never the counter."""
    marker = F.concat(F.lit(" ("), counter.cast("string"), F.lit(")"))
    budget = F.lit(NAME_BYTES) - F.octet_length(suffix) - F.octet_length(marker)
    return F.concat(trim_to_bytes(stem, budget), marker, suffix)
