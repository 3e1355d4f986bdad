"""Text normalization as native Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored in file stems. "e-book" can never match because dashes are removed
# before words are compared; it is listed for completeness.
NOISE_WORDS = [
    "v1", "v2", "v3", "v4", "v5", "final", "draft", "ocr", "scan", "scanned", "retail", "ebook",
    "e-book", "edition", "ed", "revised", "copy", "new", "full", "complete", "unabridged", "www",
    "com", "org",
]
# Embedded titles and authors that carry no information.
JUNK_TITLES = ["untitled", "unknown", "no title", "title", "document", "book"]
JUNK_AUTHORS = ["unknown", "unknown author"]
# Fixed patterns.
BRACKETED = r"[\(\[\{][^\)\]\}]*[\)\]\}]"
SPACE = r"[\s\p{Z}]"
NOT_ALPHANUMERIC = r"[^\p{L}\p{M}\p{N}]+"


# Hangul syllables are numbered by leading consonant, vowel and final consonant (none first).
_HANGUL, _LEADS, _VOWELS, _TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
_N_VOWELS, _N_TAILS, _N_SYLLABLES = 21, 28, 11172
# Stand-ins for letters that become several; which letter one stands for is its place in the table.
_STAND_IN = 0xF0000


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, str, str]:
    """Character maps for folding, derived from the Unicode database of the running Python.

    A lower-case character maps to its compatibility decomposition without combining marks. The
    first two texts map characters to one character (combining marks at the end of the first are
    deleted), the third holds the characters that become several and the fourth, separated by
    U+2028, what they become. Hangul syllables follow from their number and are not listed;
    white space of its own kind stays.
    """
    source, target, dropped, many, parts = [], [], [], [], []
    for start, stop in [(0x80, _HANGUL), (_HANGUL + _N_SYLLABLES, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20)]:
        for code in range(start, stop):
            char = chr(code)
            if unicodedata.category(char) in ("Cn", "Zs") or char.lower() != char:
                continue
            if unicodedata.combining(char):
                dropped.append(char)
                continue
            base = fold_text(char)
            if base == char:
                continue
            if len(base) == 1:
                source.append(char)
                target.append(base)
            else:
                many.append(char)
                parts.append(base)
    return "".join(source + dropped), "".join(target), "".join(many), "\u2028".join(parts)


def fold_text(text: str) -> str:
    """Lower case, compatibility decomposition, combining marks removed."""
    decomposed = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c)).lower()


def fold(text: Column) -> Column:
    """Fold case, diacritics, width and compatibility forms inside the JVM.

    ASCII text only needs its case folded; a text is taken apart only if it has letters that become
    several (ligatures, Roman numerals, fractions, Hangul syllables), and there at these letters.
    """
    return once(text, lambda t: F.when(_is_ascii(t), F.lower(t)).otherwise(_fold_any(t)))


# The fold is whole for every letter.
fold_unicode = fold


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@lru_cache(maxsize=1)
def _marking() -> tuple[str, str, str]:
    """A map that folds single letters and puts stand-ins for those that become several, and the class of stand-ins."""
    source, target, many, _ = fold_table()
    mapped, dropped = source[: len(target)], source[len(target) :]
    stand_ins = "".join(chr(_STAND_IN + i) for i in range(len(many)))
    return mapped + many + dropped, target + stand_ins, f"{stand_ins[0]}-{stand_ins[-1]}"


def _fold_any(text: Column) -> Column:
    source, target, stand_ins = _marking()
    syllables = f"{chr(_HANGUL)}-{chr(_HANGUL + _N_SYLLABLES - 1)}"
    runs = f"[^{stand_ins}{syllables}]+|[{stand_ins}{syllables}]"

    def apart(marked: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(marked, F.lit(runs), F.lit(0)), _letters)
        return F.when(marked.rlike(f"[{stand_ins}{syllables}]"), F.array_join(pieces, "")).otherwise(marked)

    # A text that has stand-ins of its own keeps them and is taken apart by characters.
    return once(
        F.lower(text),
        lambda t: F.when(t.rlike(f"[{stand_ins}]"), _fold_letters(t)).otherwise(
            once(F.translate(t, source, target), apart)
        ),
    )


def _fold_letters(lower: Column) -> Column:
    source, target, many, _ = fold_table()
    stand_ins = _marking()[1][len(target) :]

    def letter(char: Column) -> Column:
        stand_in = F.translate(char, many, stand_ins)
        return F.when((stand_in != char) | ~char.rlike(f"[{_marking()[2]}]"), _letters(stand_in)).otherwise(char)

    return F.array_join(F.transform(F.split(F.translate(lower, source, target), ""), letter), "")


def _letters(run: Column) -> Column:
    """The letters that a stand-in or a Hangul syllable becomes; any other run stays."""
    parts = fold_table()[3]
    pick = lambda first, count, at: F.substr(
        F.lit("".join(chr(first + i) for i in range(count))), (at + 1).cast("int"), F.lit(1)
    )

    def several(code: Column) -> Column:
        number = code - _HANGUL
        tail = number % _N_TAILS
        syllable = F.concat(
            pick(_LEADS, 19, F.floor(number / (_N_VOWELS * _N_TAILS))),
            pick(_VOWELS, _N_VOWELS, F.floor(number / _N_TAILS) % _N_VOWELS),
            F.when(tail > 0, pick(_TAILS, _N_TAILS, tail)).otherwise(""),
        )
        listed = F.get(F.split(F.lit(parts), "\u2028"), code - _STAND_IN)
        return F.when(number.between(0, _N_SYLLABLES - 1), syllable).when(
            code.between(_STAND_IN, _STAND_IN + parts.count("\u2028")), listed
        ).otherwise(run)

    return once(F.ascii(run), several)


def key(text: Column, folded: Column | None = None) -> Column:
    """Matching key: folded letters, marks and digits, words separated by one space."""
    if folded is not None:
        return F.trim(F.regexp_replace(folded, NOT_ALPHANUMERIC, " "))
    return once(
        text,
        lambda t: F.trim(
            F.when(_is_ascii(t), F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")).otherwise(
                F.regexp_replace(_fold_any(t), NOT_ALPHANUMERIC, " ")
            )
        ),
    )


def stem_key(stem: Column) -> Column:
    """Matching key of a file stem: bracketed chunks and noise words removed."""
    words = F.split(key(F.regexp_replace(stem, BRACKETED, " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(NOISE_WORDS)), " ")


def clean_stem_for_display(stem: Column) -> Column:
    """Readable stem: separators become spaces, noise words removed, case kept."""
    text = F.regexp_replace(stem, BRACKETED, " ")
    text = F.regexp_replace(text, r"[._]+", " ")
    text = F.regexp_replace(text, SPACE + r"+[-–—]" + SPACE + "+", " - ")
    text = F.regexp_replace(text, SPACE + "{2,}", " ")
    words = F.filter(
        F.split(text, " "), lambda w: (w != "") & ~F.coalesce(key(w).isin(NOISE_WORDS), F.lit(False))
    )
    return trim_space(F.array_join(words, " "))


def author_set_key(authors: Column) -> Column:
    """Order-independent key of a list of authors; repeated names are kept."""
    keys = F.filter(F.transform(authors, lambda a: key(a)), lambda k: k != "")
    return F.array_join(F.array_sort(keys), "|")


def tokens(text: Column) -> Column:
    """Distinct words of the matching key (empty array for an empty key)."""
    return F.array_distinct(F.array_remove(F.split(key(text), " "), ""))


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two word sets; 0 when either is empty."""
    def shares(pair: Column) -> Column:
        a, b = F.size(pair["a"]), F.size(pair["b"])
        shared = F.size(F.array_intersect(pair["a"], pair["b"]))
        return F.when((a > 0) & (b > 0), once(shared, lambda n: n / (a + b - n))).otherwise(F.lit(0.0))

    return once(F.struct(left.alias("a"), right.alias("b")), shares)


def similarity(left: Column, right: Column) -> Column:
    """Word overlap of two texts in [0, 1]."""
    return token_similarity(tokens(left), tokens(right))


def title_sort_key(title: Column) -> Column:
    """Lower-cased title without one leading English article."""
    return F.regexp_replace(F.lower(trim_space(title)), r"^(the |a |an )", "")


def last_first(name: Column) -> Column:
    """``Frank Herbert`` -> ``Herbert, Frank``; single words pass through."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    rest = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(F.size(words) > 1, F.concat(F.element_at(words, -1), F.lit(", "), rest)).otherwise(
        name
    )


def author_sort_key(authors: Column) -> Column:
    return F.coalesce(F.lower(last_first(F.get(authors, F.lit(0)))), F.lit(""))


def clean_title(title: Column) -> Column:
    """Null for titles that carry no information."""
    title_key = key(title)
    return F.when(title_key.isin("", *JUNK_TITLES), F.lit(None)).otherwise(title)


def clean_authors(authors: Column) -> Column:
    """Trimmed authors without placeholder names."""
    trimmed = F.transform(authors, trim_space)
    return F.filter(trimmed, lambda a: ~key(a).isin("", *JUNK_AUTHORS))


def split_authors(text: Column) -> Column:
    """Split one author string on ``;``, ``&`` and ``, ``."""
    parts = F.transform(F.split(text, r"[;&]|, "), trim_space)
    return F.filter(parts, lambda p: p != "")


def trim_space(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Extension without the dot; empty when the name has none. A leading dot is no extension."""
    return F.regexp_extract(filename(path), r"^.+\.([^.\s]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"^(.+)\.[^.\s]+$", "$1")


def number_text(number: Column) -> Column:
    """Whole doubles without decimals."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(
        number.cast("string")
    )


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 text in UTC, independent of the session time zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def csv_field(text: Column, delimiter: str = ",") -> Column:
    """RFC 4180 quoting of one field, only when it is needed."""
    needs = text.contains(delimiter) | text.rlike('["\\n\\r]')
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs, quoted).otherwise(text)
