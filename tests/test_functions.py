"""Literal cases of the row rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioframe.functions import fields, identifiers, naming
from folioframe.functions import text as X


def test_key(evaluate):
    cases = {
        "Ḑüné!!": "dune",
        "  The GREAT,  Gatsby. ": "the great gatsby",
        "Café — crème": "cafe creme",
        "Ｆｕｌｌ １": "full 1",
        "کتاب خانه": "کتاب خانه",
        "...": "",
    }
    assert evaluate(X.key, cases) == list(cases.values())
    unicode_key = lambda c: X.key(c, X.fold_unicode(c))
    assert evaluate(unicode_key, cases) == list(cases.values())
    assert evaluate(X.key, [None]) == [None]


def test_fold_is_whole(evaluate):
    """Every assigned letter of the basic planes folds as its decomposition says, alone and inside a text."""
    import unicodedata

    codes = [*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]
    chars = [chr(c) for c in codes if unicodedata.category(chr(c)) not in ("Cn", "Zs", "Cc")]
    runs = ["x" + "y".join(chars[i : i + 50]) + "z" for i in range(0, len(chars), 50)]
    got = evaluate(X.fold, runs)
    # Final sigma depends on its place; the plain one is meant here.
    want = ["x" + "y".join(X.fold_text(c) for c in chars[i : i + 50]) + "z" for i in range(0, len(chars), 50)]
    plain = lambda t: t.replace("ς", "σ")
    wrong = [(g, w) for g, w in zip(got, want) if plain(g) != plain(w)]
    assert not wrong, wrong[:1]
    keys = {"ﬁnal oﬃce": "final office", "Ⅻ. ½": "xii 1 2", "한": unicodedata.normalize("NFD", "한"), "": "", "󰀀ﬁ": "fi"}
    assert evaluate(X.key, keys) == list(keys.values())


def test_stem_key(evaluate):
    cases = {
        "dune_v2": "dune",
        "Dune.Final.OCR": "dune",
        "dune (1)": "dune",
        "Moby.Dick.v2": "moby dick",
        "war-and-peace [retail]": "war and peace",
        "final_v2": "",
    }
    assert evaluate(X.stem_key, cases) == list(cases.values())


def test_clean_stem_keeps_bare_hyphens(evaluate):
    cases = {
        "corrupt-book": "corrupt-book",
        "Frank_Herbert – Dune (retail) v2": "Frank Herbert - Dune",
        "Café.Noir": "Café Noir",
    }
    assert evaluate(X.clean_stem_for_display, cases) == list(cases.values())


def test_author_set_key(evaluate):
    authors = [["Frank Herbert", "Kevin Anderson"], ["Kevin Anderson", "FRANK Herbert"], ["Frank Herbert"], ["", "?"]]
    a, b, c, d = evaluate(X.author_set_key, authors, "array<string>")
    assert a == b == "frank herbert|kevin anderson"
    assert c == "frank herbert" and d == ""


def test_similarity(spark):
    pairs = [("Dune", "dune", 1.0), ("Dune", "Emma", 0.0), ("Dune Messiah", "Dune", 0.5), ("", "x", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, want double")
    for row in rows.withColumn("got", X.similarity(F.col("a"), F.col("b"))).collect():
        assert row["got"] == row["want"]


def test_isbn(evaluate):
    cases = {
        "978-0-441-17271-9": "9780441172719",
        "urn:isbn:0441172717": "0441172717",
        "URN:ISBN:0441172717": "0441172717",
        "044117271x": "044117271X",
        "12345": None,
    }
    assert evaluate(identifiers.isbn_normalize, cases) == list(cases.values())
    plausible = {
        "0441172717": True,
        "9780441172719": True,
        "080442957X": True,
        "1111111111": False,
        "0000000000": False,
        "9780441172718": False,
        "04411727X7": False,
        "123": False,
        None: None,
    }
    assert evaluate(identifiers.isbn_is_plausible, plausible) == list(plausible.values())


def test_isbn_assign(evaluate):
    raw = [["bad", "0-441-17271-7", "9780441172719", "9780000000000"]]
    assert evaluate(lambda c: identifiers.isbn_assign(c, 10), raw, "array<string>") == ["0441172717"]
    assert evaluate(lambda c: identifiers.isbn_assign(c, 13), raw, "array<string>") == ["9780441172719"]


def test_looks_like_isbn(evaluate):
    cases = {
        "urn:uuid:12345678-1234-1234-1234-1234567890ab": False,
        "9780441172719": True,
        "isbn whatever": True,
        "978-0-441-17271-9": True,
        "1234": False,
    }
    assert evaluate(identifiers.looks_like_isbn, cases) == list(cases.values())


def test_parse_year(evaluate):
    cases = {
        "2005-06-01": 2005,
        "June 2005": 2005,
        "2005": 2005,
        "01/06/2005": 2005,
        "someday": None,
        None: None,
        "year 12": None,
        "20051 and 1999": 1999,
        "3000 2999": 2999,
    }
    assert evaluate(identifiers.parse_year, cases) == list(cases.values())


def test_filename_guess(evaluate):
    cases = {
        "Herbert - Dune": ("Dune", "Herbert"),
        "The Count of Monte Cristo Volume 2 - Alexandre Dumas": (
            "The Count of Monte Cristo Volume 2",
            "Alexandre Dumas",
        ),
        "book_final2": ("book final2", None),
        "Old Notes - Anonymous": ("Anonymous", "Old Notes"),
        "A - B - C": ("B - C", "A"),
    }
    got = evaluate(identifiers.filename_guess, cases)
    assert [tuple(g) for g in got] == list(cases.values())


def test_cleaning(evaluate):
    assert evaluate(X.clean_title, ["Untitled", "unknown", "  ", "Dune", "No Title!"]) == [
        None, None, None, "Dune", None,
    ]
    authors = [["Unknown", " ", " Frank Herbert ", "unknown author"]]
    assert evaluate(X.clean_authors, authors, "array<string>") == [["Frank Herbert"]]
    assert evaluate(X.split_authors, ["A B; C & D, E,F;"]) == [["A B", "C", "D", "E,F"]]


def test_sort_keys(evaluate):
    assert evaluate(X.title_sort_key, ["The Blind Owl", "A Tale", " an apple", "Then"]) == [
        "blind owl", "tale", "apple", "then",
    ]
    assert evaluate(X.last_first, ["Ursula K. Le Guin", "Homer"]) == ["Guin, Ursula K. Le", "Homer"]
    assert evaluate(X.author_sort_key, [["Frank Herbert"], []], "array<string>") == ["herbert, frank", ""]


def test_paths(evaluate):
    paths = ["/a/b.c/Name.v2.EPUB", "plain", "/a/.hidden", "x.txt"]
    assert evaluate(X.filename, paths) == ["Name.v2.EPUB", "plain", ".hidden", "x.txt"]
    assert evaluate(X.stem, paths) == ["Name.v2", "plain", ".hidden", "x"]
    assert evaluate(X.extension, paths) == ["EPUB", "", "", "txt"]
    assert evaluate(X.directory, paths) == ["/a/b.c", "", "/a", ""]


def test_number_text(evaluate):
    assert evaluate(X.number_text, [1.0, 1.5, None, -2.0], "double") == ["1", "1.5", None, "-2"]


def test_csv_field(evaluate):
    values = ["a,b", 'say "x"', "line\nbreak", "plain; x"]
    assert evaluate(X.csv_field, values) == ['"a,b"', '"say ""x"""', '"line\nbreak"', "plain; x"]
    assert evaluate(lambda c: X.csv_field(c, ";"), ["a,b", "a;b"]) == ["a,b", '"a;b"']


def test_iso_timestamp_is_utc_in_any_session_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = spark.range(1).select(X.iso_timestamp(F.timestamp_seconds(F.lit(0))).alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["t"] == "1970-01-01T00:00:00Z"


def test_metadata_status(spark):
    schema = "title string, authors array<string>, year int, isbn13 string, isbn10 string"
    rows = [
        ("T", [], 2000, None, None),
        ("T", ["A"], None, None, None),
        ("T", ["A"], 2000, None, None),
        ("T", ["A"], None, None, "0441172717"),
        (" ", ["A"], 2000, None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    status = fields.metadata_status(*[F.col(c) for c in ("title", "authors", "year", "isbn13", "isbn10")])
    assert [r["s"] for r in frame.select(status.alias("s")).collect()] == [
        "unresolved", "partial", "complete", "complete", "unresolved",
    ]


def test_largest_image(spark):
    links = F.struct(
        *[
            F.lit(v).cast("string").alias(k)
            for k, v in {
                "extraLarge": None, "large": None, "medium": "http://m", "small": "http://s",
                "thumbnail": None, "smallThumbnail": None,
            }.items()
        ]
    )
    assert spark.range(1).select(fields.largest_image(links).alias("l")).first()["l"] == "https://m"


@pytest.mark.parametrize(
    ("template", "message"),
    [
        ("{bogus}", "Unknown token '{bogus}'"),
        ("{title.{ext}", "Unclosed"),
        ("{series? x", "Unclosed"),
        ("{bogus? {title}}", "Unknown token"),
        ("{ti{title}tle}", "Unknown token"),
    ],
)
def test_template_errors(template, message):
    with pytest.raises(naming.TemplateError, match=message):
        naming.parse_template(template)


def render(spark, template, **given):
    base = {
        "title": None, "authors": None, "year": None, "series": None, "series_index": None,
        "isbn13": None, "isbn10": None, "language": None, "publisher": None, "ext": "EPUB",
    }
    base.update(given)
    schema = (
        "title string, authors array<string>, year int, series string, series_index double, "
        "isbn13 string, isbn10 string, language string, publisher string, ext string"
    )
    frame = spark.createDataFrame([tuple(base.values())], schema)
    text, missing = naming.render(template, naming.token_values(*[F.col(c) for c in base]))
    frame = frame.select(text.alias("t"), missing.alias("m"), "ext")
    row = naming.with_legal_name(frame, F.col("t"), F.col("ext"), "name").first()
    return row["name"], row["m"]


def test_render(spark):
    book = {"title": "Dune", "authors": ["Frank Herbert", "X"]}
    assert render(spark, "{author} - {title}.{ext}", **book) == ("Frank Herbert - Dune.epub", [])
    series = "{title}{series? ({series} #{series_index})}.{ext}"
    assert render(spark, series, **book)[0] == "Dune.epub"
    assert render(spark, series, **book, series="Saga", series_index=1.0)[0] == "Dune (Saga #1).epub"
    assert render(spark, series, **book, series="Saga", series_index=1.5)[0] == "Dune (Saga #1.5).epub"
    assert render(spark, "{author} - {title}.{ext}", title="Dune")[1] == ["author"]
    assert render(spark, series, title="T", series="S") == ("T (S #).epub", ["series_index"])
    assert render(spark, "{author_sort} {authors}.{ext}", **book)[0] == "Herbert, Frank Frank Herbert, X.epub"
    assert render(spark, "{title} } x.{ext}", **book)[0] == "Dune } x.epub"


def legal(spark, *raw):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    named = naming.with_legal_name(frame, F.col("r"), F.lit("PDF"), "n").orderBy("i")
    return [r["n"] for r in named.collect()]


def test_legal_names(spark):
    assert legal(spark, "Dune: Part/Two\u0007.pdf", "...x.pdf", " - .pdf", "a ( ) [] - - b .pdf", "", "Dune - .epub") == [
        "Dune- Part-Two.pdf", "x.pdf", "pdf", "a - b.pdf", "Untitled.pdf", "Dune -.epub",
    ]
    assert legal(spark, "بوف کور.pdf") == ["بوف کور.pdf"]


def test_byte_cap_cuts_on_graphemes(spark):
    long, family, exact = legal(spark, "é" * 300 + ".epub", "👨‍👩‍👧" * 30 + ".pdf", "x" * 251 + ".pdf")
    assert len(long.encode()) <= 255 and long.endswith("é.epub")
    assert len(family.encode()) <= 255 and exact == "x" * 251 + ".pdf"
    frame = spark.createDataFrame([("y" * 251, ".pdf")], "s string, x string")
    name = frame.select(naming.counted(F.col("s"), F.col("x"), F.lit(12)).alias("n")).first()["n"]
    assert name == "y" * 246 + " (12).pdf" and len(name) == 255


def test_a_text_is_folded_once_for_all_that_is_asked_of_it(spark):
    """Each key translates its text in one place; four behind it are for texts with stand-ins of their own."""
    frame = spark.createDataFrame([("\ufb01n \U000f0005 \u2167 \uac01", "fin viii \uac01")], "a string, b string")
    plan = frame.select(X.similarity(F.col("a"), F.col("b")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2 * 5
    row = frame.select(X.key(F.col("a")).alias("k"), X.fold(F.col("a")).alias("f"), X.similarity(F.col("a"), F.col("b")).alias("s")).first()
    letters = "\u1100\u1161\u11a8"
    assert (row["k"], row["f"], row["s"]) == (f"fin viii {letters}", f"fin \U000f0005 viii {letters}", 1.0)
