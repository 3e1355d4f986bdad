"""Listings, package documents, feeds, exports and snapshots on files."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators import snapshot
from folioframe.sources import export, listing, packages, providers, store, tagged

OPF = """<?xml version="1.0"?>
<package xmlns="http://www.idpf.org/2007/opf" version="2.0">
 <metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
  <dc:title>Dune &amp; Sons</dc:title><dc:title>Other</dc:title>
  <dc:creator opf:role="aut"> Frank Herbert </dc:creator><dc:creator>Unknown</dc:creator>
  <dc:language>en</dc:language><dc:publisher>Ace</dc:publisher>
  <dc:date opf:event="x">someday</dc:date><dc:date>1965-08-01</dc:date>
  <dc:identifier opf:scheme="uuid">urn:uuid:12345678-1234-1234-1234-123456789012</dc:identifier>
  <dc:identifier opf:scheme="ISBN">978-0-441-17271-9</dc:identifier>
  <dc:identifier>0441172717</dc:identifier>
  <dc:description>Sand.</dc:description>
  <meta name="calibre:series" content="Dune Chronicles"/>
  <meta name="calibre:series_index" content="1.5"/>
 </metadata>
</package>"""
CONTAINER = """<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container">
 <rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>"""


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def library(root):
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    archive(root / "good.epub", {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF})
    archive(root / "sub" / "noopf.EPUB", {"META-INF/container.xml": CONTAINER})
    archive(root / "nocontainer.epub", {"x": "y"})
    (root / "corrupt.epub").write_bytes(b"not a zip")
    (root / "malformed.epub").write_bytes(b"")
    archive(root / "malformed.epub", {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": "<package><meta"})
    (root / "plain.txt").write_text("hello")
    (root / "skip.exe").write_text("no")
    (root / "noextension").write_text("no")
    (root / "scan.pdf").write_text("pdf")
    (root / ".hidden" / "x.epub").write_text("no")


def test_scan_listing(spark, tmp_path):
    library(tmp_path / "lib")
    found = listing.scan_listing(spark, str(tmp_path / "lib"), ignore=" PDF,, djvu ").collect()
    names = [r["path"].rsplit("/", 1)[1] for r in found]
    assert names == ["corrupt.epub", "good.epub", "malformed.epub", "nocontainer.epub", "plain.txt", "noopf.EPUB"]
    sizes = {r["path"].rsplit("/", 1)[1]: (r["format"], r["size_bytes"]) for r in found}
    assert sizes["plain.txt"] == ("txt", 5) and sizes["noopf.EPUB"][0] == "epub"


def test_scan_listing_lists_every_visible_name(spark, tmp_path, monkeypatch):
    """Names that start with ``_``, folders beyond the number of partitions, and what a listing says is missing."""
    root = tmp_path / "lib"
    for folder in ("", "_sub", "_sub/deep", "a b", "c%20d", ".hidden", "_sub/.h"):
        (root / folder).mkdir(exist_ok=True, parents=True)
        (root / folder / "_notes.epub").write_text("x" * (len(folder) + 1))
        (root / folder / ".dot.epub").write_text("no")
    want = {
        str(root / f / "_notes.epub"): len(f) + 1 for f in ("", "_sub", "_sub/deep", "a b", "c%20d")
    }
    for folders in (256, 3, 1):
        monkeypatch.setattr(listing, "FOLDERS", folders)
        found = listing.scan_listing(spark, f"file://{root}").collect()
        assert {r["path"]: r["size_bytes"] for r in found} == want and len(found) == len(want)
    known = spark.createDataFrame([(p, n, False) for p, n in want.items()], "path string, size_bytes long, missing boolean")
    diff = snapshot.snapshot_diff(listing.scan_listing(spark, str(root)), known.withColumn("modified_at", F.current_timestamp()))
    assert {r["change"] for r in diff.collect()} <= {"unchanged", "updated"} and diff.count() == len(want)
    contents = listing.read_contents(listing.scan_listing(spark, str(root))).collect()
    assert {r["path"]: len(r["content"]) for r in contents} == want
    gone = spark.createDataFrame([(str(root / "gone.epub"), "epub")], "path string, format string")
    assert listing.read_contents(gone).collect() == []
    assert listing.scan_listing(spark, str(tmp_path / "nothing")).collect() == []


def test_extract_metadata(spark, tmp_path):
    library(tmp_path / "lib")
    files = listing.read_contents(listing.scan_listing(spark, str(tmp_path / "lib")))
    tags = spark.createDataFrame(
        [(str(tmp_path / "lib" / "scan.pdf"), 0, "title", "Scan"), (str(tmp_path / "lib" / "scan.pdf"), 1, "author", "A B; C & D")],
        schemas.TAGGED_METADATA,
    )
    rows = {r["path"].rsplit("/", 1)[1]: r for r in packages.extract_metadata(files, tags).collect()}
    good = rows["good.epub"].asDict()
    assert good["title"] == "Dune & Sons" and good["authors"] == ["Frank Herbert"]
    assert (good["year"], good["language"], good["publisher"]) == (1965, "en", "Ace")
    assert (good["isbn13"], good["isbn10"]) == ("9780441172719", "0441172717")
    assert (good["series"], good["series_index"], good["description"]) == ("Dune Chronicles", 1.5, "Sand.")
    assert good["parse_error_note"] is None
    assert rows["corrupt.epub"]["parse_error_note"] == "EPUB parse failed: Not a valid EPUB (zip) archive"
    assert "container.xml not found" in rows["nocontainer.epub"]["parse_error_note"]
    assert rows["noopf.EPUB"]["parse_error_note"].endswith("not found: OEBPS/content.opf")
    assert rows["malformed.epub"]["title"] is None
    assert (rows["scan.pdf"]["title"], rows["scan.pdf"]["authors"]) == ("Scan", ["A B", "C", "D"])
    assert rows["plain.txt"]["title"] is None and rows["plain.txt"]["parse_error_note"] is None


def test_fold_tags(spark):
    rows = [
        ("/a", 0, "title", "First"), ("/a", 1, "title", "Second"), ("/a", 2, "503", "Updated"),
        ("/a", 3, "100", "B"), ("/a", 4, "100", " A "), ("/a", 5, "106", "no"), ("/a", 6, "106", "May 1999"),
        ("/a", 7, "104", "9780441172719"), ("/a", 8, "104", "9780306406157"), ("/a", 9, "series", "S1"),
        ("/a", 10, "series", "S2"), ("/a", 11, "101", " "), ("/a", 12, "101", "P"),
        ("/b", 0, "title", "Only"),
    ]
    got = {r["path"]: r for r in tagged.fold_tags(spark.createDataFrame(rows, schemas.TAGGED_METADATA)).collect()}
    a, b = got["/a"], got["/b"]
    assert (a["title"], a["authors"], a["year"], a["isbn13"]) == ("Updated", ["B", "A"], 1999, "9780441172719")
    assert (a["series"], a["publisher"]) == ("S2", "P")
    assert (b["title"], b["authors"], b["year"]) == ("Only", [], None)


def responses(spark, bodies, title="Dune"):
    rows = [(i, title, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "entity_id long, query_title string, body string")


def test_volumes_feed(spark):
    volume = {
        "id": "v1",
        "volumeInfo": {
            "title": "Dune", "authors": ["Frank Herbert"], "publishedDate": "1965-08",
            "industryIdentifiers": [
                {"type": "ISBN_10", "identifier": "0441172717"},
                {"type": "ISBN_13", "identifier": "9780441172719"},
            ],
            "imageLinks": {"thumbnail": "http://t", "small": "http://s"},
        },
    }
    bodies = [
        {"items": [volume, {"id": "v2", "volumeInfo": {"authors": ["no title"]}}]},
        "not json",
        {},
        {"items": [volume, {"volumeInfo": {"title": "no id"}}]},
    ]
    rows = providers.volumes_candidates(responses(spark, bodies)).collect()
    assert [(r["entity_id"], r["candidate_id"]) for r in rows] == [(0, "gb-v1")]
    row = rows[0]
    assert (row["isbn10"], row["isbn13"], row["year"]) == ("0441172717", "9780441172719", 1965)
    assert (row["cover_url"], row["similarity"]) == ("https://s", 1.0)


def test_works_feed(spark):
    doc = {
        "key": "/works/1", "title": "Dune Messiah", "author_name": ["F"], "first_publish_year": 1969,
        "publisher": ["A", "B"], "language": ["eng"], "isbn": ["x"] * 20 + ["9780441172719"], "cover_i": 7,
    }
    rows = providers.works_candidates(responses(spark, [{"docs": [doc, {"title": "T"}, {"key": "k"}]}, "["])).collect()
    assert len(rows) == 2 and rows[0]["candidate_id"] == "ol-/works/1"
    assert (rows[0]["publisher"], rows[0]["isbn13"], rows[0]["similarity"]) == ("A", None, 0.5)
    assert rows[0]["cover_url"] == "https://covers.openlibrary.org/b/id/7-L.jpg"
    assert rows[1]["candidate_id"].startswith("ol-") and rows[1]["cover_url"] is None


def small_catalog(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    book = lambda i, title, authors, **k: (
        i, title, title.lower(), authors, "", k.get("series"), k.get("index"), k.get("publisher"), k.get("year"),
        None, None, None, None, None, "partial", "single", None, at, at,
    )
    entities = spark.createDataFrame(
        [book(1, 'A "quoted", title', ["X Y", "Z"], year=1999, index=2.0), book(2, "بوف کور", [])], schemas.ENTITY
    )
    members = spark.createDataFrame(
        [
            (1, 1, "/b.pdf", "pdf", 5, at, False, None, None, None, None),
            (2, 1, "/a.epub", "epub", 7, at, True, None, None, None, None),
        ],
        schemas.MEMBER,
    )
    records = spark.createDataFrame([(1, "title", "manual", at)], schemas.PROVENANCE)
    return entities, members, records


def test_csv_bytes(spark, tmp_path):
    entities, members, _ = small_catalog(spark)
    export.export_csv(entities.orderBy("id").coalesce(1), members, str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*"))
    data = b"".join(p.read_bytes() for p in parts)
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbftitle,authors,series") for p in parts)
    text = data.decode("utf-8")
    line = '"A ""quoted"", title",X Y; Z,,2,,1999,,,,epub;pdf,/a.epub; /b.pdf,12,partial,single\r\n'
    assert line in text
    assert "بوف کور,,,,,,,,,,,0,partial,single\r\n" in text


def test_csv_quotes_only_for_the_active_delimiter(spark, tmp_path):
    entities, members, _ = small_catalog(spark)
    renamed = entities.withColumn("title", F.lit("a, b"))
    export.export_csv(renamed, members, str(tmp_path / "csv"), delimiter=";")
    text = "".join(p.read_text("utf-8-sig") for p in (tmp_path / "csv").glob("part-*"))
    assert "\na, b;" in text.replace("\r", "") and '"X Y; Z"' in text


def test_json(spark, tmp_path):
    entities, members, records = small_catalog(spark)
    export.export_json(entities, members, records, str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json" / "books").glob("part-*") for x in p.read_text().splitlines()]
    first = next(b for b in lines if b["title"].startswith("A"))
    assert [f["path"] for f in first["files"]] == ["/a.epub", "/b.pdf"]
    assert first["files"][0] == {
        "path": "/a.epub", "format": "epub", "size_bytes": 7, "modified_date": "2024-01-02T03:04:05Z", "missing": True,
    }
    assert first["provenance"] == {"title": {"source": "manual", "fetched_at": "2024-01-02T03:04:05Z"}}
    assert "publisher" not in first and first["part"] == 0
    second = next(b for b in lines if b["title"] == "بوف کور")
    assert second["files"] == [] and second["authors"] == []
    manifest = [json.loads(x) for p in (tmp_path / "json" / "manifest").glob("part-*") for x in p.read_text().splitlines()]
    assert (manifest[0]["schema_version"], manifest[0]["book_count"]) == (1, 2)


def test_large_entities_are_exported_in_pages(spark):
    entities, members, records = small_catalog(spark)
    rows = export.json_rows(entities, members, records, page_files=1).filter("id = 1").orderBy("part").collect()
    assert [f["path"] for r in rows for f in r["files"]] == ["/a.epub", "/b.pdf"]
    flat = export.csv_rows(entities, members, page_files=1).filter("id = 1").orderBy("part").collect()
    assert [(r["files"], r["formats"], r["total_size_bytes"]) for r in flat] == [
        ("/a.epub", "epub;pdf", "12"), ("/b.pdf", "epub;pdf", "12"),
    ]


def test_a_thousand_pages_have_one_shape(spark):
    entities, members, records = small_catalog(spark)
    one = members.filter("path = '/a.epub'")
    many = spark.range(3000).join(one.drop("id", "path"), how="cross").select(
        "id", *[F.format_string("/m%05d.epub", "id").alias(c) if c == "path" else F.col(c) for c in members.columns if c != "id"]
    ).select(*members.columns)
    flat = export.csv_rows(entities, many, page_files=3).filter("id = 1").orderBy("part").collect()
    assert len(flat) == 1000 and {(r["formats"], r["total_size_bytes"]) for r in flat} == {
        (";".join(["epub"] * 3000), str(7 * 3000))
    }
    assert "; ".join(r["files"] for r in flat) == "; ".join(f"/m{i:05d}.epub" for i in range(3000))


def test_csv_keeps_line_breaks(spark, tmp_path):
    entities, members, records = small_catalog(spark)
    titled = entities.withColumn("title", F.lit("one\ntwo\r\nthree"))
    export.export_csv(titled, members, str(tmp_path / "csv"), scope=titled.filter("id = 1"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert data.count(b'"one\ntwo\r\nthree",') == 1 and data.endswith(b"single\r\n")


def test_snapshot_round_trip(spark, tmp_path):
    entities, members, records = small_catalog(spark)
    entities = entities.withColumn("cover_path", F.concat(F.lit("c"), "id"))
    journal = spark.createDataFrame([(1, "b", 1, "/old/x", "/older/x", None, False)], schemas.RENAME_JOURNAL)
    members = members.withColumn("path", F.concat(F.lit("/old"), "path"))
    tables = {"entity": entities, "member": members, "provenance": records, "rename_journal": journal}
    folder = str(tmp_path / "store")
    none = {n: t.limit(0) for n, t in tables.items()}
    assert store.restore_if_empty(spark, none, folder, "/new")[1] is False
    store.write_snapshot(tables, folder, 1, "/wrong")
    store.write_snapshot(tables, folder, 2, "/old")
    assert store.latest_version(spark, folder) == (2, "/old")
    assert store.restore_if_empty(spark, tables, folder, "/new")[1] is False
    assets = spark.createDataFrame([("c2",)], "path string")
    restored, done = store.restore_if_empty(spark, none, folder, "/new/", assets)
    assert done
    assert sorted(r["path"] for r in restored["member"].collect()) == ["/new/a.epub", "/new/b.pdf"]
    assert restored["rename_journal"].first()[3:5] == ("/new/x", "/older/x")
    assert {r["id"]: r["cover_path"] for r in restored["entity"].collect()} == {1: None, 2: "c2"}
