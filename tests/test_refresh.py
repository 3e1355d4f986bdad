"""Refreshing a catalog: first run, unchanged run, changes, manual decisions in between."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators import overrides
from folioframe.plans.refresh import Catalog, refresh_catalog
from folioframe.session import materialize

def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))

T0 = dt.datetime(2024, 1, 1)

# path, title, authors, isbn13: a small library with every kind of evidence.
LIBRARY = [
    ("/lib/dune.epub", "Dune", ["Frank Herbert"], "9780441172719"),
    ("/lib/Dune - Frank Herbert.pdf", "Dune", ["Frank Herbert"], None),
    ("/lib/dune_v2.mobi", "Dune", [], None),
    ("/lib/a/rework.epub", "Rework", ["Jason Fried"], None),
    ("/lib/b/rework.epub", "Rework", ["Somebody Else"], None),
    ("/lib/Old Notes - Anonymous.txt", None, [], None),
    ("/lib/broken.epub", None, [], None),
]


def listing(spark, paths, size=10, at=T0):
    rows = [(p, p.rsplit(".", 1)[1], size, at) for p in paths]
    return spark.createDataFrame(rows, schemas.LISTING)


def metadata(spark, rows=LIBRARY):
    out = []
    for path, title, authors, isbn in rows:
        note = "EPUB parse failed: bad" if "broken" in path else None
        out.append((path, title, authors, None, None, None, None, None, None, isbn, None, note))
    return spark.createDataFrame(out, schemas.METADATA)


def empty(spark):
    return Catalog(
        spark.createDataFrame([], schemas.ENTITY),
        spark.createDataFrame([], schemas.MEMBER),
        spark.createDataFrame([], schemas.PROVENANCE),
    )


def saved(catalog):
    return Catalog(*[materialize(t) for t in (catalog.entity, catalog.member, catalog.provenance)])


def summary(result):
    return tuple(result.summary.first())


def books(catalog):
    members = catalog.member.groupBy("book_id").agg(
        F.array_sort(F.collect_list("path")).alias("paths"), F.bool_or("missing").alias("missing")
    )
    return {
        r["id"]: r for r in catalog.entity.join(members, F.col("id") == F.col("book_id")).collect()
    }


@pytest.fixture(scope="module")
def first(spark):
    result = refresh_catalog(listing(spark, [r[0] for r in LIBRARY]), metadata(spark), empty(spark), now=now())
    return result, saved(result.catalog)


def test_first_run(first):
    result, catalog = first
    assert summary(result) == (7, 0, 0, 0, 7)
    rows = books(catalog)
    assert len(rows) == 5
    by_title = {(r["title"], tuple(r["authors"])): r for r in rows.values()}
    dune = by_title[("Dune", ("Frank Herbert",))]
    assert dune["paths"] == sorted(r[0] for r in LIBRARY[:3])
    assert (dune["group_method"], dune["metadata_status"]) == ("filename", "complete")
    assert dune["author_sort"] == "herbert, frank" and dune["isbn13"] == "9780441172719"
    assert by_title[("Anonymous", ("Old Notes",))]["metadata_status"] == "partial"
    assert by_title[("broken", ())]["parse_error_note"] == "EPUB parse failed: bad"
    # Ids follow the first path of each entity.
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert [rows[i]["paths"][0] for i in sorted(rows)] == sorted(r["paths"][0] for r in rows.values())
    sources = {(r["book_id"], r["field"]): r["source"] for r in catalog.provenance.collect()}
    assert sources[(dune["id"], "title")] == "embedded" and sources[(dune["id"], "isbn13")] == "embedded"
    notes_id = by_title[("Anonymous", ("Old Notes",))]["id"]
    assert sources[(notes_id, "authors")] == "filename"
    assert (by_title[("broken", ())]["id"], "authors") not in sources
    assert [tuple(r) for r in result.notes.collect()][0][1:] == ("/lib/broken.epub", "EPUB parse failed: bad")


def test_unchanged_run_is_a_fixpoint(spark, first):
    _, catalog = first
    result = refresh_catalog(
        listing(spark, [r[0] for r in LIBRARY], at=T0 + dt.timedelta(milliseconds=900)),
        metadata(spark, []),
        catalog,
        now=now(),
    )
    assert summary(result) == (0, 0, 7, 0, 7)
    again = saved(result.catalog)
    assert books(again).keys() == books(catalog).keys()
    assert again.entity.exceptAll(catalog.entity).isEmpty()
    assert again.provenance.exceptAll(catalog.provenance).isEmpty()
    gone = ["path", "id", "book_id", "missing", "embedded_title_key"]
    assert again.member.select(*gone).exceptAll(catalog.member.select(*gone)).isEmpty()


def test_missing_changed_renamed_and_reappearing(spark, first):
    _, catalog = first
    paths = [r[0] for r in LIBRARY if "dune.epub" not in r[0] and "Notes" not in r[0]]
    moved = ("/lib/new name.epub", "Dune", ["Frank Herbert"], "9780441172719")
    changed = listing(spark, ["/lib/a/rework.epub"], size=99)
    others = listing(spark, [p for p in paths if p != "/lib/a/rework.epub"] + [moved[0]])
    fresh = metadata(spark, [("/lib/a/rework.epub", "Changed", ["New Author"], None), moved])
    result = refresh_catalog(others.union(changed), fresh, catalog, now=now())
    assert summary(result) == (1, 1, 4, 2, 6)
    after = saved(result.catalog)
    rows = books(after)
    assert len(rows) == 5
    dune = next(r for r in rows.values() if r["title"] == "Dune")
    assert "/lib/new name.epub" in dune["paths"] and "/lib/dune.epub" in dune["paths"] and dune["missing"]
    # Known titles and authors are kept although the file now says something else.
    rework = next(r for r in rows.values() if "/lib/a/rework.epub" in r["paths"])
    assert (rework["title"], rework["authors"]) == ("Rework", ["Jason Fried"])
    keys = {r["path"]: r for r in after.member.collect()}
    assert keys["/lib/a/rework.epub"]["embedded_title_key"] == "changed"
    assert keys["/lib/a/rework.epub"]["size_bytes"] == 99
    back = refresh_catalog(listing(spark, [*paths, LIBRARY[5][0], moved[0]]), metadata(spark), after, now=now())
    assert not any(r["missing"] for r in back.catalog.member.filter("path like '%Notes%'").collect())
    assert summary(back)[3] == 0


def test_manual_merge_survives_rescans(spark, first):
    _, catalog = first
    ids = [r["id"] for r in books(catalog).values() if r["title"] == "Rework"]
    requests = spark.createDataFrame([(i, "m") for i in ids], "id long, merge_id string")
    entity, member = overrides.merge_entities(catalog.entity, catalog.member, requests, now())
    merged = saved(Catalog(entity, member, catalog.provenance))
    result = refresh_catalog(listing(spark, [r[0] for r in LIBRARY]), metadata(spark, []), merged, now=now())
    rows = books(result.catalog)
    assert len(rows) == 4
    rework = rows[min(ids)]
    assert rework["paths"] == ["/lib/a/rework.epub", "/lib/b/rework.epub"] and rework["group_method"] == "manual"
    records = result.catalog.provenance.select("book_id").distinct().collect()
    assert {r["book_id"] for r in records} == set(rows)


def test_ungroup_survives_rescans(spark, first):
    _, catalog = first
    dune = next(r for r in books(catalog).values() if r["title"] == "Dune")
    requests = spark.createDataFrame([(dune["id"],)], "id long")
    entity, member, records = overrides.ungroup(
        catalog.entity, catalog.member, metadata(spark), requests, 6, now()
    )
    split = saved(Catalog(entity, member, catalog.provenance.unionByName(records)))
    rows = books(split)
    assert len(rows) == 7 and rows[dune["id"]]["paths"] == [dune["paths"][0]]
    assert {rows[6]["group_method"], rows[7]["group_method"], rows[dune["id"]]["group_method"]} == {"manual"}
    result = refresh_catalog(listing(spark, [r[0] for r in LIBRARY]), metadata(spark, []), split, now=now())
    assert books(result.catalog).keys() == rows.keys()


def test_overrides_are_read_with_the_refresh(spark, first):
    _, catalog = first
    pins = spark.createDataFrame(
        [("/lib/a/rework.epub", "x"), ("/lib/b/rework.epub", "x")], schemas.OVERRIDE
    )
    result = refresh_catalog(
        listing(spark, [r[0] for r in LIBRARY]), metadata(spark, []), catalog, overrides=pins, now=now()
    )
    assert len(books(result.catalog)) == 4


def test_many_notes_stay_whole(spark):
    rows = [(f"/n/{i:04d}/book.epub", None, [], None) for i in range(1, 1502)]
    notes = metadata(spark, rows).withColumn("parse_error_note", F.concat(F.lit("bad "), "path"))
    files = listing(spark, [r[0] for r in rows])
    result = refresh_catalog(files, notes, empty(spark), now=now())
    assert result.catalog.entity.first()["parse_error_note"] == "; ".join(sorted(f"bad {r[0]}" for r in rows))
    assert result.notes.count() == len(rows)


def test_unread_files_are_read_next_time(spark):
    rows = [("/u/x.epub", "One", ["A"], None), ("/u/y.epub", "Two", ["B"], None)]
    files = listing(spark, [r[0] for r in rows])
    first = refresh_catalog(files, metadata(spark, rows[:1]), empty(spark), now=now()).catalog
    unread = {r["path"]: r["size_bytes"] for r in first.member.collect()}
    assert unread["/u/x.epub"] is not None and unread["/u/y.epub"] is None
    second = refresh_catalog(files, metadata(spark, rows), first, now=now())
    assert second.summary.first()["updated"] == 1
    keys = {r["path"]: r["embedded_title_key"] for r in second.catalog.member.collect()}
    assert keys == {"/u/x.epub": "one", "/u/y.epub": "two"}
    third = refresh_catalog(files, metadata(spark, rows), second.catalog, now=now())
    assert third.summary.first()["unchanged"] == 2


def test_overrides_reach_new_files(spark):
    rows = [("/o/x.epub", "One", ["A"], None), ("/o/y.epub", "Two", ["B"], None)]
    pins = spark.createDataFrame([(r[0], "t") for r in rows], "path string, manual_group_id string")
    result = refresh_catalog(
        listing(spark, [r[0] for r in rows]), metadata(spark, rows), empty(spark), overrides=pins, now=now()
    ).catalog
    assert result.entity.count() == 1
    assert {r["manual_group_id"] for r in result.member.collect()} == {"t"}


def random_library(rng, n):
    """Files whose titles, authors, identifiers and stems often meet, some without any of them."""
    rows = []
    for i in range(n):
        stem = f"{rng.choice(['alpha', 'beta', 'gamma', 'delta', 'omega'])} {rng.randrange(n // 3)}"
        title = rng.choice([None, f"T{rng.randrange(n // 2)}"])
        authors = rng.choice([[], [f"A{rng.randrange(4)}"]])
        isbn = rng.choice([None, None, None, f"97804411{rng.randrange(n // 2):05d}"])
        rows.append((f"/r/{i:04d}/{stem}.epub", title, authors, isbn))
    return rows


@pytest.mark.parametrize("seed", [1, 3])
def test_touched_entities_alone_give_the_full_result(spark, seed):
    import random

    rng = random.Random(seed)
    rows = random_library(rng, 300)
    first = saved(
        refresh_catalog(listing(spark, [r[0] for r in rows]), metadata(spark, rows), empty(spark), now=now()).catalog
    )
    # Upkeep between two runs: a file is dropped, another belongs to a group of its own.
    handled = {r["book_id"] for r in first.member.filter(F.col("path").isin(rows[7][0], rows[9][0])).collect()}
    member = first.member.filter(F.col("path") != rows[7][0]).withColumn(
        "manual_group_id", F.when(F.col("path") == rows[9][0], "own").otherwise(F.col("manual_group_id"))
    )
    first = saved(Catalog(first.entity, member, first.provenance))
    gone = {rows[i][0] for i in rng.sample(range(300), 4)} | {rows[7][0]}
    changed = {}
    for i in rng.sample(range(300), 4):
        if rows[i][0] not in gone:
            changed[rows[i][0]] = (rows[i][0], f"T{rng.randrange(150)}", [f"A{rng.randrange(4)}"], None)
    added = [("/r/new/" + r[0].split("/", 2)[2].replace("/", "-"), *r[1:]) for r in random_library(rng, 300)[:4]]
    kept = [r[0] for r in rows if r[0] not in gone and r[0] not in changed]
    files = listing(spark, kept + [r[0] for r in added]).union(listing(spark, list(changed) or ["/r/none.epub"], size=77))
    pins = spark.createDataFrame([(rows[20][0], "x"), (rows[21][0], "x")], schemas.OVERRIDE)
    fresh = metadata(spark, [*changed.values(), *added])
    later = F.timestamp_seconds(F.lit(1_800_000_000))
    full = refresh_catalog(files, fresh, first, pins, now=later)
    part = refresh_catalog(files, fresh, first, pins, now=later, only_touched=True)
    a, b = saved(full.catalog), saved(part.catalog)
    assert summary(full) == summary(part)
    for name in ("member", "provenance"):
        left, right = getattr(a, name), getattr(b, name)
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    # The two entities that upkeep has handled can be untouched; such a one keeps the evidence it had.
    left, right = (c.entity.drop("updated_at", "group_method") for c in (a, b))
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    methods = [{r["id"]: r["group_method"] for r in c.entity.collect()} for c in (a, b)]
    assert {i for i in methods[0] if methods[0][i] != methods[1][i]} <= handled
    assert 0 < part.groups.count() < full.groups.count() / 2


def test_nothing_touched_resolves_nothing(spark, first):
    _, catalog = first
    result = refresh_catalog(
        listing(spark, [r[0] for r in LIBRARY]), metadata(spark, []), catalog, now=now(), only_touched=True
    )
    assert result.groups.isEmpty()
    assert result.catalog.entity.exceptAll(catalog.entity).isEmpty() and result.catalog.entity.count() == 5
    assert result.catalog.member.exceptAll(catalog.member).isEmpty() and result.catalog.member.count() == 7


def test_long_titles_are_not_stored_with_ids_and_keys(spark, monkeypatch):
    """No table of a run but the metadata, the state and the folded rows holds a title, and none its key."""
    from folioframe.operators import ranking
    from folioframe.plans import refresh

    stored = []

    def kept(df):
        stored.append(set(df.columns))
        return materialize(df)

    monkeypatch.setattr(refresh, "materialize", kept)
    monkeypatch.setattr(ranking, "materialize", kept)
    result = refresh_catalog(listing(spark, [r[0] for r in LIBRARY]), metadata(spark), empty(spark), now=now())
    assert sum("title" in columns for columns in stored) == 4
    assert not any({"key_title", "embedded_title_key", "title_sort"} & columns for columns in stored)
    rows = {r["path"]: r for r in result.catalog.member.collect()}
    assert sorted(r["id"] for r in rows.values()) == list(range(1, len(LIBRARY) + 1))
    assert rows["/lib/a/rework.epub"]["embedded_title_key"] == "rework"
