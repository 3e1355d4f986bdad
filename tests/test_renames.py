"""Rename plans against a file-by-file simulation, and the journal."""

from __future__ import annotations

import random

import pytest
import regex
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators import ranking, renames


def plan_of(spark, titles, present=(), template="{title}.{ext}", current=None, missing=()):
    """Plan for one book per title; file i is ``/d/f{i}.epub`` unless ``current`` names it."""
    books, members = [], []
    for i, title in enumerate(titles, 1):
        path = (current or {}).get(i, f"/d/f{i:04d}.epub")
        books.append((i, title, None, ["A"], None, None, None, None, 2000, None, None, None, None, None, "partial", "single", None, None, None))
        members.append((i, i, path, "epub", 1, None, i in missing, None, None, None, None))
    entities = spark.createDataFrame(books, schemas.ENTITY)
    files = spark.createDataFrame(members, schemas.MEMBER)
    listed = [(m[2],) for m in members if not m[6]] + [(p,) for p in present]
    listing = spark.createDataFrame(listed, "path string")
    return renames.plan_renames(entities, files, listing, template)


def rows(plan):
    return {r["file_id"]: (r["proposed_name"], r["status"]) for r in plan.collect()}


def counted_name(name, counter, limit=schemas.NAME_BYTES):
    match = regex.fullmatch(r"(.+)\.([^.\s]+)", name, regex.DOTALL)
    stem, suffix = (match[1], "." + match[2]) if match else (name, "")
    marker = f" ({counter})"
    budget = limit - len(suffix.encode()) - len(marker)
    if len(stem.encode()) > budget:
        kept = ""
        for grapheme in regex.findall(r"\X", stem):
            if len((kept + grapheme).encode()) > budget:
                break
            kept += grapheme
        stem = kept.strip()
    return stem + marker + suffix


def greedy(names, taken):
    taken, out = {t.lower() for t in taken}, []
    for name in names:
        final, counter = name, 2
        while final.lower() in taken:
            final = counted_name(name, counter)
            counter += 1
        taken.add(final.lower())
        out.append(final)
    return out


def test_statuses(spark):
    plan = plan_of(
        spark,
        ["Same", "Case", "Gone", "Free", "Taken", "Twin", "twin"],
        present=["/d/taken.EPUB"],
        current={1: "/d/Same.epub", 2: "/d/case.epub"},
        missing={3},
    )
    got = {r["file_id"]: r for r in plan.collect()}
    named = {i: (r["proposed_name"], r["status"], r["included"]) for i, r in got.items()}
    assert named == {
        1: ("Same.epub", "no_op", False),
        2: ("Case.epub", "ready", True),
        3: ("f0003.epub", "excluded", False),
        4: ("Free.epub", "ready", True),
        5: ("Taken (2).epub", "collision", True),
        6: ("Twin.epub", "ready", True),
        7: ("twin (2).epub", "collision", True),
    }
    assert got[3]["reason"] == "File is missing on disk"
    required = plan_of(spark, ["X"], template="{series} {language}.{ext}").first()
    assert (required["status"], required["reason"]) == ("excluded", "Missing value for {series}, {language}")


def test_names_that_move_away_are_free(spark):
    plan = plan_of(spark, ["B", "C"], current={1: "/d/A.epub", 2: "/d/B.epub"})
    assert rows(plan) == {1: ("B.epub", "ready"), 2: ("C.epub", "ready")}


def test_other_directories_do_not_collide(spark):
    plan = plan_of(spark, ["X", "X"], current={1: "/a/1.epub", 2: "/b/2.epub"})
    assert {s for _, s in rows(plan).values()} == {"ready"}


def test_long_name_keeps_its_counter(spark):
    long = "L" * 250
    plan = rows(plan_of(spark, [long, long, "é" * 200, "é" * 200]))
    assert plan[1] == (long + ".epub", "ready")
    assert plan[2] == ("L" * 246 + " (2).epub", "collision")
    assert all(len(n.encode()) <= 255 for n, _ in plan.values())
    assert plan[4][0] == "é" * 123 + " (2).epub"


@pytest.mark.parametrize(("window", "seed"), [(1_000_000, 11), (1_000_000, 12), (0, 13)])
def test_against_greedy_simulation(spark, monkeypatch, window, seed):
    """Plain names, names that are counters of each other, taken names, and long names."""
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window)
    rng = random.Random(seed)
    pool = ["Dune", "DUNE", "Dune (2)", "Dune (3)", "Dune (9)", "Dune (2) (2)", "Dune (2) (3)", "Emma", "Solo"]
    pool += ["Rework (2)", "Rework (3)", "Rework (2) (2)", "Emma (3)"]
    pool += ["P" * 249, "P" * 247 + "xyz", "Q" * 228, "Q" * 190, "Q" * 190 + " (2)", "R" * 228, "Z" * 185]
    pool += ["Z" * 185 + " (2) (2) (2) (2) (2) (2) (2) (2) (2) (2)"]
    titles = [rng.choice(pool) for _ in range(220)]
    present = ["/d/emma (2).epub", "/d/Emma (4).epub", "/d/Solo.epub", "/d/solo (3).epub", "/d/Dune (5).epub"]
    present += ["/d/" + "R" * 228 + " (2).epub", "/d/" + "Q" * 190 + " (3).epub"]
    got = rows(plan_of(spark, titles, present))
    names = greedy([f"{t}.epub" for t in titles], [p.rsplit("/", 1)[1] for p in present])
    assert [got[i][0] for i in range(1, len(titles) + 1)] == names
    assert len({n.lower() for n in names}) == len(names)


def test_names_cut_by_whole_clusters(spark):
    """Cutting may drop one very long cluster, so a long name can meet a very short one."""
    cluster = "ae" + "\u0301" * 123
    titles = [cluster, cluster, "a", "a", cluster]
    got = rows(plan_of(spark, titles))
    names = [got[i][0] for i in range(1, 6)]
    assert names == greedy([f"{t}.epub" for t in titles], []) and len(set(names)) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_long_clusters_against_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    pieces = ["b", "be" + "\u0301" * 40, "c" * 60, "\U0001f44d\U0001f3fd" * 9, "\U0001f1e9\U0001f1ea" * 7, "(2)", " (3)", "d"]
    pool = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))).strip() for _ in range(25)] + ["b", "b (2)"]
    pool = [t for t in pool if len(f"{t}.epub".encode()) <= 255]
    titles = [rng.choice(pool) for _ in range(120)]
    got = rows(plan_of(spark, titles))
    names = [got[i][0] for i in range(1, len(titles) + 1)]
    assert names == greedy([f"{t}.epub" for t in titles], [])
    assert len({n.lower() for n in names}) == len(names)


@pytest.mark.parametrize("seed", [5, 6])
def test_pools_of_long_names(spark, seed):
    """Long names that are cut alike for one digit or for two, some of them counters of the others."""
    rng = random.Random(seed)
    pool = ["P" * 250, "P" * 247 + "xyz", "P" * 246 + "zzzz", "P" * 246 + " (2)", "P" * 246 + " (3)", "p" * 245 + " (12)"]
    pool += ["P" * 245 + "abcde", "P" * 246 + " (7)", "P" * 240]
    titles = [rng.choice(pool) for _ in range(70)]
    present = ["P" * 246 + " (4).epub", "P" * 245 + " (14).epub"]
    got = rows(plan_of(spark, titles, ["/d/" + p for p in present]))
    assert [got[i][0] for i in range(1, 71)] == greedy([f"{t}.epub" for t in titles], present)


def test_recheck_renames_stale_rows(spark):
    plan = plan_of(spark, ["A", "B"])
    listing = spark.createDataFrame(
        [("/d/f0001.epub",), ("/d/f0002.epub",), ("/d/a.epub",), ("/d/A (2).epub",)], "path string"
    )
    fresh = renames.recheck_plan(renames.actionable(plan), listing)
    assert rows(fresh) == {1: ("A (3).epub", "collision"), 2: ("B.epub", "ready")}


def test_apply_and_undo(spark):
    members = spark.createDataFrame(
        [(1, "/d/f0001.epub"), (2, "/d/f0002.epub"), (3, "/d/x.epub")], "id long, path string"
    )
    empty = spark.createDataFrame([], schemas.RENAME_JOURNAL)
    plan = renames.actionable(plan_of(spark, ["A", "B"]), spark.createDataFrame([(2,)], "file_id long"))
    at = lambda s: F.timestamp_seconds(F.lit(s))
    once, journal = renames.apply_plan(members, empty, plan, "one", at(100))
    paths = lambda m: {r["id"]: r["path"] for r in m.select("id", "path").collect()}
    assert paths(once) == {1: "/d/A.epub", 2: "/d/f0002.epub", 3: "/d/x.epub"}
    second = spark.createDataFrame(
        [(1, "/d/A.epub", "A2.epub"), (3, "/d/x.epub", "y.epub")],
        "file_id long, current_path string, proposed_name string",
    )
    twice, journal = renames.apply_plan(once, journal, second, "two", at(200))
    assert paths(twice) == {1: "/d/A2.epub", 2: "/d/f0002.epub", 3: "/d/y.epub"}
    last = renames.last_batch(journal).first()
    assert (last["batch_id"], last["file_count"]) == ("two", 2)
    back, journal = renames.undo_last_batch(twice, journal)
    assert paths(back) == paths(once)
    start, journal = renames.undo_last_batch(back, journal)
    assert paths(start) == paths(members)
    assert renames.last_batch(journal).isEmpty()
    assert paths(renames.undo_last_batch(start, journal)[0]) == paths(members)


def test_undo_collapses_chains(spark):
    journal = spark.createDataFrame(
        [(1, "b", 9, "/a", "/b", None, False), (2, "b", 9, "/b", "/c", None, False)],
        schemas.RENAME_JOURNAL,
    ).withColumn("executed_at", F.timestamp_seconds(F.lit(5)))
    row = renames.undo_targets(journal).first()
    assert (row["old_path"], row["new_path"]) == ("/a", "/c")


def test_summary(spark):
    counts = renames.plan_summary(plan_of(spark, ["A", "A", "B"], missing={3})).collect()
    assert {(r["status"], r["n"]) for r in counts} == {("ready", 1), ("collision", 1), ("excluded", 1)}
