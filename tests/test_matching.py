"""Candidate search, decisions and applying a candidate."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators import matching
from folioframe.operators.similarity import similar_titles

CATALOG = "candidate_id string, source string, title string, authors array<string>, isbn10 string, isbn13 string"
QUERY = "entity_id long, isbn string, title string, author string"


def test_provider_order():
    assert matching.provider_order("open_library, nonsense") == ["open_library", "google_books"]
    assert matching.provider_order("") == ["google_books", "open_library"]


@pytest.mark.parametrize("minimum", [0.3, 0.6, 1.0])
def test_similar_titles_against_all_pairs(spark, minimum):
    rng = random.Random(3)
    lists = lambda n: list({tuple(sorted(rng.sample("abcdefghijkl", rng.randint(1, 7)))) for _ in range(n)})
    left, right = lists(60), lists(60)
    frame = lambda rows: spark.createDataFrame([(list(r),) for r in rows], "words array<string>")
    got = {
        (tuple(r["left_words"]), tuple(r["right_words"])): r["similarity"]
        for r in similar_titles(frame(left), frame(right), minimum).collect()
    }
    want = {}
    for a in left:
        for b in right:
            score = len(set(a) & set(b)) / len(set(a) | set(b))
            if score >= minimum:
                want[a, b] = score
    assert got == want


def test_similar_long_lists(spark):
    """Lists around the size limit take both ways of pairing."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = list({tuple(sorted(rng.sample(vocabulary, rng.randint(15, 36)))) for _ in range(60)})
    frame = spark.createDataFrame([(list(r),) for r in rows], "words array<string>")
    pairs = similar_titles(frame, frame, 0.5).collect()
    got = {(tuple(r["left_words"]), tuple(r["right_words"])) for r in pairs}
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5
    assert got == {(a, b) for a in rows for b in rows if alike(a, b)} and len(pairs) == len(got)


def test_a_word_in_every_title_does_not_pair_them(spark):
    """Titles that share only a common word never meet in the join."""
    frame = spark.range(400).select(F.array(F.lit("the"), F.concat(F.lit("w"), "id")).alias("words"))
    assert similar_titles(frame, frame, 0.6).count() == 400


def test_find_candidates(spark):
    catalog = spark.createDataFrame(
        [
            ("c1", "google_books", "Dune", ["Frank Herbert"], "0441172717", "9780441172719"),
            ("c2", "open_library", "Dune Messiah", ["Herbert"], None, None),
            ("c3", "open_library", "Dune", ["Other Writer"], None, None),
            ("c4", "google_books", "Emma", ["Jane Austen"], None, None),
        ],
        CATALOG,
    )
    queries = spark.createDataFrame(
        [
            (1, "9780441172719", "Wrong", None),
            (2, None, "DUNE!", "frank herbert"),
            (3, None, "Dune", None),
            (4, None, "Nothing alike", None),
            (5, "0441172717", "Dune", None),
        ],
        QUERY,
    )
    rows = matching.find_candidates(queries, catalog).collect()
    got = {(r["entity_id"], r["candidate_id"]): r["similarity"] for r in rows}
    assert got == {
        (1, "c1"): 0.0, (2, "c1"): 1.0, (2, "c2"): 0.5, (3, "c1"): 1.0, (3, "c2"): 0.5, (3, "c3"): 1.0, (5, "c1"): 1.0,
    }


def test_titles_with_most_words_are_offered(spark):
    """Containment or an overlap at the threshold, with and without authors, against all pairs."""
    rng = random.Random(8)
    name = lambda low: " ".join(rng.sample("abcdefgh", rng.randint(low, 6)))
    rows = [(f"c{i:03d}", rng.choice(schemas.DEFAULT_PROVIDER_ORDER), name(1), [rng.choice(["x y", "y", "z"])], None, None) for i in range(250)]
    rows.append(("c999", "google_books", "the long way home", ["x"], None, None))
    asked = [(i, None, name(1), rng.choice([None, "x", "z y"])) for i in range(120)] + [(500, None, "a long way home", None)]
    got = {}
    for r in matching.find_candidates(spark.createDataFrame(asked, QUERY), spark.createDataFrame(rows, CATALOG)).collect():
        got.setdefault((r["entity_id"], r["source"]), []).append((-r["similarity"], r["candidate_id"]))
    want, words = {}, lambda s: set(s.split())
    for i, _, title, author in asked:
        for cid, source, other, authors, _, _ in rows:
            a, b = words(title), words(other)
            alike = len(a & b) / len(a | b)
            if (a <= b or alike >= 0.6) and (author is None or words(author) & words(authors[0])):
                want.setdefault((i, source), []).append((-alike, cid))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:10] for k, v in want.items()}
    assert got[500, "google_books"] == [(-0.6, "c999")]


def test_hot_title_keeps_the_exact_first_candidates(spark):
    """A title shared by most rows: the work stays linear and the result equals brute force."""
    rows = [
        (f"c{i:04d}", "google_books", "Untitled Work" if i % 3 else f"Untitled Work {i}", [f"Author {i % 50}"], None, None)
        for i in range(600)
    ]
    asked = [(i, None, "untitled work", f"Author {i % 50}" if i % 4 else None) for i in range(300)]
    got = {}
    for r in matching.find_candidates(
        spark.createDataFrame(asked, QUERY), spark.createDataFrame(rows, CATALOG)
    ).collect():
        got.setdefault(r["entity_id"], []).append((-r["similarity"], r["candidate_id"]))
    words = lambda s: set(s.lower().split())
    for i, _, title, author in asked:
        hits = []
        for cid, _, other, authors, _, _ in rows:
            if author is None or words(author) & words(authors[0]):
                a, b = words(title), words(other)
                hits.append((-len(a & b) / len(a | b), cid))
        assert sorted(got[i]) == sorted(hits)[:10]


def decide(spark, rows, isbn=None):
    """rows: (source, similarity, error)."""
    candidates = spark.createDataFrame(
        [
            (1, None if e else f"c{i}", s, "T", ["A"], 1990, "P", None, None, None, None, None, sim, e)
            for i, (s, sim, e) in enumerate(rows)
        ],
        schemas.CANDIDATE,
    )
    queries = spark.createDataFrame([(1, isbn, "T", "A")], QUERY)
    return matching.decide(queries, candidates).first()


G, O = "google_books", "open_library"  # noqa: E741


@pytest.mark.parametrize(
    ("rows", "isbn", "outcome"),
    [
        ([(G, 1.0, None)], None, "applied"),
        ([(G, 0.9, None), (G, 0.8, None)], None, "needs_confirmation"),
        ([(G, 0.9, None), (G, 0.6, None)], None, "applied"),
        ([(G, 0.9, None), (G, 0.8, None)], "9780441172719", "applied"),
        ([(G, 0.1, None)], None, "needs_confirmation"),
        ([(G, 0.1, None)], "9780441172719", "needs_confirmation"),
        ([(G, None, "down"), (O, 1.0, None)], None, "applied"),
        ([(G, None, "down")], None, "failed"),
        ([(O, 1.0, None), (G, 0.2, None)], None, "needs_confirmation"),
        ([], None, "no_match"),
    ],
)
def test_decide(spark, rows, isbn, outcome):
    assert decide(spark, rows, isbn)["outcome"] == outcome


def test_apply(spark):
    book = (
        1, "Dune", "dune", ["Frank Herbert"], "herbert, frank", None, None, None, 1965, None, None, None, None, None,
        "complete", "single", None, None, None,
    )
    entities = spark.createDataFrame([book, (2, *book[1:])], schemas.ENTITY)
    chosen = spark.createDataFrame(
        [(1, "c", G, "Dune II", ["B C"], 1990, "Ace", None, None, None, None, None, 1.0, None)], schemas.CANDIDATE
    )
    nothing = spark.createDataFrame([], "id long, manual_fields array<string>")
    manual = spark.createDataFrame([(1, ["year", "title"])], "id long, manual_fields array<string>")

    def run(fields, policy):
        return {r["id"]: r for r in matching.apply_candidates(entities, chosen, fields, policy).collect()}

    filled = run(nothing, "fill_empty")
    assert (filled[1]["year"], filled[1]["publisher"], filled[1]["changed"]) == (1965, "Ace", ["publisher"])
    assert filled[1]["changed_source"] == G and filled[2]["changed"] == []
    over = run(nothing, "overwrite")[1]
    assert (over["year"], over["title"], over["title_sort"], over["author_sort"]) == (1990, "Dune II", "dune ii", "c, b")
    assert over["changed"] == ["title", "authors", "publisher", "year"]
    kept = run(manual, "overwrite")[1]
    assert (kept["year"], kept["title"], kept["changed"]) == (1965, "Dune", ["authors", "publisher"])
    with pytest.raises(ValueError, match="policy"):
        matching.apply_candidates(entities, chosen, nothing, "sometimes")


def test_entities_that_ask_the_same_are_answered_once(spark, monkeypatch):
    """No step ranks the answers of every entity; an id with two titles keeps the first of both."""
    rows = [(i, None, "red fox", "Ann Lee") for i in range(300)] + [(7, None, "blue owl", "Ann Lee"), (7, None, "red fox", "Ann Lee")]
    asked = spark.createDataFrame(rows, "entity_id long, isbn string, title string, author string")
    records = [(f"c{i:02}", "s", t, ["Lee"], None, None) for i, t in enumerate(["red fox"] * 15 + ["blue owl"] * 4 + ["red fox tale"])]
    catalog = spark.createDataFrame(
        records, "candidate_id string, source string, title string, authors array<string>, isbn10 string, isbn13 string"
    )
    ranked, plain = [], matching.first_per_group

    def counted(df, *rest):
        ranked.append(df.count())
        return plain(df, *rest)

    monkeypatch.setattr(matching, "first_per_group", counted)
    found = matching.find_candidates(asked, catalog)
    assert max(ranked) < 300
    ids = {}
    for r in found.collect():
        ids.setdefault(r["entity_id"], []).append(r["candidate_id"])
    assert len(ids) == 300
    assert {tuple(sorted(v)) for k, v in ids.items() if k != 7} == {tuple(f"c{i:02}" for i in range(10))}
    assert sorted(ids[7]) == [f"c{i:02}" for i in range(10)]
