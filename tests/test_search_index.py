"""The posting table finds what a full search finds, and reads only its own postings."""

from __future__ import annotations

import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.functions.text import filename, key
from folioframe.operators import search_index, views


def catalog(spark, n=120, seed=3):
    rng = random.Random(seed)
    words = ["Dune", "Émile", "Straße", "dark", "matter", "of", "a", "II", "\U0001d54f\U0001d550z", "naïve", "9780306406157", "über-alles"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    books, members = [], []
    for i in range(n):
        title = None if i % 17 == 0 else text(5) * (400 if i == 5 else 1)
        authors = None if i % 13 == 0 else [text(2) for _ in range(i % 3)]
        books.append((i, title, None, authors, text(1) or None, None, None, "9780306406157" if i % 9 == 0 else None, 2000, None, None, None, None, None, "partial", "single", None, None, None))
        members += [(10 * i + j, i, f"/d{i}/{text(3)}{j}.epub", "epub", 1, None, False, None, None, None, None) for j in range(i % 4)]
    return spark.createDataFrame(books, schemas.ENTITY), spark.createDataFrame(members, schemas.MEMBER)


def test_same_rows_as_a_full_search(spark):
    entities, members = catalog(spark)
    folder = tempfile.mkdtemp() + "/index"
    search_index.write_index(entities, members, folder)
    index = search_index.read_index(spark, folder)
    hits = 0
    for needle in ["dune", "DARK matter", "emile", "k-m", "of a", "ii", "", "!!", "0306", "une dark", "nothing here", "1.epub", "\U0001d550z", "e d"]:
        want = sorted(r["id"] for r in views.search(entities, members, needle).select("id").collect())
        got = sorted(r["id"] for r in search_index.search(entities, members, index, needle).select("id").collect())
        assert got == want, needle
        hits += 0 < len(want) < 120
    assert hits >= 6
    rows = index.collect()
    assert len(rows) == len(set(rows))


def test_only_its_own_postings_are_read(spark, capsys):
    entities, members = catalog(spark, 20)
    folder = tempfile.mkdtemp() + "/index"
    search_index.write_index(entities, members, folder)
    search_index.search(entities, members, search_index.read_index(spark, folder), "dune").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(piece, [" in plan


def test_empty_catalog(spark):
    entities, members = spark.createDataFrame([], schemas.ENTITY), spark.createDataFrame([], schemas.MEMBER)
    folder = tempfile.mkdtemp() + "/index"
    search_index.write_index(entities, members, folder)
    assert search_index.search(entities, members, search_index.read_index(spark, folder), "dune").count() == 0


def pairs_of(ids, texts):
    return {(text[at : at + 3], i) for i, text in zip(ids, texts) if i is not None for at in range(len(text) - 2)}


@pytest.mark.parametrize("letters, n, most", [("ab \U0001d54fé", 200, 9), ([chr(c) for c in range(0x20000, 0x2A6D0)] + [chr(c) for c in range(0x4E00, 0xD7A4)], 40_000, 9)])
def test_lists_hold_every_pair_once(letters, n, most):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]
    ids = [rng.choice([-(2**62), -3, 7, k]) for k in range(n)]
    lists = search_index._lists(np.array(ids), pa.array(texts)).to_pylist()
    assert len({r["piece"] for r in lists}) == len(lists)
    assert all(r["ids"] == sorted(set(r["ids"])) for r in lists)
    assert {(r["piece"], i) for r in lists for i in r["ids"]} == pairs_of(ids, texts)
    assert search_index._lists(np.array(ids), pa.array(["ab"] * n)) is None


def test_a_list_for_each_block_is_stored(spark):
    rng = random.Random(4)
    entities = spark.createDataFrame([], schemas.ENTITY)
    rows = [(k, None if k % 50 == 0 else k // 3, f"/d/{rng.randint(0, 10**6)}-K\U0001d54f.epub", "epub", 1, None, False, None, None, None, None) for k in range(6000)]
    members = spark.createDataFrame(rows, schemas.MEMBER)
    folder = tempfile.mkdtemp() + "/index"
    search_index.write_index(entities, members, folder)
    stored, index = spark.read.parquet(folder), search_index.read_index(spark, folder)
    names = members.select("book_id", key(filename(F.col("path"))).alias("name")).collect()
    got = {(r["piece"], r["id"]) for r in index.collect()}
    assert got == pairs_of([r["book_id"] for r in names], [r["name"] for r in names])
    assert index.count() == len(got)
    assert stored.count() * 3 < len(got)
