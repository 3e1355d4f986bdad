"""The registered queries and their SQL."""

from __future__ import annotations

import __spark_entry__ as entry
import duckdb
import pytest

from folioframe.plans.catalog_queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The optional training-data queries have checks of their own.
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


# A cross-section; tools/check_values.py runs all of them.
@pytest.mark.parametrize(
    "name",
    ["normalize_key", "snapshot_diff", "merge_metadata", "candidate_match", "catalog_view", "load_catalog", "tag_fold", "rank_reordered", "outcome_failed",
     "apply_provenance", "apply_decisions", "export_rows_json", "export_selection", "sorted_by_author"],
)
def test_values(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    assert sorted(frame.columns) == columns
    order = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == want
