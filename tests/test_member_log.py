"""Members by path and version: what is written, what is read, and what is shuffled."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators.snapshot import snapshot_diff
from folioframe.sources import member_log

T0 = dt.datetime(2024, 1, 1)


def members(spark, sizes):
    rows = [(i, 1, p, "epub", s, T0, False, None, None, None, None) for i, (p, s) in enumerate(sorted(sizes.items()))]
    return spark.createDataFrame(rows, schemas.MEMBER)


def sizes(table):
    return {r["path"]: r["size_bytes"] for r in table.collect()}


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def files(folder):
    return sorted((str(p), p.stat().st_mtime_ns) for p in folder.rglob("*") if p.is_file())


def test_versions_of_members(spark, tmp_path):
    folder = str(tmp_path / "log")
    member_log.create(spark, folder)
    assert member_log.read(spark, folder).isEmpty()
    one = {f"/l/{i:03d}.epub": i for i in range(100)}
    assert member_log.write(members(spark, one), folder, 1)
    assert sizes(member_log.read(spark, folder)) == one

    # The same members again: nothing is written, and no version is there.
    before = files(tmp_path / "log")
    assert member_log.write(members(spark, one), folder, 2) is False
    assert files(tmp_path / "log") == before

    # One row changed and one gone: two rows are written. Half a version of a failed attempt is replaced.
    two = {**one, "/l/007.epub": 777}
    del two["/l/099.epub"]
    left = tmp_path / "log" / "rows" / "version=3"
    left.mkdir()
    (left / "part-0_00000.c000.snappy.parquet").write_bytes(b"half")
    assert sizes(member_log.read(spark, folder)) == one
    assert member_log.write(members(spark, two), folder, 3)
    assert sizes(member_log.read(spark, folder)) == two
    assert sizes(member_log.read(spark, folder, 2)) == one
    assert spark.read.parquet(str(left)).count() == 2
    assert member_log.write(members(spark, one), folder, 3) is False
    with pytest.raises(ValueError):
        member_log.write(members(spark, one), folder, 2)

    # A path that comes back, then a whole version: reading starts there.
    assert member_log.write(members(spark, one), folder, 4)
    assert member_log.write(members(spark, one), folder, 5, whole=True)
    assert sizes(member_log.read(spark, folder)) == one
    assert sizes(member_log.read(spark, folder, 3)) == two
    assert member_log.versions(spark, folder) == [(1, False), (3, False), (4, False), (5, True)]


def test_a_diff_shuffles_the_listing_only(spark, tmp_path):
    folder = str(tmp_path / "log")
    member_log.create(spark, folder)
    member_log.write(members(spark, {f"/l/{i:03d}.epub": i for i in range(200)}), folder, 1)
    member_log.write(members(spark, {f"/l/{i:03d}.epub": i + (i == 5) for i in range(200)}), folder, 2)
    rows = [(f"/l/{i:03d}.epub", "epub", i, T0) for i in range(3, 203)]
    listing = spark.createDataFrame(rows, schemas.LISTING).repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = snapshot_diff(listing, member_log.read(spark, folder))
        count, plan = exchanges(diff)
        assert count == 1, plan
        got = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {"missing": 3, "added": 3, "updated": 1, "unchanged": 196}
