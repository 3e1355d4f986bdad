"""Change bursts over tables and streams."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.plans.refresh import Catalog, refresh_catalog
from folioframe.sources import listing, packages, store
from folioframe.streaming import refresh, watch

T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame([(root, at(s), "p") for root, s in rows], schemas.CHANGE_EVENT)


def times(rows):
    offset = lambda t: (t - T0).total_seconds()
    return sorted((r["root"], offset(r["started_at"]), offset(r["last_at"]), r["n_events"]) for r in rows)


ROWS = [("a", 0), ("a", 0.2), ("a", 0.9), ("a", 1.8), ("a", 2.8), ("b", 0.5), ("a", 10)]


def test_bursts(spark):
    assert times(watch.change_bursts(events(spark, *ROWS)).collect()) == [
        ("a", 0.0, 2.8, 5), ("a", 10.0, 10.0, 1), ("b", 0.5, 0.5, 1),
    ]


@pytest.mark.parametrize("slots", [100_000, 3, 1])
def test_batch_equals_session_windows(spark, monkeypatch, slots):
    """Also when bursts run over many pieces of a root's history."""
    monkeypatch.setattr(watch, "_SLOTS_PER_PIECE", slots)
    rows = [(r, (i * i * 37 % 4001) / 10) for i in range(300) for r in ("a", "b")]
    frame = events(spark, *rows)
    want = (
        frame.groupBy("root", F.session_window("ts", "2 seconds"))
        .agg(F.max("ts").alias("last_at"), F.count("*").alias("n_events"))
        .withColumn("started_at", F.col("session_window.start"))
    )
    assert times(watch.change_bursts(frame, 2).collect()) == times(want.collect())


def test_stream_and_refresh(spark, tmp_path):
    source = tmp_path / "events"
    # The last event only moves the watermark past the earlier bursts.
    events(spark, *ROWS, ("z", 100)).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schemas.CHANGE_EVENT).parquet(str(source))
    emitted = watch.stream_bursts(stream)
    query = (
        emitted.writeStream.format("memory").queryName("bursts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = times(spark.table("bursts").collect())
    assert closed == times(watch.change_bursts(events(spark, *ROWS)).collect())

    calls = []
    stream = spark.readStream.schema(schemas.CHANGE_EVENT).parquet(str(source))
    query = watch.refresh_on_change(
        watch.stream_bursts(stream),
        lambda roots, batch: calls.append(sorted(r["root"] for r in roots.collect())),
        str(tmp_path / "c2"),
        available_now=True,
    )
    query.awaitTermination()
    assert sorted(r for call in calls for r in call) == ["a", "b"]


def wait_for(condition, query, seconds=90):
    import time

    end = time.time() + seconds
    while not condition():
        assert query.isActive and time.time() < end, query.exception() or "too slow"
        time.sleep(0.3)


def test_bursts_close_by_quiet_time(spark, tmp_path):
    """No later event is needed, and late events are counted."""
    source = tmp_path / "events"
    events(spark, *ROWS).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schemas.CHANGE_EVENT).parquet(str(source))
    query = (
        watch.quiet_bursts(stream, 2).writeStream.format("memory").queryName("quiet").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    )
    seen = lambda: spark.table("quiet").collect()
    try:
        wait_for(lambda: len(seen()) >= 3, query)
        assert times(seen()) == [("a", 0.0, 2.8, 5), ("a", 10.0, 10.0, 1), ("b", 0.5, 0.5, 1)]
        assert all(r["n_late"] == 0 for r in seen())
        # Two events of bursts that are closed, one of a new burst.
        events(spark, ("a", 2.9), ("a", 9.0), ("b", 30)).coalesce(1).write.mode("append").parquet(str(source))
        wait_for(lambda: len(seen()) >= 5, query)
        rows = times(seen())
        assert ("b", 30.0, 30.0, 1) in rows and ("a", 2.9, 9.0, 2) in rows
        assert [r["n_late"] for r in seen() if r["last_at"] == T0 + dt.timedelta(seconds=9)] == [2]
    finally:
        query.stop()


def book(path, title):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr(
            "c.opf",
            '<package xmlns:dc="d"><metadata><dc:title>' + title + "</dc:title><dc:creator>A B</dc:creator></metadata></package>",
        )


def tables(spark, folder, version):
    found = store.read_snapshot(spark, folder, version)
    return {name: sorted(map(str, table.drop("updated_at", "created_at", "fetched_at").collect())) for name, table in found.items()}


def test_a_folder_is_kept_as_a_snapshot(spark, tmp_path):
    """From changes to snapshot in one job: equal to a batch refresh; a repeated batch changes nothing."""
    library, folder, source = tmp_path / "lib", str(tmp_path / "store"), tmp_path / "events"
    now = F.lit(T0)
    book(library / "x" / "_one.epub", "One")
    book(library / "y" / "two.epub", "Two")
    (library / "y" / "two.txt").write_text("t")
    changed = lambda *roots: events(spark, *[(f"file://{r}", 0) for r in roots]).coalesce(1)
    changed(library, tmp_path / "elsewhere").write.parquet(str(source))

    def run():
        stream = spark.readStream.schema(schemas.CHANGE_EVENT).parquet(str(source))
        query = refresh.keep_catalog(stream, str(library), folder, str(tmp_path / "c"), available_now=True, now=now)
        query.awaitTermination()

    run()
    files = listing.scan_listing(spark, str(library))
    empty = Catalog(*[spark.createDataFrame([], s) for s in (schemas.ENTITY, schemas.MEMBER, schemas.PROVENANCE)])
    batch = refresh_catalog(files, packages.extract_metadata(listing.read_contents(files)), empty, now=now).catalog
    store.write_snapshot(
        {"entity": batch.entity, "member": batch.member, "provenance": batch.provenance, "rename_journal": spark.createDataFrame([], schemas.RENAME_JOURNAL)},
        str(tmp_path / "other"), 1, str(library), now,
    )
    first = tables(spark, folder, 1)
    assert first == tables(spark, str(tmp_path / "other"), 1) and len(first["member"]) == 3
    assert len(first["entity"]) == 2 and store.latest_version(spark, folder) == (1, str(library))

    # The same batch again: nothing is written.
    files_of = lambda: sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "store").rglob("*"))
    before = files_of()
    assert refresh.refresh_store(spark, str(library), [str(library)], folder, 1) is False
    assert files_of() == before

    # A change in one folder: only that one is listed again, and a vanished file is marked there.
    (library / "y" / "two.txt").unlink()
    (library / "x" / "_one.epub").unlink()
    book(library / "y" / "three.epub", "Three")
    changed(library / "y").write.mode("append").parquet(str(source))
    # What a failed attempt has left of version 2 is replaced.
    (tmp_path / "store" / "version=2" / "entity").mkdir(parents=True)
    (tmp_path / "store" / "version=2" / "entity" / "part-0.parquet").write_bytes(b"half a file")
    run()
    member = {r["path"].rsplit("/", 1)[1]: r["missing"] for r in store.read_snapshot(spark, folder, 2)["member"].collect()}
    assert member == {"_one.epub": False, "two.epub": False, "two.txt": True, "three.epub": False}
    assert tables(spark, folder, 1) == first
