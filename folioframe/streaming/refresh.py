"""Refresh of a stored catalog from a stream of changes, as one job from folder to snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioframe import schemas
from folioframe.operators.snapshot import snapshot_diff, to_extract
from folioframe.plans.refresh import Catalog, refresh_catalog
from folioframe.session import configure
from folioframe.sources import listing, packages, store


# With more changed folders than this the whole library is listed again.
MANY_ROOTS = 100


def _below(path: Column, roots: list[str]) -> Column:
    """Whether a path lies in one of the folders."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | path.startswith(root.rstrip("/") + "/")
    return inside


def _catalog(spark: SparkSession, folder: str, before: int) -> dict[str, DataFrame]:
    """Tables of the newest complete version under ``before``; empty ones if there is none."""
    found = store.latest_version(spark, folder, before)
    if found:
        return store.read_snapshot(spark, folder, found[0])
    kinds = {"entity": schemas.ENTITY, "member": schemas.MEMBER, "provenance": schemas.PROVENANCE, "rename_journal": schemas.RENAME_JOURNAL}
    return {name: spark.createDataFrame([], schema) for name, schema in kinds.items()}


def refresh_store(
    spark: SparkSession,
    library: str,
    roots: list[str],
    folder: str,
    version: int,
    overrides: DataFrame | None = None,
    tagged: DataFrame | None = None,
    now: Column | None = None,
) -> bool:
    """Write ``version`` of the catalog in ``folder`` after changes in ``roots``; False if it is there already.

    ``roots`` (the library or folders of it) are listed again; what the catalog has elsewhere stays as it is. Added and
    updated files are read and the catalog is refreshed from its newest version before this one. The manifest comes
    last: a version that was cut short has none and is written anew.
    """
    if store.has_version(spark, folder, version):
        return False
    library = listing.plain_path(library).rstrip("/")
    roots = sorted({listing.plain_path(r).rstrip("/") for r in roots})
    # A folder inside another one is listed with it.
    outer = [r for r in roots if not any(r != o and r.startswith(o + "/") for o in roots)]
    if len(outer) > MANY_ROOTS:
        outer = [library]
    tables = _catalog(spark, folder, version)
    member = tables["member"]
    present = member.filter(~F.col("missing") & ~_below(F.col("path"), outer))
    files = present.select("path", "format", "size_bytes", "modified_at")
    for root in outer:
        files = files.unionByName(listing.scan_listing(spark, root).select(*files.columns))
    changed = to_extract(snapshot_diff(files, member)).select("path", "format")
    metadata = packages.extract_metadata(listing.read_contents(changed), tagged)
    catalog = Catalog(tables["entity"], member, tables["provenance"])
    result = refresh_catalog(files, metadata, catalog, overrides, now, only_touched=True)
    written = {
        "entity": result.catalog.entity,
        "member": result.catalog.member,
        "provenance": result.catalog.provenance,
        "rename_journal": tables["rename_journal"],
    }
    store.write_snapshot(written, folder, version, library, now)
    return True


def keep_catalog(
    changes: DataFrame,
    library: str,
    folder: str,
    checkpoint: str,
    first_version: int = 1,
    available_now: bool = False,
    overrides: DataFrame | None = None,
    now: Column | None = None,
) -> StreamingQuery:
    """Keep the catalog in ``folder`` up to date with a stream of changes (``root``, and any other columns).

    ``changes`` are events or closed bursts; a micro-batch says which folders of the library to list again, a folder
    outside it is ignored. Version ``first_version`` + batch id is what the batch leaves, so a batch that is run again
    after a failure finds its version and does nothing. Start a new checkpoint with a ``first_version`` above those in
    the store. Micro-batches follow each other, so refreshes never overlap.
    """
    inside = listing.plain_path(library).rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = configure(batch.sparkSession)
        path = F.regexp_replace(F.regexp_replace("root", "^file:/+", "/"), "/+$", "")
        known = batch.select(path.alias("root")).filter((F.col("root") == inside) | _below(F.col("root"), [inside]))
        # Distinct changed folders of one batch: their number is that of the folders, not of the events.
        roots = [r["root"] for r in known.distinct().collect()]
        if roots:
            refresh_store(spark, inside, roots, folder, first_version + batch_id, overrides, now=now)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
