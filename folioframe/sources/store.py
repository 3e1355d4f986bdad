"""Versioned catalog snapshots in plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.maintenance import clear_dangling, rebase

TABLES = ["entity", "member", "provenance", "rename_journal"]


def write_snapshot(
    tables: dict[str, DataFrame], store: str, version: int, root: str, now: Column | None = None
) -> None:
    """Write all tables of one version; its manifest row comes last and makes it visible.

    A version that has its manifest is never written again; what a failed attempt has left of one is replaced.
    """
    spark = next(iter(tables.values())).sparkSession
    if has_version(spark, store, version):
        raise ValueError(f"version {version} is there already")
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{store}/version={version}/{name}")
    stamp = F.current_timestamp() if now is None else now
    spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(root).alias("root"), stamp.alias("written_at")
    ).write.mode("overwrite").parquet(f"{store}/_manifests/version={version}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return target.getFileSystem(conf).exists(target)


def has_version(spark: SparkSession, store: str, version: int) -> bool:
    """Whether a version is complete."""
    return _exists(spark, f"{store}/_manifests/version={version}/_SUCCESS")


def latest_version(spark: SparkSession, store: str, before: int | None = None) -> tuple[int, str] | None:
    """(version, root) of the newest complete snapshot, of those under ``before`` if it is given."""
    if not _exists(spark, f"{store}/_manifests"):
        return None
    manifests = spark.read.option("recursiveFileLookup", True).parquet(f"{store}/_manifests")
    if before is not None:
        manifests = manifests.filter(F.col("version") < before)
    row = manifests.agg(F.max_by(F.struct("version", "root"), "version").alias("m")).first()
    return (row["m"]["version"], row["m"]["root"]) if row["m"] else None


def read_snapshot(spark: SparkSession, store: str, version: int) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{store}/version={version}/{name}") for name in TABLES}


def restore_if_empty(
    spark: SparkSession,
    current: dict[str, DataFrame],
    store: str,
    root: str,
    assets: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], bool]:
    """(tables, restored): the newest snapshot, but only into an empty catalog.

    Paths move to ``root`` when the snapshot was written for another one; cover references
    without a file in ``assets`` are cleared.
    """
    if not (current["entity"].isEmpty() and current["member"].isEmpty()):
        return current, False
    found = latest_version(spark, store)
    if found is None:
        return current, False
    version, old_root = found
    tables = read_snapshot(spark, store, version)
    if old_root != root:
        tables["member"], tables["rename_journal"] = rebase(
            tables["member"], tables["rename_journal"], old_root, root
        )
    if assets is not None:
        tables["entity"] = clear_dangling(tables["entity"], assets)
    return tables, True
