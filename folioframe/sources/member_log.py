"""Member rows laid out by path, of which each version writes only those that changed.

The rows of all versions are one table, partitioned by version and bucketed by path. The newest row of a path counts, so
a version is read without a shuffle, and a listing is compared with it by a shuffle of the listing alone. A rescan that
changes nothing writes nothing. ``whole`` versions hold every row, and reading starts at the last of them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.schemas import MEMBER
from folioframe.session import discard, materialize
from folioframe.sources.store import _exists


def _columns(spark: SparkSession) -> list[str]:
    return spark.createDataFrame([], MEMBER).columns


def create(spark: SparkSession, folder: str, buckets: int | None = None) -> None:
    """Lay out an empty log; ``buckets`` is the number of shuffle partitions by default.

    With fewer buckets than shuffle partitions Spark may shuffle the members after all.
    """
    if _exists(spark, f"{folder}/layout"):
        raise ValueError(f"{folder} holds a log already")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/layout")


def _table(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Name and buckets of the session's table over the folder; its versions are looked up anew."""
    buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    name = "member_log_" + hashlib.sha256(folder.encode()).hexdigest()[:16]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], MEMBER).schema)
    location = f"{folder}/rows".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({fields}, removed boolean, version bigint) USING parquet "
        f"PARTITIONED BY (version) CLUSTERED BY (path) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    if _exists(spark, f"{folder}/rows"):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name, buckets


def versions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """(version, whole) of all complete versions in order."""
    if not _exists(spark, f"{folder}/manifests"):
        return []
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/manifests").orderBy("version").collect()
    return [(r["version"], r["whole"]) for r in rows]


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The members of the newest complete version, or of the newest that is not above ``version``.

    A log without any complete version has no members.
    """
    known = [(v, whole) for v, whole in versions(spark, folder) if version is None or v <= version]
    columns = _columns(spark)
    if not known:
        return spark.createDataFrame([], MEMBER)
    first = max((v for v, whole in known if whole), default=known[0][0])
    used = [v for v, _ in known if v >= first]
    name, _ = _table(spark, folder)
    values = F.struct("removed", *[c for c in columns if c != "path"])
    newest = spark.table(name).filter(F.col("version").isin(used)).groupBy("path").agg(F.max_by(values, "version").alias("m"))
    return newest.filter(~F.col("m.removed")).select(*["path" if c == "path" else F.col(f"m.{c}").alias(c) for c in columns])


def write(members: DataFrame, folder: str, version: int, whole: bool = False) -> bool:
    """Write ``members``, one row for each path, as ``version``; False if nothing is to be written.

    Only rows that differ from the newest version are written, and a mark for each path that is gone. ``whole`` writes
    every row, which shortens later reads. A version that is complete is never written again; what a failed attempt has
    left of one is replaced. Versions must rise.
    """
    spark = members.sparkSession
    known = [v for v, _ in versions(spark, folder)]
    if version in known:
        return False
    if known and version < known[-1]:
        raise ValueError(f"version {version} is older than {known[-1]}")
    columns = _columns(spark)
    row = F.struct(*columns)
    after = members.select("path", row.alias("new"))
    if whole:
        rows = after.select("new.*", F.lit(False).alias("removed"))
    else:
        before = read(spark, folder).select("path", row.alias("old"))
        rows = (
            after.join(before, "path", "full_outer")
            .filter(~F.col("new").eqNullSafe(F.col("old")))
            .withColumn("row", F.coalesce("new", "old"))
            .select("row.*", F.col("new").isNull().alias("removed"))
        )
    rows = materialize(rows)
    try:
        if not whole and rows.isEmpty():
            return False
        name, buckets = _table(spark, folder)
        spark.sql(
            f"INSERT OVERWRITE TABLE {name} PARTITION (version = {int(version)}) SELECT * FROM {{rows}}",
            rows=rows.repartition(buckets, "path"),
        )
    finally:
        discard(rows)
    manifest = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(whole).alias("whole"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/version={version}")
    return True
