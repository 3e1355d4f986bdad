"""Session settings and the shared folder for materialized intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans in this package are written for. None of them changes a result.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins here put a per-key table (one row per key) against a large side, so splitting a
    # skewed key is always possible; allow it even when a later stage then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Archives travel to Python as bytes; a batch is limited by size, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    # Streaming state with timers needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "16g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioframe")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder the cluster names in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="folioframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Whatever is written inside leaves no shuffle files behind; else they stay until the driver collects its garbage.

    For writes only: a DataFrame that is collected inside cannot be collected again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._folioframe_path = path
    return table


def same_table(view: DataFrame, table: DataFrame) -> DataFrame:
    """Mark ``view`` as a projection of a materialized table, so that it can be discarded."""
    view._folioframe_path = table._folioframe_path
    return view


def discard(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` once nothing reads it any more."""
    path = getattr(table, "_folioframe_path", None)
    if path is None:
        return
    jvm = table.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(
        target, True
    )
