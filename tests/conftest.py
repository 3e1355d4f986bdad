from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioframe import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        "4g",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate one Column function over single-column inputs."""
    from pyspark.sql import functions as F

    def run(function, values, type_="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
        out = rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in out]

    return run
