"""Ordinals and lists when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators.ranking import collect_in_parts, number_rows, rank_in_group


def skewed(spark, n=3000):
    """Two thirds of the rows share one key."""
    key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97))
    return spark.range(0, n, 1, 7).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("v"))


def test_number_rows(spark):
    rows = [r["v"] for r in skewed(spark).collect()]
    got = {r["v"]: r["n"] for r in number_rows(skewed(spark), ["v"], "n", start=10).collect()}
    assert got == {v: i for i, v in enumerate(sorted(rows), 11)}
    assert number_rows(skewed(spark).limit(0), ["v"], "n").count() == 0


def test_rank_paths_agree(spark):
    frame = skewed(spark)
    window = rank_in_group(frame, ["k"], ["v"], "r").collect()
    spread = rank_in_group(frame, ["k"], ["v"], "r", window_limit=0).collect()
    assert sorted(window) == sorted(spread)
    hot = sorted(r["r"] for r in spread if r["k"] == "hot")
    assert hot == list(range(1, 2001))


def test_collect_in_parts(spark):
    frame = skewed(spark)
    rows = collect_in_parts(frame, ["k"], F.col("v"), ["v"], "vs", page_items=100).collect()
    hot = [r for r in rows if r["k"] == "hot"]
    hot.sort(key=lambda r: r["part"])
    assert [r["part"] for r in hot] == list(range(20)) and all(len(r["vs"]) == 100 for r in hot)
    together = [v for r in hot for v in r["vs"]]
    assert together == sorted(together)
    assert all(r["part"] == 0 for r in rows if r["k"] != "hot")
    assert all(r["vs"] == sorted(r["vs"]) for r in rows)
    assert sorted(v for r in rows for v in r["vs"]) == sorted(r["v"] for r in frame.collect())
