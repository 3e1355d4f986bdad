"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters, one set for each partition, name the digests that may be frequent; an exact count verifies
them. The verified winners, at most ``1 / SHARE`` plus the counters' error, are broadcast, so their rows are settled
where they are and never meet in one task. All other digests are grouped by ordinary shuffling.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import materialize

COUNTERS = 1024
# A digest is heavy if it makes up this share of all rows.
SHARE = 1 / 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _count_frequent(batches):
    """Misra-Gries over one partition: at most ``COUNTERS`` digests with counts that are low by at most ``lost``."""
    counts, lost, rows = {}, 0, 0
    for batch in batches:
        rows += len(batch)
        grouped = pc.value_counts(batch.column("text_sha256"))
        for digest, count in zip(grouped.field("values").to_pylist(), grouped.field("counts").to_pylist()):
            counts[digest] = counts.get(digest, 0) + count
        if len(counts) > COUNTERS:
            # Taking the (COUNTERS + 1)-th largest count from all of them leaves COUNTERS at most.
            cut = sorted(counts.values(), reverse=True)[COUNTERS]
            lost += cut
            counts = {d: c - cut for d, c in counts.items() if c > cut}
    yield pa.RecordBatch.from_pydict(
        {"text_sha256": list(counts), "low": list(counts.values()), "lost": [lost] * len(counts)},
        pa.schema([("text_sha256", pa.string()), ("low", pa.int64()), ("lost", pa.int64())]),
    )


def heavy_digests(digests: DataFrame) -> DataFrame:
    """(text_sha256, heavy_keep, heavy_size) of every digest with at least ``SHARE`` of all rows, exactly.

    A digest's count is low by at most rows / (COUNTERS + 1) over all partitions, so what may reach the share is what
    reaches it less that error: fewer than ``1 / (SHARE - 1 / (COUNTERS + 1))`` candidates, however large the table.
    """
    rows = digests.count()
    least = rows * SHARE
    candidates = (
        digests.select("text_sha256")
        .mapInArrow(_count_frequent, "text_sha256 string, low long, lost long")
        .groupBy("text_sha256")
        .agg(F.sum("low").alias("low"))
        .filter(F.col("low") >= least - rows / (COUNTERS + 1))
        .select("text_sha256")
    )
    return (
        digests.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("heavy_keep"), F.count(F.lit(1)).alias("heavy_size"))
        .filter((F.col("heavy_size") >= least) & (F.col("heavy_size") > 1))
    )


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): which row of equal texts stays.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays; of rows that repeat that id all are marked kept. A row without id stays only where no row of
    its group has one. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), _UPPER, _LOWER)
    digests = materialize(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    )
    heavy = materialize(heavy_digests(digests))
    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    settled = marked.filter(F.col("heavy_size").isNotNull()).select(
        "doc_id", F.col("heavy_keep").alias("keep_id"), F.col("heavy_size").alias("group_size"), "text_sha256"
    )
    rest = marked.filter(F.col("heavy_size").isNull()).select("doc_id", "text_sha256")
    groups = rest.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return (
        rest.join(groups, "text_sha256")
        .select("doc_id", "keep_id", "group_size", "text_sha256")
        .union(settled)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
