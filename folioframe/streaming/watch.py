"""Change events: bursts that close after a quiet gap, and refreshes they trigger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

DEFAULT_GAP_SECONDS = 1


# Time slots per piece of a root's history.
_SLOTS_PER_PIECE = 100_000


def _close_gaps(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Join spans (first, last, n) of a key that lie no further apart than the gap."""
    by_time = Window.partitionBy(*keys).orderBy("first")
    starts = F.coalesce(F.col("first") - F.lag("last").over(by_time) > gap, F.lit(True))
    numbered = spans.withColumn("starts", starts.cast("int")).withColumn(
        "burst", F.sum("starts").over(by_time)
    )
    return numbered.groupBy(*keys, "burst").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")
    )


def change_bursts(events: DataFrame, gap_seconds: int = DEFAULT_GAP_SECONDS) -> DataFrame:
    """Bursts of a table of events (root, ts): (root, started_at, last_at, n_events).

    A burst ends when no event follows within the gap (an event exactly one gap later still
    belongs to it, as in session windows). Events of one gap-long time slot always belong to one
    burst, so they are combined before the shuffle. The history of a root is then closed piece by
    piece; only the outer bursts of every piece can continue in the next one, and only those are
    looked at per root.
    """
    gap = gap_seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = (
        events.select("root", micros.alias("us"))
        .groupBy("root", F.floor(F.col("us") / gap).alias("slot"))
        .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))
        .withColumn("piece", F.floor(F.col("slot") / _SLOTS_PER_PIECE))
    )
    last_of_piece = F.max("burst").over(Window.partitionBy("root", "piece"))
    closed = _close_gaps(slots, ["root", "piece"], gap).withColumn(
        "outer", (F.col("burst") == 1) | (F.col("burst") == last_of_piece)
    )
    spans = ["root", "first", "last", "n"]
    across = _close_gaps(closed.filter("outer").select(*spans), ["root"], gap)
    return (
        closed.filter(~F.col("outer"))
        .select(*spans)
        .unionByName(across.select(*spans))
        .select(
            "root",
            F.timestamp_micros("first").alias("started_at"),
            F.timestamp_micros("last").alias("last_at"),
            F.col("n").alias("n_events"),
        )
    )


def stream_bursts(
    events: DataFrame,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    late_seconds: int | None = None,
) -> DataFrame:
    """The same over a stream of events (root, ts): one row per burst once it has closed.

    Append mode needs a watermark: a burst is emitted when it has passed, and events later than
    ``late_seconds`` (default: the gap) are dropped.
    """
    late = gap_seconds if late_seconds is None else late_seconds
    return (
        events.withWatermark("ts", f"{late} seconds")
        .groupBy("root", F.session_window("ts", f"{gap_seconds} seconds"))
        .agg(F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_events"))
        .select("root", F.col("session_window.start").alias("started_at"), "last_at", "n_events")
    )


_BURST = "root string, started_at timestamp, last_at timestamp, n_events long, n_late long"


class _Debounce(StatefulProcessor):
    """The open burst of a root, and the time (in microseconds) of the last event of the burst before it."""

    def __init__(self, gap_seconds: float):
        self.gap = int(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, late long")
        self.closed = handle.getValueState("closed", "last long")

    def _emit(self, key, burst: tuple) -> pd.DataFrame:
        first, last, n, late = burst
        self.closed.update((max(last, self.closed.get()[0]) if self.closed.exists() else last,))
        at = lambda us: pd.Timestamp(us, unit="us")
        return pd.DataFrame(
            {"root": [key[0]], "started_at": [at(first)], "last_at": [at(last)], "n_events": [n], "n_late": [late]}
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = self.closed.get()[0] + self.gap if self.closed.exists() else None
        burst = tuple(self.open.get()) if self.open.exists() else None
        spans = sorted(
            span for part in rows for span in zip(part["first"].tolist(), part["last"].tolist(), part["n"].tolist())
        )
        for first, last, n in spans:
            late = n if closed is not None and last <= closed else 0
            if burst is None:
                burst = (first, last, n, late)
            elif late or first - burst[1] <= self.gap:
                apart = late or burst[0] - last > self.gap
                burst = (min(first, burst[0]), max(last, burst[1]), burst[2] + n, burst[3] + (n if apart else 0))
            else:
                yield self._emit(key, burst)
                closed, burst = burst[1] + self.gap, (first, last, n, 0)
        self.open.update(burst)
        # Any event starts the quiet time anew.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, self.gap // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._emit(key, tuple(self.open.get()))
            self.open.clear()


def _slots(gap: int):
    """Events of an Arrow batch as spans: one row for each root and gap-long time slot."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us = batch["us"]
            yield us.groupby([batch["root"], us // gap], dropna=False).agg(["min", "max", "count"]).reset_index(level=0).set_axis(
                ["root", "first", "last", "n"], axis=1
            )

    return combine


def quiet_bursts(events: DataFrame, gap_seconds: float = DEFAULT_GAP_SECONDS) -> DataFrame:
    """Bursts of a stream of events (root, ts) that close by quiet time: (root, started_at, last_at, n_events, n_late).

    A burst closes when the root has been quiet for the gap, by the clock; no later event is needed to move a
    watermark. An event that is more than the gap after the last one of an open burst closes it at once. Events that
    arrive for a burst that has been reported, or that lie more than the gap before the open one, are late: they count
    in the burst that is open (or open one) and in its ``n_late``, and none is dropped. Events without a time are
    ignored.

    Events of a batch are combined per root and time slot before the shuffle. The state of a root is one small row.
    Needs the RocksDB state store (``configure`` sets it) and output mode ``Update``.
    """
    gap = int(gap_seconds * 1_000_000)
    spans = (
        events.select("root", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        .filter(F.col("us").isNotNull())
        .mapInPandas(_slots(gap), "root string, first long, last long, n long")
    )
    return spans.groupBy("root").transformWithStateInPandas(
        _Debounce(gap_seconds), outputStructType=_BURST, outputMode="Update", timeMode="ProcessingTime"
    )


def refresh_on_change(
    bursts: DataFrame,
    refresh: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Call ``refresh(roots, batch_id)`` once per micro-batch with the roots that changed.

    Micro-batches run one after the other and whatever arrives meanwhile is in the next one, so
    refreshes never overlap. The stream only says which roots to list again; added, changed and
    vanished files come from comparing listings.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        roots = batch.select("root").distinct()
        if not roots.isEmpty():
            refresh(roots, batch_id)

    writer = bursts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
