"""Incremental forms: merging an image once its windows are in, and following growing logs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from masklake.operators import suppression
from masklake.session import discard, materialize

STATE_TIMEOUT = GroupStateTimeout


def append_partial_results(stream: DataFrame, path: str, checkpoint: str, run: str):
    """Appends arriving raw instances to the table of a run, so that partial output can be read any time.

    The batch number is a partition that a replayed batch overwrites, which keeps the table free of doubles.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(availableNow=True).start())


def complete_images(instances: DataFrame, windows: DataFrame) -> DataFrame:
    """Images of which every planned window has arrived; `windows(image_id, window_id)` is the tile plan."""
    planned = windows.groupBy("image_id").agg(F.count_distinct("window_id").alias("planned"))
    seen = instances.groupBy("image_id").agg(F.count_distinct("window_id").alias("seen"))
    return planned.join(seen, "image_id").where("seen >= planned").select("image_id")


class WindowTracker(StatefulProcessor):
    """Follows the windows of an image: those seen, in the parts of a map, their number, and a flag that stays once the image is settled.

    A part holds about `PART` windows, so a batch of windows costs at most a look-up and a write for each of the parts it meets, however many
    windows the image has. An image whose windows come in one batch is settled without the map. A window that comes again, or after its image is
    settled, changes nothing.
    """

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen_parts", "part bigint", "windows array<string>")
        self.progress = handle.getValueState("progress", "seen bigint, planned bigint, parts bigint, complete boolean")

    def _settle(self, key: tuple, number: int, planned: int, complete: bool) -> Row:
        self.progress.update((number, planned, 0, complete))
        return Row(image_id=key[0], windows=number, complete=complete)

    def _no_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.progress.get()  # every call asks the state store, so one value tells all but the windows
        if held and held[3] is not None:
            return
        number, planned, parts = held[:3] if held else (0, 0, 0)
        arrived = set()
        for row in rows:
            arrived.add(row.window_id)
            planned = max(planned, row.n_windows or 0)
        arrived.discard(None)
        parts = parts or max(1, -(-planned // PART))  # as first planned, so that a window keeps its part
        by_part: dict[int, set] = {}
        for window in arrived:
            by_part.setdefault(zlib.crc32(window.encode()) % parts, set()).add(window)
        grown = {}
        for part, windows in by_part.items():
            before = self.seen.getValue((part,)) if held else None
            before = before[0] if before else []
            fresh = windows.difference(before)
            if fresh:
                number += len(fresh)
                grown[part] = [*before, *sorted(fresh)]
        if self.wait_ms and held:
            self._no_timers()
        if planned and number >= planned:
            if held:
                self.seen.clear()
            yield self._settle(key, number, planned, True)
            return
        for part, windows in grown.items():
            self.seen.updateValue((part,), (windows,))
        if grown or not held or planned > held[1]:
            self.progress.update((number, planned, parts, None))
        if self.wait_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.progress.get()
        if not held or held[3] is not None:
            return
        self.seen.clear()
        yield self._settle(key, held[0], held[1], False)

    def close(self) -> None:
        pass


#: Windows to a part of the map of an image.
PART = 32
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_progress(stream: DataFrame, timeout: str | None = "10 minutes") -> DataFrame:
    """Emits an image once: when all its windows have arrived, or as incomplete when none came for `timeout` of processing time
    (None waits without end, and lets a query over finished input end).

    `stream(image_id, window_id, n_windows)` has one row per finished window. The state of an image is its window ids in a map, bounded by its
    tile plan, and afterwards one flag; instances themselves stay in the run table and are merged from there. Maps and timers need the
    state store in RocksDB, which is set for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    wait_ms = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else None
    slim = stream.select("image_id", F.col("window_id").cast("string").alias("window_id"), F.col("n_windows").cast("bigint").alias("n_windows"))
    return slim.groupBy("image_id").transformWithState(
        WindowTracker(wait_ms), "image_id bigint, windows bigint, complete boolean", "append", "ProcessingTime" if timeout else "None")


def merge_batch(settled: DataFrame, number: int, instances: DataFrame, path: str, *, dedup_iou: float, maxdets: int = 0, extent: int | None = None) -> None:
    """Suppresses the instances of the images that one micro-batch settled, and writes the kept ones as that batch.

    A batch that runs again overwrites its own folder, so a restart neither loses nor doubles an image.
    """
    images = materialize(settled.select("image_id", "complete").dropDuplicates(["image_id"]), "settled-images")
    # a batch that settles nothing writes its folder without a pass over the run table
    mine = instances.limit(0) if images.isEmpty() else instances.join(images, "image_id", "left_semi")
    kept = suppression.suppress(mine, dedup_iou, maxdets=maxdets, extent=extent)
    kept.join(images, "image_id").write.mode("overwrite").parquet(f"{path}/batch={number}")
    discard(images)


def merge_settled(progress: DataFrame, instances, path: str, checkpoint: str, once: bool = True, **limits):
    """Writes to `path` the kept predictions `(image_id, pred_id, score, complete, batch)` of every image that `progress` settles.

    `instances()` gives the run table `(image_id, pred_id, score, c0, c1, r0, r1)` as it is when a batch runs; all windows of a settled
    image are in it by then. With `once` the query ends with its input; a query that waits for time-outs runs until it is stopped.
    """
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
    return (progress.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger)
            .foreachBatch(lambda batch, number: merge_batch(batch, number, instances(), path, **limits)).start())


def forward_progress(stream: DataFrame) -> DataFrame:
    """Rows of a growing log whose epoch exceeds every earlier one of the run; repeats and regressions go.

    `stream(run, epoch)`. The state of a run is one number; within a micro-batch rows count in epoch order.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else -1
        fresh: set[int] = set()
        for batch in batches:  # the pieces of a micro-batch come in no order
            fresh.update(int(e) for e in batch["epoch"].dropna().unique() if e > high)
        if fresh:
            state.update((max(fresh),))
            yield pd.DataFrame({"run": [key[0]] * len(fresh), "epoch": sorted(fresh)})

    slim = stream.select("run", "epoch")
    return slim.groupBy("run").applyInPandasWithState(
        update, "run string, epoch bigint", "high bigint", "append", STATE_TIMEOUT.NoTimeout)


def best_metric(stream: DataFrame) -> DataFrame:
    """Best value per run and metric of a live log, `(run, name, best)`, for update or complete mode.

    A keyed maximum (minimum for losses) is all the state there is.
    """
    signed = F.when(F.col("mode") == "min", -F.col("value")).otherwise(F.col("value"))
    return (stream.groupBy("run", "name", "mode").agg(F.max(signed).alias("s"))
            .select("run", "name", F.when(F.col("mode") == "min", -F.col("s")).otherwise(F.col("s")).alias("best")))
