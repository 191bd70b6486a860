"""Suppression of images as they are settled: a missing window, time-outs, repeated windows and batches that run again."""

import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from masklake.operators import suppression
from masklake.streaming import stateful

WINDOWS = "image_id bigint, window_id string, n_windows bigint"


def test_settled_images(spark, tmp_path):
    rng = random.Random(3)
    preds = [(k % 6, k, rng.random(), x := rng.randint(0, 60), x + 20, y := rng.randint(0, 60), y + 20) for k in range(300)]
    run_table = spark.createDataFrame(preds, "image_id bigint, pred_id bigint, score double, c0 bigint, c1 bigint, r0 bigint, r1 bigint")
    arrivals = [
        [(0, "a", 2), (0, "b", 2), (1, "a", 2), (2, "a", 3), (2, "a", 3), (3, "a", 1)],
        [(1, "b", 2), (3, "a", 1), (2, "b", 3), (5, "a", 2), (4, "a", 1)],
        [(2, "c", 3), (4, "b", 1), (0, "a", 2)],
    ]

    def arrive(rows, timeout=None):
        spark.createDataFrame(rows, WINDOWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(WINDOWS).parquet(str(tmp_path / "in"))
        progress = stateful.window_progress(stream, timeout)
        return stateful.merge_settled(progress, lambda: run_table, str(tmp_path / "out"), str(tmp_path / "state"), once=timeout is None, dedup_iou=0.3, extent=128)

    def settled():
        rows = spark.read.parquet(str(tmp_path / "out")).select("image_id", "complete").distinct().collect()
        return sorted((r.image_id, r.complete) for r in rows)

    arrive(arrivals[0]).awaitTermination()
    assert settled() == [(0, True), (3, True)]
    arrive(arrivals[1]).awaitTermination()
    assert settled() == [(0, True), (1, True), (3, True), (4, True)]
    arrive(arrivals[2]).awaitTermination()  # windows that come again, or after their image was settled, change nothing
    assert settled() == [(k, True) for k in range(5)]
    want = {(r.image_id, r.pred_id) for r in suppression.suppress(run_table.where("image_id < 5"), 0.3, extent=128).collect()}
    read = lambda: sorted((r.image_id, r.pred_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == sorted(want)
    batch = spark.read.parquet(str(tmp_path / "out")).where("image_id = 4").select("batch").first()[0]
    mine = [r.image_id for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("batch") == batch).select("image_id").distinct().collect()]
    again = spark.createDataFrame([(k, 1, True) for k in mine] * 2, "image_id bigint, windows bigint, complete boolean")
    stateful.merge_batch(again, batch, run_table, str(tmp_path / "out"), dedup_iou=0.3, extent=128)
    assert read() == sorted(want)


def test_an_image_without_all_windows_times_out(spark, tmp_path):
    run_table = spark.createDataFrame([(7, 1, 0.5, 0, 9, 0, 9), (7, 2, 0.4, 0, 9, 0, 8), (8, 3, 0.1, 0, 9, 0, 9)],
                                      "image_id bigint, pred_id bigint, score double, c0 bigint, c1 bigint, r0 bigint, r1 bigint")
    spark.createDataFrame([(7, "a", 2), (8, "a", 1)], WINDOWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    progress = stateful.window_progress(spark.readStream.schema(WINDOWS).parquet(str(tmp_path / "in")), timeout="1 second")
    query = stateful.merge_settled(progress, lambda: run_table, str(tmp_path / "out"), str(tmp_path / "state"), once=False, dedup_iou=0.3, extent=16)
    end, got = time.time() + 90, []
    while len(got) < 2 and time.time() < end:
        time.sleep(1)
        if list((tmp_path / "out").glob("batch=*/_SUCCESS")):
            got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("image_id", "pred_id", "complete").collect()))
    query.stop()
    assert got == [(7, 1, False), (8, 3, True)]


class FakeStates:
    """State of one image in plain values; counts the calls."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, [], 0

    def getMapState(self, *_):
        return FakeMap(self)

    def getValueState(self, *_):
        return FakeValue(self)

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class FakeMap:
    def __init__(self, states):
        self.states = states

    def __getattr__(self, name):
        held = self.states.map
        self.states.calls += 1
        return {"containsKey": lambda k: k in held, "getValue": held.get, "updateValue": held.__setitem__, "clear": held.clear}[name]


class FakeValue:
    def __init__(self, states):
        self.states = states

    def __getattr__(self, name):
        self.states.calls += 1
        return {"exists": lambda: self.states.value is not None, "get": lambda: self.states.value,
                "update": lambda v: setattr(self.states, "value", v)}[name]


def test_state_calls_do_not_follow_the_windows():
    """An image takes two calls when its windows come at once; else a batch takes at most two for each part of the map that it meets."""
    def feed(tracker, windows, planned):
        return [tuple(r) for r in tracker.handleInputRows((5,), iter([Row(image_id=5, window_id=w, n_windows=planned) for w in windows]), None)]

    names = [f"r{k}" for k in range(9)]
    states = FakeStates()
    tracker = stateful.WindowTracker(None)
    tracker.init(states)
    assert feed(tracker, [*names, None, "r1"], 9) == [(5, 9, True)] and states.calls == 2
    assert feed(tracker, names, 9) == [] and states.calls == 3

    states = FakeStates()
    tracker.init(states)
    assert feed(tracker, names[:5], 9) == [] and states.calls == 3
    assert feed(tracker, [*names[2:5], None], 9) == [] and states.calls == 5
    assert feed(tracker, names[4:], 9) == [(5, 9, True)] and states.calls == 9 and not states.map

    many = [f"w{k}" for k in range(3000)]  # seen a hundred at a time, every batch with ten seen before; the plan grows on the way
    rng = random.Random(1)
    rng.shuffle(many)
    states = FakeStates()
    tracker.init(states)
    for a in range(0, 2900, 100):
        assert feed(tracker, many[max(0, a - 10):a + 100], 2000 if a < 1000 else 3000) == []
    assert max(len(v[0]) for v in states.map.values()) < 100 and sum(len(v[0]) for v in states.map.values()) == 2900
    assert feed(tracker, many[2890:], 3000) == [(5, 3000, True)] and not states.map
