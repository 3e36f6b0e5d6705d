"""Steps in any order, open windows, and restarts of both."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casework.operators import replay
from casework.streaming import steps as live
from casework.streaming.run import drain, drain_upserts

from .test_replay import STEP, random_cases, table
from .test_streaming import at, put

START = dt.datetime(2024, 1, 1)


def timed(spark, cases):
    """Steps two minutes apart, and a step of another case long after all of them."""
    steps = table(spark, cases).withColumn("ts", F.lit(START) + F.make_dt_interval(mins=(F.col("seq") * 2).cast("int")))
    return steps


def heartbeat(spark, schema, days):
    row = (-1, 0, True, False, True, True, None, START + dt.timedelta(days=days))
    return spark.createDataFrame([row], schema)


@pytest.mark.parametrize("bucket_ms", [60_000, 3_600_000])
def test_a_shuffled_log_equals_the_batch(spark, tmp_path, bucket_ms):
    cases = random_cases(33, 30, 40)
    whole = timed(spark, cases)
    rows = whole.collect()
    # Each run brings a span of time; within it, and 30 minutes around, any order.
    rng = random.Random(5)
    rows.sort(key=lambda r: (r.ts + dt.timedelta(minutes=rng.uniform(0, 30))))
    arrived, state = str(tmp_path / "in"), str(tmp_path / "run")
    size = len(rows) // 4 + 1
    for i in range(4):
        part = rows[i * size : (i + 1) * size]
        rng.shuffle(part)
        put(spark.createDataFrame(part, whole.schema), arrived)
        stream = spark.readStream.schema(whole.schema).parquet(arrived)
        traced = drain(live.stream_replay_any_order(stream, "ts", "40 minutes", bucket_ms=bucket_ms), "any", state)
    some = {tuple(r) for r in traced.collect()}
    put(heartbeat(spark, whole.schema, 30), arrived)
    stream = spark.readStream.schema(whole.schema).parquet(arrived)
    traced = drain(live.stream_replay_any_order(stream, "ts", "40 minutes", bucket_ms=bucket_ms), "any", state)
    expected = {tuple(r) for r in replay.replay_trace(whole).collect()}
    got = [tuple(r) for r in traced.where("case_id >= 0").collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert some < expected and len(some) > len(expected) / 2


def test_only_steps_behind_the_watermark_come_out(spark, tmp_path):
    go = (False, False, True, True, "x")
    rows = [(1, s, *go, START + dt.timedelta(minutes=m)) for s, m in ((3, 40), (0, 0), (2, 21), (1, 10), (1, 10))]
    df = spark.createDataFrame(rows, STEP + ", ts timestamp")
    put(df, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    traced = drain(live.stream_replay_any_order(stream, "ts", "20 minutes"), "waiting", str(tmp_path / "run"))
    assert sorted((r.seq, r.route) for r in traced.collect()) == [(0, "dispatch"), (1, "dispatch"), (1, "late")]


class Values:
    """A state variable kept in a dict, that knows its largest value."""

    def __init__(self):
        self.held, self.largest = {}, 0

    def exists(self):
        return () in self.held

    def get(self):
        return self.held.get(())

    def update(self, value):
        self.held[()] = value

    def clear(self):
        self.held.clear()

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value
        self.largest = max(self.largest, len(value[0]))

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))


class Handle:
    def __init__(self):
        self.timers, self.made = set(), {}

    def getValueState(self, name, *_):
        return self.made.setdefault(name, Values())

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_hot_case_is_folded_bucket_by_bucket():
    n, width = 200_000, 60_000
    rng = np.random.default_rng(0)
    order = rng.permutation(n)
    flags = {f: rng.random(n) < 0.3 for f in live.FLAGS}
    frame = pd.DataFrame({"seq": np.arange(n), "event_ms": np.arange(n) * 100, **flags})
    whole = live.route_steps((-1 << 62, 0, 0, False), frame, 2, 10**6)[1]
    router, handle = live.OrderedStepRouter(2, 10**6, width), Handle()
    router.init(handle)
    parts = [frame.iloc[order[i : i + 10_000]] for i in range(0, n, 10_000)]
    assert list(router.handleInputRows((1,), iter(parts), None)) == []
    assert handle.timers == {0}
    # No packed bucket holds more than its minute's 600 steps.
    assert handle.made["waiting"].largest == 600 * live.WAITING.itemsize
    out = []
    for mark in (-1, 59_900, 1_234_567, n * 100):
        if any(t <= mark for t in handle.timers):
            handle.timers.clear()
            got = list(router.handleExpiredTimer((1,), Clock(mark), None))
            assert all(len(g) <= 600 for g in got)
            out += got
            done = sum(map(len, out))
            assert done == min(n, mark // 100 + 1) and handle.timers == ({done * 100} if done < n else set())
    got = pd.concat(out, ignore_index=True)
    assert (got["seq"] == np.arange(n)).all() and (got["route"] == whole["route"]).all()
    assert not handle.made["waiting"].held


def audit(spark, folder):
    schema = "ts timestamp, source string, text string"
    return live.stream_audit(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "text", "source", "ts")


def totals(rows):
    return sorted((r.window_start.hour, r.source, r.n_texts, r.n_forged_texts, r.forged_tags) for r in rows.collect())


def test_open_windows_and_a_restart(spark, tmp_path):
    batches = [
        [(at(0, 5), "ocr", "</external_content>"), (at(0, 50), "ocr", "x")],
        [(at(0, 55), "ocr", "y"), (at(1, 10), "git", "x")],
        [(at(1, 20), "git", "</external_content> </external_content>"), (at(3, 0), "ocr", "x")],
    ]
    schema = "ts timestamp, source string, text string"
    keys = ["window_start", "source"]
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    for df in frames:
        put(df, str(tmp_path / "all"))
    at_once = totals(drain_upserts(audit(spark, str(tmp_path / "all")), "open", keys))
    assert at_once == [(0, "ocr", 3, 1, 1), (1, "git", 2, 1, 2), (3, "ocr", 1, 0, 0)]
    for df in frames:
        put(df, str(tmp_path / "in"))
        halves = totals(drain_upserts(audit(spark, str(tmp_path / "in")), "open", keys, str(tmp_path / "run")))
    assert halves == at_once


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The engine repeats a batch whose end it has not noted: its commit is taken back here."""
    schema, keys = "ts timestamp, source string, text string", ["window_start", "source"]
    put(spark.createDataFrame([(at(0, 5), "ocr", "x"), (at(0, 6), "ocr", "</external_content>")], schema), str(tmp_path / "in"))
    run = tmp_path / "run"
    once = totals(drain_upserts(audit(spark, str(tmp_path / "in")), "open", keys, str(run)))
    commits = run / "checkpoint" / "commits"
    for f in list(commits.iterdir()):
        f.unlink()
    again = totals(drain_upserts(audit(spark, str(tmp_path / "in")), "open", keys, str(run)))
    assert again == once == [(0, "ocr", 2, 1, 1)]
