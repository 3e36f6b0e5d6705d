"""Cases that share a block of state come out as each of them would alone."""

import numpy as np
import pandas as pd
import pytest

from casework.operators import replay
from casework.streaming import steps as live
from casework.streaming.run import drain

from .test_replay import random_cases
from .test_streaming import put
from .test_streaming_order import Clock, Handle, heartbeat, timed


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def random_steps(rng, cases, n, start=0):
    flags = {f: rng.random(n) < p for f, p in zip(live.FLAGS, (0.02, 0.3, 0.6, 0.8), strict=True)}
    seq = rng.integers(start, start + 30, n)
    return pd.DataFrame({"case_id": rng.integers(0, cases, n), "seq": seq, "event_ms": seq * 1000, **flags})


def told(frames):
    rows = pd.concat(frames).astype({"stall_count": "float64", "replan_count": "float64"}).fillna(-1)
    return sorted(rows[["case_id", "seq", "route", "stall_count", "replan_count"]].itertuples(index=False, name=None))


def alone(pieces):
    """Each case by itself, with what it was told before."""
    states, out = {}, []
    for piece in pieces:
        for case, part in piece.groupby("case_id"):
            states[case], routed = live.route_steps(states.get(case, (live.NEW, 0, 0, False)), part, 2, 2)
            out.append(routed.assign(case_id=case))
    return told(out)


@pytest.mark.parametrize("held", [7, 1 << 16])
def test_the_cases_of_a_block_take_a_few_calls(monkeypatch, held):
    monkeypatch.setattr(live, "HELD", held)
    rng = np.random.default_rng(4)
    pieces = [random_steps(rng, 300, 2_000, start) for start in (0, 30, 60)]
    router, handle = live.OrderedStepRouter(2, 2, 10_000), Handle()
    router.init(handle)
    calls, out = [], []
    loop = handle.made["loop"]
    put_back = loop.update
    loop.update = lambda value: calls.append(len(value[0])) or put_back(value)
    for at, piece in enumerate(pieces):
        assert list(router.handleInputRows((5,), iter([piece[:900], piece[900:]]), None)) == []
        assert handle.timers == {int(piece["event_ms"].min())}
        assert handle.made["waiting"].largest <= held * live.WAITING.itemsize
        handle.timers.clear()
        out += list(router.handleExpiredTimer((5,), Clock((at + 1) * 30_000 - 1), None))
    assert told(out) == alone(pieces)
    # One frame a bucket and one write a firing, whatever the number of cases.
    assert len(out) == 9 and len(calls) == 3 and not handle.made["waiting"].held and not handle.timers
    assert len({c for f in out for c in f["case_id"]}) == 300


def test_a_part_of_a_bucket_waits_on(monkeypatch):
    monkeypatch.setattr(live, "HELD", 11)
    piece = random_steps(np.random.default_rng(9), 20, 400)
    router, handle = live.OrderedStepRouter(2, 2, 3_600_000), Handle()
    router.init(handle)
    list(router.handleInputRows((0,), iter([piece]), None))
    out = []
    for mark in (4_000, 17_500, 40_000):
        handle.timers.clear()
        out += list(router.handleExpiredTimer((0,), Clock(mark), None))
        assert sum(map(len, out)) == (piece["event_ms"] <= mark).sum()
    assert told(out) == alone([piece]) and not handle.timers


def test_quiet_cases_are_forgotten_one_by_one():
    go = {"is_request_satisfied": False, "is_in_loop": False, "is_progress_being_made": True, "known_speaker": True}
    router, handle = live.StepRouter(2, 2, 100), Handle()
    router.init(handle)

    def routes(ms, *steps):
        rows = pd.DataFrame([{"case_id": c, "seq": s, **go} for c, s in steps])
        got = list(router.handleInputRows((3,), iter([rows]), Now(ms)))
        return [tuple(r) for f in got for r in f[["case_id", "route"]].itertuples(index=False)]

    assert routes(0, (1, 5), (2, 5)) == [(1, "dispatch"), (2, "dispatch")]
    assert routes(60, (1, 4)) == [(1, "late")]
    # Case 2 was quiet for 100 ms, case 1 for 40.
    assert routes(100, (1, 4), (2, 4)) == [(1, "late"), (2, "dispatch")]


def test_more_cases_than_blocks_equal_the_batch(spark, tmp_path):
    whole = timed(spark, random_cases(12, 60, 20))
    for blocks in (1, 7):
        arrived = str(tmp_path / f"in{blocks}")
        put(whole, arrived)
        put(heartbeat(spark, whole.schema, 30), arrived)
        stream = spark.readStream.schema(whole.schema).parquet(arrived)
        expected = {tuple(r) for r in replay.replay_trace(whole).collect()}
        for traced in (
            drain(live.stream_replay_any_order(stream, "ts", "40 minutes", blocks=blocks), "any", str(tmp_path / f"any{blocks}")),
            drain(live.stream_replay(stream, blocks=blocks), "ordered", str(tmp_path / f"ordered{blocks}")),
        ):
            got = [tuple(r) for r in traced.where("case_id >= 0").collect()]
            assert set(got) == expected and len(got) == len(expected)


def test_a_step_without_a_case_stays_without_one(spark, tmp_path):
    go = (False, False, True, True)
    schema = "case_id long, seq long, is_request_satisfied boolean, is_in_loop boolean, is_progress_being_made boolean, known_speaker boolean"
    put(spark.createDataFrame([(None, 0, *go), (0, 0, *go), (1 << 60 | 1, 0, *go)], schema), str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drain(live.stream_replay(stream, blocks=1), "nameless", str(tmp_path / "run")).collect()
    assert {(r.case_id, r.route) for r in got} == {(None, "dispatch"), (0, "dispatch"), (1 << 60 | 1, "dispatch")} and len(got) == 3
