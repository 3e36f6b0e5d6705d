"""Live cases: replay, enrich, audit and deduplicate steps as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import envelope as env
from ..operators.masterdata import enrich_vendors
from ..operators.replay import MAX_REPLANS, MAX_STALLS

TRACE_SCHEMA = "case_id bigint, seq bigint, route string, stall_count bigint, replan_count bigint"
ROUTES = np.array(["dispatch", "replan", "finalize:budget", "finalize:satisfied", "after_terminal", "late"], object)
FLAGS = ("is_request_satisfied", "is_in_loop", "is_progress_being_made", "known_speaker")
# Where a case stands: the last step seen, waiting steps in the open run, replans
# asked for, whether it has ended, and when (in ms) it was last heard of.
STATE = np.dtype([("case", "<i8"), ("last_seq", "<i8"), ("waiting", "<i8"), ("asked", "<i8"), ("over", "?"), ("heard", "<i8")])
NEW = -1 << 62
# Cases are dealt to so many blocks, each a key of the state. A call on the state or a
# frame costs as much for one step as for thousands, so it is made per block, not per
# case. A stream of many millions of cases wants more: a block's cases are one value.
BLOCKS = 1024
# The block of the steps without a case.
NO_CASE = -1


def route_cases(states: np.ndarray, case: np.ndarray, seq: np.ndarray, flags: np.ndarray, max_stalls: int, max_replans: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Route new steps of many cases, vectorised, given where each case stood before.

    ``states`` is one ``STATE`` per case by case, ``flags`` one row of booleans
    per step in the order of ``FLAGS``. Returned are the states, new cases
    among them, and the routed steps by case and ``seq``. Steps not above the
    last one of their case come out as ``late``.
    """
    order = np.lexsort((seq, case))
    case, seq, flags = case[order], seq[order], flags[order]
    met, of = np.unique(case, return_inverse=True)
    fresh = np.zeros(len(unseen := np.setdiff1d(met, states["case"])), STATE)
    fresh["case"], fresh["last_seq"] = unseen, NEW
    states = np.concatenate([states, fresh])
    states = states[np.argsort(states["case"], kind="stable")]
    row = np.searchsorted(states["case"], met)[of]  # the state of each step

    late = seq <= states["last_seq"][row]
    late[1:] |= (case[1:] == case[:-1]) & (seq[1:] == seq[:-1])
    routes = np.full(len(seq), len(ROUTES) - 1)
    stalls, replans = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
    untold = np.ones(len(seq), bool)
    row = row[~late]
    n = len(row)
    if n:
        satisfied, in_loop, progress, known = flags[~late].T
        stalled = in_loop | ~progress
        opens = np.append(True, row[1:] != row[:-1])
        first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        at = np.arange(n) - first + 1 + states["waiting"][row]
        restart = np.maximum.accumulate(np.where(stalled & known, -1, np.arange(n)))
        restarts = np.where(restart >= first, at[restart], 0)
        run = at - 1 - np.where(opens, 0, np.append(0, restarts[:-1]))
        stall = np.where(stalled, run % max(max_stalls, 1) + 1, 0)
        asks = ~satisfied & (~known | (stall >= max_stalls))
        asked = np.cumsum(asks)
        asked_by = states["asked"][row] + asked - (asked - asks)[first]
        spent = asks & (asked_by > max_replans)
        ends = satisfied | spent
        ended = np.cumsum(ends)
        ended -= (ended - ends)[first]
        over = states["over"][row] | (ended - ends > 0)
        routes[~late] = np.select([over, satisfied, spent, asks], [4, 3, 2, 1], 0)
        stalls[~late] = np.where(asks & ~spent, 0, stall)
        replans[~late] = np.minimum(asked_by, max_replans)
        untold[~late] = over
        last = np.flatnonzero(np.append(opens[1:], True))
        to = row[last]
        states["last_seq"][to], states["waiting"][to] = seq[~late][last], (at - restarts)[last]
        states["asked"][to], states["over"][to] = asked_by[last], states["over"][to] | (ended[last] > 0)
    out = pd.DataFrame({
        "case_id": case, "seq": seq, "route": ROUTES[routes],
        "stall_count": pd.arrays.IntegerArray(stalls, untold), "replan_count": pd.arrays.IntegerArray(replans, untold.copy()),
    })
    return states, out


def route_steps(
    state: tuple[int, int, int, bool], steps: pd.DataFrame, max_stalls: int, max_replans: int
) -> tuple[tuple[int, int, int, bool], pd.DataFrame]:
    """``route_cases`` for one case; ``state`` is ``(last_seq, waiting, asked, over)``."""
    held = np.array([(0, *state, 0)], STATE)
    flags = np.stack([steps[f].to_numpy(dtype=bool) for f in FLAGS], axis=1)
    held, out = route_cases(held, np.zeros(len(steps), np.int64), steps["seq"].to_numpy(dtype=np.int64), flags, max_stalls, max_replans)
    out = out.drop(columns="case_id").astype({"stall_count": "float64", "replan_count": "float64"})
    last_seq, waiting, asked, over = held[["last_seq", "waiting", "asked", "over"]][0].tolist()
    return (last_seq, waiting, asked, over), out


class _Router(StatefulProcessor):
    """Per block of cases: where each of them stands, as one packed array of 41 bytes a case."""

    max_stalls: int
    max_replans: int

    def _cases(self) -> np.ndarray:
        return np.frombuffer(self._state.get()[0], STATE) if self._state.exists() else np.zeros(0, STATE)

    def _routed(self, key, states: np.ndarray, case: np.ndarray, seq: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        states, routed = route_cases(states, case, seq, flags, self.max_stalls, self.max_replans)
        if key[0] == NO_CASE:
            routed["case_id"] = pd.array([None] * len(routed), "Int64")
        return states, routed

    def close(self) -> None:
        pass


class StepRouter(_Router):
    """Per case: four values of state and a time, whatever the length of its log.

    The rows of one block in one micro-batch are sorted in one task; a row is
    four flags and two numbers, and the trigger's admission limit bounds them.
    """

    def __init__(self, max_stalls: int = MAX_STALLS, max_replans: int = MAX_REPLANS, ttl_ms: int | None = None) -> None:
        self.max_stalls, self.max_replans, self.ttl_ms = max_stalls, max_replans, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("loop", "cases binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows), ignore_index=True)
        flags = np.stack([steps[f].to_numpy(dtype=bool) for f in FLAGS], axis=1)
        case = steps["case_id"].to_numpy(dtype=np.int64)
        states = self._cases()
        if self.ttl_ms:
            # The block is forgotten once all of its cases are quiet, each of them before.
            now = timerValues.getCurrentProcessingTimeInMs()
            states = states[states["heard"] + self.ttl_ms > now]
        states, routed = self._routed(key, states, case, steps["seq"].to_numpy(dtype=np.int64), flags)
        if self.ttl_ms:
            states["heard"][np.isin(states["case"], case)] = now
        self._state.update((states.tobytes(),))
        yield routed


def _blocks(steps: DataFrame, blocks: int, *more: Column) -> DataFrame:
    """``block, case_id, seq`` and the flags of each step; a step without a case is in a block of such steps."""
    case = F.col("case_id").cast("bigint")
    block = F.when(case.isNull(), F.lit(NO_CASE)).otherwise(F.pmod(F.xxhash64(case), F.lit(blocks))).cast("bigint")
    return steps.select(block.alias("block"), F.coalesce(case, F.lit(0)).alias("case_id"), "seq", *FLAGS, *more)


def stream_replay(
    steps: DataFrame, max_stalls: int = MAX_STALLS, max_replans: int = MAX_REPLANS, ttl_ms: int | None = None, blocks: int = BLOCKS
) -> DataFrame:
    """The trace of ``replay_trace`` as steps arrive; needs the RocksDB state store.

    Equal to the batch result for steps that arrive in ``seq`` order per case;
    a step at or below the last one seen is emitted as ``late`` and not folded.
    ``ttl_ms`` forgets cases that have been quiet for so long; it needs a
    repeating trigger, as an ``availableNow`` run with expiry does not end.
    Cases share their state in ``blocks``, whose number must stay the same over
    the restarts of a query.
    """
    return (
        _blocks(steps, blocks)
        .groupBy("block")
        .transformWithStateInPandas(
            statefulProcessor=StepRouter(max_stalls, max_replans, ttl_ms),
            outputStructType=TRACE_SCHEMA,
            outputMode="append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )


# Event time of a bucket of waiting rows: about as long as a key brings some thousands.
DAY_MS = 86_400_000
# Of a waiting step: its case, its number, its time in ms, and its four flags as bits.
WAITING = np.dtype([("case", "<i8"), ("seq", "<i8"), ("ms", "<i8"), ("flags", "u1")])
# Waiting steps in one value of the state; a bucket of more has several.
HELD = 1 << 16


class OrderedStepRouter(_Router):
    """Per block of cases: the state of ``StepRouter``, and the steps that wait for earlier ones.

    Waiting steps lie in buckets of event time, in packed arrays of 25 bytes a
    step, so a block of any size is taken in, ordered and folded one bucket at
    a time. One timer per block, at its earliest waiting step, fires once the
    watermark says that nothing earlier will come.
    """

    def __init__(self, max_stalls: int, max_replans: int, bucket_ms: int) -> None:
        self.max_stalls, self.max_replans, self.bucket_ms = max_stalls, max_replans, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("loop", "cases binary")
        self._waiting = handle.getMapState("waiting", "bucket bigint, part int", "steps binary")
        self._timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, ms: int | None) -> None:
        """One timer at ``ms``, none for None."""
        set_for = self._timer.get()[0] if self._timer.exists() else None
        if set_for == ms:
            return
        if set_for is not None:
            self._handle.deleteTimer(set_for)
            self._timer.clear()
        if ms is not None:
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def _hold(self, bucket: int, part: int, steps: np.ndarray) -> int:
        """Add steps to a bucket from its ``part`` on, the last of which is returned."""
        while len(steps):
            held = bytes(self._waiting.getValue((bucket, part))[0]) if self._waiting.containsKey((bucket, part)) else b""
            room = HELD - len(held) // WAITING.itemsize
            if room > 0:
                self._waiting.updateValue((bucket, part), (held + steps[:room].tobytes(),))
                steps = steps[room:]
            if len(steps):
                part += 1
        return part

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = self._timer.get()[0] if self._timer.exists() else None
        last: dict[int, int] = {}
        for part in rows:
            steps = np.empty(len(part), WAITING)
            steps["case"], steps["seq"], steps["ms"] = part.get("case_id", 0), part["seq"], part["event_ms"]
            steps["flags"] = sum(part[f].to_numpy(dtype=np.uint8) << i for i, f in enumerate(FLAGS))
            bucket = steps["ms"] // self.bucket_ms
            for b in np.unique(bucket).tolist():
                last[b] = self._hold(b, last.get(b, 0), steps[bucket == b])
            first = int(steps["ms"].min())
            earliest = first if earliest is None else min(earliest, first)
        self._wake(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self._timer.clear()
        parts: dict[int, list[int]] = {}
        for b, part in self._waiting.keys():
            parts.setdefault(b, []).append(part)
        states = self._cases()
        earliest = None
        for b in sorted(parts):
            held = [(b, part) for part in sorted(parts[b])]
            if b * self.bucket_ms > mark:
                # Only the first step of the first bucket that still waits matters.
                earliest = min(int(np.frombuffer(self._waiting.getValue(p)[0], WAITING)["ms"].min()) for p in held)
                break
            steps = np.concatenate([np.frombuffer(self._waiting.getValue(p)[0], WAITING) for p in held])
            ready = steps["ms"] <= mark
            if ready.any():
                for p in held:
                    self._waiting.removeKey(p)
                self._hold(b, 0, steps[~ready])
                told = steps[ready]
                flags = (told["flags"][:, None] >> np.arange(len(FLAGS), dtype=np.uint8) & 1).astype(bool)
                states, routed = self._routed(key, states, told["case"], told["seq"], flags)
                yield routed
            if not ready.all():
                earliest = int(steps["ms"][~ready].min())
                break
        self._state.update((states.tobytes(),))
        self._wake(earliest)


def stream_replay_any_order(
    steps: DataFrame, ts: str, lateness: str = "10 minutes", max_stalls: int = MAX_STALLS, max_replans: int = MAX_REPLANS,
    bucket_ms: int = DAY_MS, blocks: int = BLOCKS,
) -> DataFrame:
    """The trace of ``replay_trace`` of steps that arrive in any order; needs the RocksDB state store.

    ``seq`` follows the event time ``ts`` within a case. A step waits until
    the watermark, ``lateness`` behind the latest event time seen, has passed
    it; then it is folded in its place. What comes in behind the watermark is
    dropped by Spark and counted in the query's progress. A step whose ``seq``
    is not above the last one folded, a repeated one for example, comes out as
    ``late``. Steps ahead of the watermark keep waiting when a run ends and
    come out in a later one. Cases share their state in ``blocks``, whose
    number must stay the same over the restarts of a query.
    """
    time = F.col(ts).cast("timestamp")
    timed = _blocks(steps, blocks, F.unix_millis(time).alias("event_ms"), time.alias("event_time"))
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy("block")
        .transformWithStateInPandas(
            statefulProcessor=OrderedStepRouter(max_stalls, max_replans, bucket_ms),
            outputStructType=TRACE_SCHEMA,
            outputMode="append",
            timeMode="EventTime",
        )
    )


def stream_enrich(cases: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor lookup of arriving cases against a static table."""
    return enrich_vendors(cases, vendors)


def stream_audit(
    texts: DataFrame, text: str, source: str, ts: str, window: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Forged tags per event-time window and source: in append mode once a window has
    closed, in update mode as they change (see ``run.drain_upserts``)."""
    return (
        texts.select(F.col(ts).cast("timestamp").alias("_ts"), source, env.forged_tags(text).alias("_forged"))
        .withWatermark("_ts", lateness)
        .groupBy(F.window("_ts", window).alias("_w"), source)
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.count_if(F.col("_forged") > 0).alias("n_forged_texts"),
            F.sum("_forged").alias("forged_tags"),
        )
        .select(F.col("_w.start").alias("window_start"), source, "n_texts", "n_forged_texts", "forged_tags")
    )


def stream_dedup(steps: DataFrame, keys: tuple[str, ...], ts: str, lateness: str = "1 hour") -> DataFrame:
    """Drop a step delivered again within ``lateness``; later ones are too late to be told apart."""
    timed = steps.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))
