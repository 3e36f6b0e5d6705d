"""Look arriving cases up in master data that arrives too, as it was at each case's time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.skew import row_hash
from .steps import DAY_MS

FOUND_SCHEMA = "body string, record string"


class VersionedLookup(StatefulProcessor):
    """Per key: the versions of its record, and the cases that wait for theirs.

    A case waits until the watermark has passed its time, as only then all
    versions before it are known; then it takes the last one. Cases wait in
    buckets of event time, one of them in memory at a time. Of the versions
    behind the watermark only the last is kept.
    """

    def __init__(self, bucket_ms: int) -> None:
        self.bucket_ms = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._versions = handle.getMapState("versions", "ms bigint", "record string")
        self._waiting = handle.getMapState("waiting", "bucket bigint", "cases string")
        self._timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, ms: int | None) -> None:
        set_for = self._timer.get()[0] if self._timer.exists() else None
        if set_for == ms:
            return
        if set_for is not None:
            self._handle.deleteTimer(set_for)
            self._timer.clear()
        if ms is not None:
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def _forget(self, mark: int) -> None:
        """Drop versions that no case to come can take."""
        behind = sorted(ms for (ms,) in self._versions.keys() if ms <= mark)
        waiting = min((b * self.bucket_ms for (b,) in self._waiting.keys()), default=mark + 1)
        if waiting > mark:
            for ms in behind[:-1]:
                self._versions.removeKey((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = self._timer.get()[0] if self._timer.exists() else None
        for part in rows:
            changes = part[part["is_change"]]
            for ms, record in zip(changes["event_ms"].tolist(), changes["body"].tolist(), strict=True):
                # Of two versions of one moment the larger text counts, in any order of arrival.
                held = self._versions.getValue((ms,))[0] if self._versions.containsKey((ms,)) else ""
                self._versions.updateValue((ms,), (max(held, record),))
            cases = part[~part["is_change"]]
            if len(cases):
                lines = cases["event_ms"].astype(str) + "\t" + cases["body"]
                for bucket, some in lines.groupby(cases["event_ms"] // self.bucket_ms):
                    b = int(bucket)
                    held = self._waiting.getValue((b,))[0] + "\n" if self._waiting.containsKey((b,)) else ""
                    self._waiting.updateValue((b,), (held + "\n".join(some),))
                first = int(cases["event_ms"].min())
                earliest = first if earliest is None else min(earliest, first)
        self._forget(timerValues.getCurrentWatermarkInMs())
        self._wake(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self._timer.clear()
        versions = sorted(ms for (ms,) in self._versions.keys())
        at, record, earliest = 0, None, None
        for b in sorted(b for (b,) in self._waiting.keys()):
            cases = [(int(ms), body) for ms, body in (line.split("\t", 1) for line in self._waiting.getValue((b,))[0].split("\n"))]
            ready = sorted(c for c in cases if c[0] <= mark)
            rest = [c for c in cases if c[0] > mark]
            if rest:
                self._waiting.updateValue((b,), ("\n".join(f"{ms}\t{body}" for ms, body in rest),))
                earliest = min(ms for ms, _ in rest)
            else:
                self._waiting.removeKey((b,))
            out = []
            for ms, body in ready:
                while at < len(versions) and versions[at] <= ms:
                    record = self._versions.getValue((versions[at],))[0]
                    at += 1
                out.append((body, record))
            if out:
                yield pd.DataFrame(out, columns=["body", "record"])
            if earliest is not None:
                break
        self._forget(mark)
        self._wake(earliest)

    def close(self) -> None:
        pass


def stream_lookup_versions(
    cases: DataFrame,
    changes: DataFrame,
    on: str,
    ts: str,
    lateness: str = "10 minutes",
    parts: int = 16,
    bucket_ms: int = DAY_MS,
    out: str = "record",
) -> DataFrame:
    """``cases`` with ``record``: all columns of the row of ``changes`` for its
    ``on`` that was the last at the case's ``ts``, null if there was none.

    Both are streams with ``on`` and ``ts``; a change counts from its ``ts``
    on. A case comes out once the watermark, ``lateness`` behind the latest
    time of both, has passed it, so changes may arrive later than cases they
    hold for. Cases without a key come out at once. The cases of one key are
    dealt over ``parts``, each with a copy of the key's changes, so a key with
    most cases is no single task. Needs the RocksDB state store; columns
    travel as JSON, so binary ones are not kept.
    """
    def told(df: DataFrame, is_change: bool, part) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        time = F.col(ts).cast("timestamp")
        return df.select(F.col(on).cast("string").alias("key"), part.alias("part"), time.alias("event_time"), F.lit(is_change).alias("is_change"), body.alias("body"))

    dealt = F.pmod(row_hash(cases), F.lit(parts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    keyed = told(cases.where(F.col(on).isNotNull()), False, dealt)
    both = keyed.unionByName(told(changes.where(F.col(on).isNotNull()), True, copies))
    found = (
        both.withWatermark("event_time", lateness)
        .withColumn("event_ms", F.unix_millis("event_time"))
        .groupBy("key", "part")
        .transformWithStateInPandas(
            statefulProcessor=VersionedLookup(bucket_ms), outputStructType=FOUND_SCHEMA, outputMode="append", timeMode="EventTime"
        )
    )
    case, record = F.from_json("body", cases.schema), F.from_json("record", changes.schema)
    found = found.select(case.alias("c"), record.alias(out)).select("c.*", out)
    alone = cases.where(F.col(on).isNull()).withColumn(out, F.lit(None).cast(changes.schema))
    return found.unionByName(alone)
