import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casework.streaming.run import drain
from casework.streaming.versions import stream_lookup_versions

from .test_streaming import put

CASES = "case_id long, vendor_id string, ts timestamp, note string"
CHANGES = "vendor_id string, name string, ts timestamp"
START = dt.datetime(2024, 5, 1)


def minute(m):
    return START + dt.timedelta(minutes=m)


def run(spark, tmp_path, batches, lateness="30 minutes", parts=3, bucket_ms=600_000):
    """Each batch brings cases and changes in any order; the last rows come after all others."""
    for cases, changes in batches:
        put(spark.createDataFrame(cases, CASES), str(tmp_path / "cases"))
        put(spark.createDataFrame(changes, CHANGES), str(tmp_path / "changes"))
        arriving = spark.readStream.schema(CASES).parquet(str(tmp_path / "cases"))
        known = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "changes"))
        found = stream_lookup_versions(arriving, known, "vendor_id", "ts", lateness, parts, bucket_ms, out="vendor")
        table = drain(found, "versions", str(tmp_path / "run"))
    return table


def test_a_vendor_changed_during_the_stream_shows_from_then_on(spark, tmp_path):
    first = ([(1, "DE1", minute(5), "a\tb\nc"), (2, "DE2", minute(6), None), (3, None, minute(7), "x")], [("DE1", "old", minute(0))])
    second = ([(4, "DE1", minute(25), "n"), (5, "DE1", minute(20), "n")], [("DE1", "new", minute(20)), ("DE2", "late", minute(10))])
    end = ([(99, "DE9", minute(500), "end")], [])
    rows = run(spark, tmp_path, [first, second, end]).collect()
    got = {r.case_id: (r.vendor and r.vendor.name, r.note, r.ts) for r in rows}
    assert got == {
        1: ("old", "a\tb\nc", minute(5)), 2: (None, None, minute(6)), 3: (None, "x", minute(7)),
        4: ("new", "n", minute(25)), 5: ("new", "n", minute(20)),
    }
    assert len(rows) == 5 and rows[0].asDict().keys() == {"case_id", "vendor_id", "ts", "note", "vendor"}


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_arrival_equals_an_as_of_lookup(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["hot"] * 5 + ["a", "b", "stranger"]
    cases = [(i, rng.choice(names), minute(rng.randint(0, 300)), "n") for i in range(300)]
    changes = [(rng.choice(["hot", "a", "b"]), f"v{i}", minute(rng.randint(-5, 300))) for i in range(60)]
    arrivals = [[], [], [], []]
    for kind, rows in (("case", cases), ("change", changes)):
        for row in rows:
            # Up to 60 minutes late, which the watermark allows for.
            at = (row[2] - START).total_seconds() / 60 + rng.uniform(0, 60)
            arrivals[min(3, int(max(at, 0) // 90))].append((kind, row))
    batches = [([r for k, r in part if k == "case"], [r for k, r in part if k == "change"]) for part in arrivals]
    batches.append(([(999, "x", minute(5000), "end")], []))
    rows = run(spark, tmp_path, batches, "160 minutes").collect()
    want = {}
    for i, vendor, ts, _ in cases:
        known = [(t, name) for v, name, t in changes if v == vendor and t <= ts]
        last = max((t for t, _ in known), default=None)
        want[i] = {name for t, name in known if t == last} or {None}
    assert len(rows) == len(cases) and all((r.vendor and r.vendor.name) in want[r.case_id] for r in rows)
