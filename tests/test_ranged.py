"""Ordered scans over ranges told from marks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from casework.operators.skew import OrderedLog

LOG = "k long, seq long, n long, v string"


def uneven_log(seed):
    rng = random.Random(seed)
    rows = []
    for k in [None, 0, 1, 2, 3]:
        many = 400 if k in (None, 0) else rng.randint(1, 30)
        places = {int(2 ** rng.uniform(0, 40)) - 5 for _ in range(many)}
        rows += [(k, p, rng.randint(0, 3), rng.choice(["x", "y", None])) for p in places]
    return rows


@pytest.mark.parametrize(("rows_per_chunk", "marks"), [(7, 64), (40, 8), (100, 64)])
def test_scans_equal_plain_python(spark, monkeypatch, rows_per_chunk, marks):
    monkeypatch.setattr("casework.operators.skew.MARKS", marks)
    rows = uneven_log(2)
    log = OrderedLog.ranged(spark.createDataFrame(rows, LOG).repartition(5), "k", "seq", rows_per_chunk=rows_per_chunk)
    sizes = {(r["_cut"], r["k"]): r["count"] for r in log.df.groupBy("_cut", "k").count().collect()}
    assert {k for cut, k in sizes if cut} >= {None, 0}
    assert max(r["count"] for r in log.df.groupBy(*log.group).count().collect()) <= 3 * rows_per_chunk
    scanned = (
        log.running_sum("total", F.col("n"))
        .running_sum("before", F.col("n"), inclusive=False)
        .running_max("last3", F.when(F.col("n") == 3, F.col("seq")))
        .neighbour({"prev_v": "v", "prev_seq": "seq"})
        .neighbour({"next_v": "v"}, ahead=True)
    )
    assert set(scanned.result.columns) == {"k", "seq", "n", "v", "total", "before", "last3", "prev_v", "prev_seq", "next_v"}
    got = {(r.k, r.seq): (r.total, r.before, r.last3, r.prev_v, r.prev_seq, r.next_v) for r in scanned.result.collect()}
    expected = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        total, last3 = 0, None
        for i, (_, seq, n, _v) in enumerate(mine):
            before, total = total, total + n
            last3 = seq if n == 3 else last3
            prev = mine[i - 1] if i else None
            expected[k, seq] = (total, before, last3, prev and prev[3], prev and prev[1], mine[i + 1][3] if i + 1 < len(mine) else None)
    assert got == expected


def test_rows_at_one_moment_are_dealt_and_stay_between_their_neighbours(spark):
    rows = [(1, s, 1, "before") for s in range(50)] + [(1, 50, 1, f"at {i}") for i in range(500)] + [(1, 51 + s, 1, "after") for s in range(50)]
    log = OrderedLog.ranged(spark.createDataFrame(rows, LOG), "k", "seq", rows_per_chunk=20)
    sizes = [r["count"] for r in log.df.groupBy(*log.group).count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 60
    got = log.running_sum("total", F.col("n")).result.collect()
    by = {v: sorted(r.total for r in got if r.v.split()[0] == v) for v in ("before", "at", "after")}
    assert by["before"] == list(range(1, 51)) and by["after"] == list(range(551, 601))
    assert min(by["at"]) > 50 and max(by["at"]) == 550


def test_ties_order_rows_at_one_moment(spark):
    rows = [(1, 7, n, None) for n in range(300)]
    log = OrderedLog.ranged(spark.createDataFrame(rows, LOG), "k", "seq", ties=("n",), rows_per_chunk=16)
    assert [(r.n, r.total) for r in log.running_sum("total", F.lit(1).cast("bigint")).result.orderBy("n").collect()] == [(n, n + 1) for n in range(300)]


def test_no_job_before_the_one_that_uses_the_result(spark):
    df = spark.createDataFrame(uneven_log(3), LOG)
    spark.sparkContext.setJobGroup("ranged", "building")
    log = OrderedLog.ranged(df, "k", "seq", rows_per_chunk=7).running_sum("total", F.col("n")).neighbour({"prev": "seq"})
    assert log.result.columns and not spark.sparkContext.statusTracker().getJobIdsForGroup("ranged")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    small = spark.range(10).selectExpr("id as k", "id as seq")
    assert not OrderedLog.ranged(small, "k", "seq").chunks and OrderedLog.ranged(df.limit(0), "k", "seq", rows_per_chunk=7).result.count() == 0
