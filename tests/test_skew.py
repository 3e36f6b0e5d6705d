import random

import pytest
from pyspark.sql import functions as F

from casework.operators import registry, skew
from casework.operators.history import change_intervals, value_as_of
from casework.operators.skew import OrderedLog, fits_broadcast, lookup


@pytest.fixture
def facts(spark):
    """A third of the rows on one key, a third on none."""
    rng = random.Random(1)
    keys = ["hot"] * 300 + [None] * 300 + [rng.choice("abcdefgh") for _ in range(300)]
    rows = [(i, k, f"text {i}") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "id long, k string, body string")


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("hot", 1), ("a", 2), ("b", None), ("unused", 3)], "k string, v long")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup_equals_a_plain_join(facts, dim, how, shuffled_joins):
    expected = sorted(map(tuple, facts.join(dim, "k", how).select("id", "k", "body").collect()))
    for options in ({"broadcast_rows": 0, "rows_per_task": 50}, {"broadcast_rows": 0}, {}):
        got = lookup(facts, dim, "k", how, **options)
        assert sorted(map(tuple, got.select("id", "k", "body").collect())) == expected


def test_salted_lookup_on_two_keys(spark, facts, shuffled_joins):
    facts = facts.withColumn("p", F.col("id") % 2)
    dim = spark.createDataFrame([("hot", 0, "x"), ("hot", 1, "y"), ("a", 1, "z")], "k string, p long, v string")
    expected = sorted(map(str, facts.join(dim, ["k", "p"], "left").collect()))
    got = lookup(facts, dim, ["k", "p"], broadcast_rows=0, rows_per_task=40)
    assert sorted(map(str, got.select(*facts.join(dim, ["k", "p"], "left").columns).collect())) == expected


def partition_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_hot_and_null_keys_do_not_meet_in_one_task(spark, facts, dim, shuffled_joins):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = partition_sizes(facts.join(dim, "k", "left"))
        salted = partition_sizes(lookup(facts, dim, "k", broadcast_rows=0, rows_per_task=20))
        only_nulls = partition_sizes(lookup(facts.where("k is null"), dim, "k", broadcast_rows=0))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(plain) >= 300 and sum(salted) == 900
    assert max(salted) < 300
    assert len(only_nulls) == 4 and max(only_nulls) < 150


def test_size_check(spark):
    df = spark.range(100)
    assert fits_broadcast(df, rows=100) and not fits_broadcast(df, rows=99)
    assert not fits_broadcast(df, size=50) and not fits_broadcast(df, rows=0)


def random_log(seed, n_keys, longest):
    rng = random.Random(seed)
    rows = []
    for k in range(n_keys):
        places = sorted(rng.sample(range(10_000), rng.randint(1, longest)))
        rows += [(k, p, rng.randint(0, 3), rng.choice(["x", "y", None])) for p in places]
    return rows


LOG = "k long, seq long, n long, v string"


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 40, 6])
def test_ordered_scans_equal_plain_python(spark, rows_per_chunk):
    rows = random_log(2, 12, 100)
    log = OrderedLog.of(spark.createDataFrame(rows, LOG), "k", "seq", rows_per_chunk=rows_per_chunk)
    assert bool(log.chunks) == (rows_per_chunk < 1_000_000)
    odd = F.when(F.col("n") == 3, F.col("seq"))
    scanned = (
        log.running_sum("total", F.col("n"))
        .running_sum("before", F.col("n"), inclusive=False)
        .running_max("last3", odd)
        .neighbour({"prev_v": "v", "prev_seq": "seq"})
        .neighbour({"next_v": "v"}, ahead=True)
    )
    got = {(r.k, r.seq): (r.total, r.before, r.last3, r.prev_v, r.prev_seq, r.next_v) for r in scanned.result.collect()}
    expected = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == k)
        total, last3 = 0, None
        for i, (_, seq, n, _v) in enumerate(mine):
            before, total = total, total + n
            last3 = seq if n == 3 else last3
            prev = mine[i - 1] if i else None
            expected[k, seq] = (total, before, last3, prev and prev[3], prev and prev[1], mine[i + 1][3] if i + 1 < len(mine) else None)
    assert got == expected


def test_chunks_bound_the_rows_of_a_task(spark):
    rows = [(1, i if i < 4000 else i * 1000, 0, "x") for i in range(5000)] + [(2, 1, 0, "x")]
    log = OrderedLog.of(spark.createDataFrame(rows, LOG), "k", "seq", rows_per_chunk=200)
    sizes = [r["count"] for r in log.df.groupBy(*log.group).count().collect()]
    assert sum(sizes) == 5001 and max(sizes) <= 400


def sizes_of(log):
    return [r["count"] for r in log.df.groupBy(*log.group).count().collect()]


def test_cutting_goes_on_until_every_chunk_fits(spark):
    """Rows at powers of two: each round of few ranges splits off little."""
    rows = [(1, 1 << (i // 2), i, "x") for i in range(80)]
    log = OrderedLog.of(spark.createDataFrame(rows, LOG), "k", "seq", rows_per_chunk=40)
    assert max(sizes_of(log)) <= 40 and len(log.chunks) >= 4


def test_rows_at_one_moment_and_rows_without_a_key_are_cut(spark):
    rows = [(1, 7, i, "x") for i in range(1000)] + [(None, i, i % 3, "y") for i in range(1000)] + [(2, 1, 0, "x")]
    df = spark.createDataFrame(rows, LOG)
    log = OrderedLog.of(df, "k", "seq", rows_per_chunk=50)
    assert log.nulls and sum(sizes_of(log)) == 2001 and max(sizes_of(log)) <= 100
    got = log.running_sum("total", F.col("n")).neighbour({"prev": "seq"}).result.where("k is null").collect()
    assert sorted((r.seq, r.total, r.prev) for r in got)[999] == (999, sum(i % 3 for i in range(1000)), 998)
    probes = spark.createDataFrame([(i, 1, 7) for i in range(1000)] + [(5000 + i, None, 3) for i in range(200)], "id long, k long, seq long")
    seen = spark.createDataFrame([(1, 7, "new"), (1, 3, "old"), (None, 2, "none")], "k long, seq long, v string")
    values = {r.id: r.v for r in value_as_of(seen, probes, "k", "seq", "v", 10).collect()}
    assert values == {i: "new" for i in range(1000)} | {5000 + i: "none" for i in range(200)}


def test_many_hot_keys_are_joined_without_bringing_a_key_together(spark, facts, dim, shuffled_joins, monkeypatch):
    expected = sorted(map(str, facts.join(dim, "k", "left").collect()))
    monkeypatch.setattr(skew, "MAX_LISTED_KEYS", 0)
    got = lookup(facts, dim, "k", "left", broadcast_rows=0, rows_per_task=20)
    assert sorted(map(str, got.select("k", "id", "body", "v").collect())) == expected
    assert "_spread" in got._jdf.queryExecution().analyzed().toString()
    rows = random_log(3, 6, 80) + [(None, i, 1, "x") for i in range(60)]
    df = spark.createDataFrame(rows, LOG)
    plain = OrderedLog.of(df, "k", "seq").running_sum("t", F.col("n")).result.collect()
    cut = OrderedLog.of(df, "k", "seq", rows_per_chunk=15)
    assert max(sizes_of(cut)) <= 15
    assert sorted(map(str, cut.running_sum("t", F.col("n")).result.select("k", "seq", "n", "v", "t").collect())) == sorted(map(str, plain))


def test_counts_may_come_from_a_larger_table(spark):
    rows = random_log(4, 5, 60)
    df = spark.createDataFrame(rows, LOG)
    log = OrderedLog.of(df.where("n > 1"), "k", "seq", rows_per_chunk=10, counts_from=df)
    assert log.chunks and log.df.count() == len([r for r in rows if r[2] > 1])


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 5])
def test_change_intervals(spark, rows_per_chunk):
    seen = [(0, "x"), (3, "x"), (5, None), (6, None), (9, "y"), (12, "x")]
    df = spark.createDataFrame([(1, s, v) for s, v in seen] + [(2, 4, None)], "k long, seq long, v string")
    got = sorted(map(tuple, change_intervals(df, "k", "seq", "v", rows_per_chunk).collect()), key=str)
    assert got == [(1, 0, 5, "x"), (1, 12, None, "x"), (1, 5, 9, None), (1, 9, 12, "y"), (2, 4, None, None)]


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 5])
def test_value_as_of_equals_plain_python(spark, rows_per_chunk):
    rows = random_log(6, 6, 50)
    rng = random.Random(9)
    probes = [(i, rng.randint(0, 7), rng.choice(rows)[1] if rng.random() < 0.5 else rng.randint(0, 10_000)) for i in range(300)]
    got = {
        r.id: r.v
        for r in value_as_of(
            spark.createDataFrame(rows, LOG), spark.createDataFrame(probes, "id long, k long, seq long"), "k", "seq", "v", rows_per_chunk
        ).collect()
    }
    def plain(k, at):
        known = [r for r in rows if r[0] == k and r[1] <= at]
        return max(known)[3] if known else None

    assert got == {i: plain(k, at) for i, k, at in probes}


def test_known_flag_spreads_like_a_lookup(spark, facts, dim):
    names = dim.select(F.col("k").alias("name"))
    flagged = registry.with_known_worker(facts, names, "k", "known", broadcast_rows=0, rows_per_task=50)
    assert flagged.where("known").count() == facts.where("k in ('hot', 'a', 'b')").count()
    assert flagged.count() == 900
