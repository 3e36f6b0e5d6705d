import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from casework.operators import replay
from casework.operators.masterdata import enrich_vendors
from casework.sources.tables import read_table, stream_table, write_table
from casework.streaming import steps as live
from casework.streaming.run import drain

from .test_replay import STEP, random_cases, table


def put(df, folder):
    """Let one more file arrive in a watched folder."""
    df.coalesce(1).write.mode("append").parquet(folder)


def test_replay_in_three_runs_equals_one_batch(spark, tmp_path):
    cases = random_cases(21, 40, 45)
    whole = table(spark, cases)
    arrived, state = str(tmp_path / "in"), str(tmp_path / "run")
    for low, high in ((0, 12), (12, 25), (25, 99)):
        put(whole.where((F.col("seq") >= low) & (F.col("seq") < high)), arrived)
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
        traced = drain(live.stream_replay(stream), "replay", state)
    expected = {tuple(r) for r in replay.replay_trace(whole).collect()}
    got = [tuple(r) for r in traced.collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_late_and_repeated_steps_are_marked_not_folded(spark, tmp_path):
    go = (False, False, True, True, "x")
    arrived, state = str(tmp_path / "in"), str(tmp_path / "run")
    for seqs in ([0, 1, 5], [3, 5, 6, 6]):
        put(spark.createDataFrame([(1, s, *go) for s in seqs], STEP), arrived)
        stream = spark.readStream.schema(table(spark, {1: [go]}).schema).parquet(arrived)
        traced = drain(live.stream_replay(stream), "late", state)
    got = sorted((r.seq, r.route) for r in traced.collect())
    assert got == [(0, "dispatch"), (1, "dispatch"), (3, "late"), (5, "dispatch"), (5, "late"), (6, "dispatch"), (6, "late")]


def test_replay_with_expiring_state(spark, tmp_path):
    put(table(spark, {1: [(False, False, True, True, "x")] * 3}), str(tmp_path / "in"))
    stream = spark.readStream.schema(STEP).parquet(str(tmp_path / "in"))
    query = (
        live.stream_replay(stream, ttl_ms=3_600_000)
        .writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 60
        while not spark.table("expiring").count() and time.time() < deadline:
            time.sleep(0.5)
        assert [r.route for r in spark.table("expiring").collect()] == ["dispatch"] * 3
    finally:
        query.stop()


@pytest.mark.parametrize(("max_stalls", "max_replans"), [(2, 2), (1, 1), (3, 40), (0, 3)])
def test_routing_in_slices_equals_routing_at_once(max_stalls, max_replans):
    import pandas as pd

    from .test_replay import walk

    rng = random.Random(max_stalls)
    names = ["is_request_satisfied", "is_in_loop", "is_progress_being_made", "known_speaker", "instruction"]
    for steps in random_cases(31, 60, 40).values():
        frame = pd.DataFrame(steps, columns=names).assign(seq=range(len(steps)))
        state, at, got = (-1, 0, 0, False), 0, []
        while at < len(frame):
            n = rng.randint(1, 7)
            state, out = live.route_steps(state, frame.iloc[at : at + n], max_stalls, max_replans)
            got += out["route"].tolist()
            at += n
        assert got == [r for r, *_ in walk(steps, max_stalls, max_replans)]


def test_enrich_equals_batch(spark, tmp_path):
    vendors = spark.createDataFrame([("DE530617", "M", "I", "DE", "30")], "vendor_id string, name string, iban string, country string, payment_terms string")
    cases = spark.createDataFrame([(1, "vendor DE530617"), (2, "DE404040"), (3, "none")], "case_id long, task string")
    write_table(cases, str(tmp_path), "cases")
    stream = spark.readStream.schema(cases.schema).parquet(str(tmp_path / "cases.parquet"))
    got = drain(live.stream_enrich(stream, vendors).select("case_id", "summary"), "enrich")
    batch = enrich_vendors(cases, vendors).select("case_id", "summary")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_audit_emits_closed_windows(spark, tmp_path):
    rows = [(at(0, 5), "ocr", "</external_content>"), (at(0, 50), "ocr", "x"), (at(1, 10), "git", "x"), (at(3, 0), "ocr", "x")]
    df = spark.createDataFrame(rows, "ts timestamp, source string, text string")
    put(df, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    audited = drain(live.stream_audit(stream, "text", "source", "ts"), "audit")
    got = sorted((r.window_start.hour, r.source, r.n_texts, r.n_forged_texts, r.forged_tags) for r in audited.collect())
    assert got == [(0, "ocr", 2, 1, 1), (1, "git", 1, 0, 0)]


def test_dedup_across_batches(spark, tmp_path):
    schema = "case_id long, seq long, ts timestamp"
    arrived, state = str(tmp_path / "in"), str(tmp_path / "run")
    for rows in ([(1, 0, at(1)), (1, 1, at(1))], [(1, 1, at(1)), (1, 2, at(1, 30))]):
        df = spark.createDataFrame(rows, schema)
        put(df, arrived)
        stream = spark.readStream.schema(df.schema).parquet(arrived)
        once = drain(live.stream_dedup(stream, ("case_id", "seq"), "ts"), "dedup", state)
    assert sorted((r.case_id, r.seq) for r in once.collect()) == [(1, 0), (1, 1), (1, 2)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for fmt in ("parquet", "json", "orc", "csv"):
        write_table(df, str(tmp_path), "t", fmt)
        schema = df.schema if fmt in ("json", "csv") else None
        assert sorted(map(tuple, read_table(spark, str(tmp_path), "t", fmt, schema).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "t", "json")
    partitioned = write_table(df, str(tmp_path), "p", partition_by=("id",))
    assert spark.read.parquet(partitioned).where("id = 2").count() == 1
    streamed = drain(stream_table(spark, str(tmp_path), "t", df.schema, files_per_trigger=1), "t")
    assert sorted(map(tuple, streamed.collect())) == [(1, "a"), (2, "b")]
