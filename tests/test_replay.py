import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casework.operators import ledgers, replay, scoring

STEP = (
    "case_id long, seq long, is_request_satisfied boolean, is_in_loop boolean, is_progress_being_made boolean, "
    "known_speaker boolean, instruction string"
)

# (satisfied, in loop, progress, known speaker, instruction)
GO = (False, False, True, True, "ask")
STALL = (False, True, False, True, "again")
LOST = (False, False, True, False, "ask a ghost")
DONE = (True, False, True, False, None)
SILENT = (False, False, True, True, None)


def table(spark, cases):
    rows = [(c, s, *step) for c, steps in cases.items() for s, step in enumerate(steps)]
    return spark.createDataFrame(rows, STEP)


def walk(steps, max_stalls, max_replans):
    """The loop one step at a time."""
    stall = replans = 0
    over = False
    for satisfied, looping, progress, known, _ in steps:
        if over:
            yield "after_terminal", None, None
            continue
        stall = stall + 1 if looping or not progress else 0
        if satisfied:
            route, over = "finalize:satisfied", True
        elif known and stall < max_stalls:
            route = "dispatch"
        elif replans >= max_replans:
            route, over = "finalize:budget", True
        else:
            route, stall, replans = "replan", 0, replans + 1
        yield route, stall, replans


def traced(df, **options):
    got = {}
    for r in replay.replay_trace(df, **options).orderBy("case_id", "seq").collect():
        got.setdefault(r.case_id, []).append((r.route, r.stall_count, r.replan_count))
    return got


def test_named_runs(spark):
    cases = {
        1: [GO, DONE],
        2: [GO, STALL, STALL, GO, DONE],
        3: [LOST],
        4: [STALL, STALL, STALL, STALL, STALL, STALL, GO],
        5: [SILENT, SILENT],
    }
    got = traced(table(spark, cases))
    assert [r for r, *_ in got[1]] == ["dispatch", "finalize:satisfied"]
    assert [r for r, *_ in got[2]] == ["dispatch", "dispatch", "replan", "dispatch", "finalize:satisfied"]
    assert got[2][-1] == ("finalize:satisfied", 0, 1)
    assert got[3] == [("replan", 0, 1)]
    assert [r for r, *_ in got[4]] == ["dispatch", "replan", "dispatch", "replan", "dispatch", "finalize:budget", "after_terminal"]
    assert got[4][-2] == ("finalize:budget", 2, 2)
    assert [r for r, *_ in got[5]] == ["dispatch", "dispatch"]


def test_budget_of_one(spark):
    got = traced(table(spark, {1: [STALL, STALL]}), max_stalls=1, max_replans=1)
    assert got[1] == [("replan", 0, 1), ("finalize:budget", 1, 1)]


def random_cases(seed, n, longest):
    rng = random.Random(seed)
    cases = {}
    for c in range(n):
        bad, ghost, done = rng.random(), rng.random() * 0.4, rng.random() * 0.05
        cases[c] = [
            (rng.random() < done, rng.random() < bad / 2, rng.random() > bad / 2, rng.random() > ghost, rng.choice(["x", "", None]))
            for _ in range(rng.randint(1, longest))
        ]
    return cases


@pytest.mark.parametrize(("max_stalls", "max_replans"), [(2, 2), (1, 1), (3, 40), (5, 0), (0, 3)])
@pytest.mark.parametrize("rows_per_chunk", [None, 7])
def test_trace_equals_walking_step_by_step(spark, max_stalls, max_replans, rows_per_chunk):
    cases = random_cases(max_stalls * 10 + max_replans, 120, 60)
    options = {"rows_per_chunk": rows_per_chunk} if rows_per_chunk else {}
    got = traced(table(spark, cases), max_stalls=max_stalls, max_replans=max_replans, **options)
    assert got == {c: list(walk(steps, max_stalls, max_replans)) for c, steps in cases.items()}


def test_chunks_with_gaps_and_far_outliers(spark):
    rng = random.Random(3)
    cases = random_cases(11, 20, 80)
    rows, expected = [], {}
    for c, steps in cases.items():
        places = sorted(rng.sample(range(1000), len(steps)))
        places[-1] += 10**15
        rows += [(c, s, *step) for s, step in zip(places, steps)]
        expected[c] = list(walk(steps, 2, 2))
    df = spark.createDataFrame(rows, STEP)
    assert traced(df, rows_per_chunk=5) == expected


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 3])
def test_rows_without_a_case_are_kept(spark, rows_per_chunk):
    df = table(spark, {1: [GO] * 10}).unionByName(table(spark, {1: [GO, STALL]}).withColumn("case_id", F.lit(None).cast("long")))
    got = traced(df, rows_per_chunk=rows_per_chunk)
    assert len(got[1]) == 10 and [r for r, *_ in got[None]] == ["dispatch", "dispatch"]


def test_two_steps_at_one_place_fail(spark):
    df = table(spark, {1: [GO]}).unionByName(table(spark, {1: [STALL]}))
    with pytest.raises(PySparkException, match="duplicate seq in case 1"):
        replay.replay_trace(df).collect()


def test_summary_and_run_summary(spark):
    df = table(spark, {1: [GO, STALL, DONE, GO], 2: [STALL], 3: [STALL] * 9})
    summary = replay.replay_summary(replay.replay_trace(df))
    got = {r.case_id: r.asDict() for r in summary.collect()}
    assert (got[1]["outcome"], got[1]["ended_at"], got[1]["n_dispatched"], got[1]["n_after_terminal"]) == ("finalize:satisfied", 2, 2, 1)
    assert (got[2]["outcome"], got[2]["ended_at"], got[2]["stall_count"]) == ("open", None, 1)
    assert (got[3]["outcome"], got[3]["replan_count"], got[3]["stall_count"]) == ("finalize:budget", 2, 2)

    answers = spark.createDataFrame([(1, "Cleared."), (3, None)], "case_id long, final_answer string")
    texts = spark.createDataFrame([(1, 2, "a\nb")], "case_id long, n_lines long, transcript string")
    plans = spark.createDataFrame([(1, 3, ["f"]), (1, 4, ["g"]), (2, 1, [])], "case_id long, revision long, facts array<string>")
    ran = replay.run_summary(summary, answers, texts, ledgers.latest_ledgers(plans))
    rows = {r.case_id: r for r in ran.collect()}
    assert (rows[1].summary, rows[1].n_transcript_rows, rows[1].transcript) == ("Cleared.", 2, "a\nb")
    assert (rows[2].summary, rows[2].n_transcript_rows, rows[2].transcript) == ("(no answer produced)", 0, "(empty)")
    assert tuple(rows[1].task_ledger) == (4, ["g"]) and tuple(rows[2].task_ledger) == (1, []) and rows[3].task_ledger is None
    # An answer row stands even when it is null.
    assert rows[3].summary is None


def test_only_dispatches_with_an_instruction_add_rows(spark):
    df = spark.createDataFrame([("dispatch", "x"), ("dispatch", None), ("dispatch", ""), ("replan", "x")], "route string, i string")
    assert df.where(replay.with_instruction(F.col("route"), F.col("i"))).count() == 1


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 4])
def test_stall_runs_equal_plain_python(spark, rows_per_chunk):
    cases = random_cases(5, 40, 50)
    expected = set()
    for c, steps in cases.items():
        start = None
        for i, (_, looping, progress, *_rest) in enumerate([*steps, GO]):
            stalled = looping or not progress
            if stalled and start is None:
                start = i
            elif not stalled and start is not None:
                expected.add((c, start, i - 1, i - start))
                start = None
    got = replay.stall_runs(table(spark, cases), rows_per_chunk=rows_per_chunk).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 3])
def test_repeated_steps_treat_nulls_as_equal(spark, rows_per_chunk):
    said = [("a", None), ("a", None), ("a", ""), ("b", ""), ("b", ""), (None, None), (None, None)]
    df = spark.createDataFrame([(1, i, *s) for i, s in enumerate(said)], "case_id long, seq long, next_speaker string, instruction string")
    rows = replay.repeated_steps(df, same=("next_speaker", "instruction"), rows_per_chunk=rows_per_chunk).orderBy("seq").collect()
    assert [r.repeats_previous for r in rows] == [False, True, False, False, True, False, True]


def echo(model_id):
    if model_id == "absent":
        raise LookupError("no such model")

    def model(requests):
        texts = [r[-1]["content"] for r in requests]
        if "boom" in texts:
            raise ValueError("bad request")
        return [f"  {model_id}: {t}\n" for t in texts]

    return model


REQUEST = "id long, model_id string, messages array<struct<role: string, content: string>>, final_answer string"


def ask(text):
    return [("system", "s"), ("user", text)]


def test_scoring_keeps_every_row_and_records_errors(spark):
    rows = [(1, "m", ask("hi"), None), (2, "m", ask("boom"), None), (3, "absent", ask("x"), None), (4, "n", ask("yo"), None)]
    df = spark.createDataFrame(rows, REQUEST).coalesce(1)
    for partitions in (None, 3):
        got = {r.id: (r.reply, r.error) for r in scoring.score(df, echo, partitions).collect()}
        assert got == {
            1: ("  m: hi\n", None), 2: (None, "ValueError: bad request"),
            3: (None, "LookupError: no such model"), 4: ("  n: yo\n", None),
        }


def test_final_answers_ask_only_where_none_is_given(spark):
    rows = [(1, "absent", ask("x"), "given"), (2, "m", ask("q"), None), (3, "m", ask("r"), "")]
    got = {r.id: (r.final_answer, r.origin, r.error) for r in scoring.final_answers(spark.createDataFrame(rows, REQUEST), echo).collect()}
    assert got == {1: ("given", "given", None), 2: ("m: q", "model", None), 3: ("m: r", "model", None)}
