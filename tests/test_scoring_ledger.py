import pytest
from pyspark.sql import functions as F

from casework.operators import scoring
from casework.operators.prompts import messages


def requests(spark, rows):
    df = spark.createDataFrame(rows, "id long, model_id string, ask string")
    return df.select("id", "model_id", messages(F.lit("s"), F.col("ask")).alias("messages"))


def counting(folder):
    """A model that notes each request in a file of its own."""
    import uuid
    from pathlib import Path

    folder.mkdir(exist_ok=True)
    where = str(folder)

    def factory(model_id):
        def reply(asked):
            for request in asked:
                Path(where, uuid.uuid4().hex).write_text(f"{model_id}|{request[-1]['content']}")
            if any(r[-1]["content"] == "bad" and not Path(where, "mended").exists() for r in asked):
                raise ValueError("bad")
            return [f"{model_id}:{r[-1]['content']}" for r in asked]

        return reply

    return factory


def asked(folder):
    return sorted(f.read_text() for f in folder.iterdir() if f.name != "mended")


def test_a_second_run_asks_nothing(spark, tmp_path):
    rows = [(i, "ab"[i % 2], f"q{i // 6}") for i in range(60)] + [(99, None, "q"), (100, "a", None)]
    df, calls, ledger = requests(spark, rows), tmp_path / "calls", str(tmp_path / "ledger")
    first = scoring.score_once(df, counting(calls), ledger, slices=3)
    assert first.columns == [*df.columns, "reply", "error"]
    got = {r.id: r.reply for r in first.collect()}
    plain = {r.id: r.reply for r in scoring.score(df, counting(tmp_path / "other")).collect()}
    assert got == plain and len(got) == len(rows)
    # Each distinct request once, however often it stands in the table.
    assert len(asked(calls)) == len({(m, q) for _, m, q in rows}) and len(set(asked(calls))) == len(asked(calls))
    before = asked(calls)
    again = scoring.score_once(df.union(df), counting(calls), ledger, slices=5)
    assert again.count() == 2 * len(rows) and asked(calls) == before
    more = requests(spark, [*rows, (200, "a", "new")])
    assert {r.id: r.reply for r in scoring.score_once(more, counting(calls), ledger).collect()} == got | {200: "a:new"}
    assert len(asked(calls)) == len(before) + 1


def test_failed_requests_are_asked_again(spark, tmp_path):
    df, calls, ledger = requests(spark, [(1, "a", "bad"), (2, "a", "good")]), tmp_path / "calls", str(tmp_path / "ledger")
    first = {r.id: (r.reply, r.error) for r in scoring.score_once(df, counting(calls), ledger).collect()}
    assert first == {1: (None, "ValueError: bad"), 2: ("a:good", None)}
    (calls / "mended").touch()
    n = len(asked(calls))
    second = {r.id: (r.reply, r.error) for r in scoring.score_once(df, counting(calls), ledger).collect()}
    assert second == {1: ("a:bad", None), 2: ("a:good", None)}
    assert asked(calls)[:0] == [] and len(asked(calls)) == n + 1


def test_a_job_that_dies_keeps_the_slices_before(spark, tmp_path):
    df, calls, ledger = requests(spark, [(i, "a", f"q{i}") for i in range(40)]), tmp_path / "calls", str(tmp_path / "ledger")
    score, left = scoring.score, [2]

    def dying(*args):
        if not left[0]:
            raise RuntimeError("lost")
        left[0] -= 1
        return score(*args)

    scoring.score = dying
    try:
        with pytest.raises(RuntimeError, match="lost"):
            scoring.score_once(df, counting(calls), ledger, slices=4)
    finally:
        scoring.score = score
    n = len(asked(calls))
    assert 0 < n < 40
    assert {r.id: r.reply for r in scoring.score_once(df, counting(calls), ledger, slices=4).collect()} == {i: f"a:q{i}" for i in range(40)}
    assert len(asked(calls)) == 40
    assert scoring.score_once(df.limit(0), counting(calls), str(tmp_path / "empty")).count() == 0
