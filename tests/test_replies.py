import json
import random
import re

import pytest

from casework.functions import replies as rp
from casework.operators import ledgers

pydantic = pytest.importorskip("pydantic")


class Progress(pydantic.BaseModel):
    is_request_satisfied: bool
    is_in_loop: bool
    is_progress_being_made: bool
    next_speaker: str | None = None
    instruction_or_question: str | None = None
    final_answer: str | None = None
    reasoning: str = ""


class Ledger(pydantic.BaseModel):
    facts: list[str] = []
    guesses: list[str] = []
    plan: list[str] = []
    revision: int = 0


def plain_parse(raw, model, forbidden):
    """What a lenient typed model makes of a raw reply, or None."""
    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", raw, flags=re.M).strip()
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if not isinstance(data, dict) or any(k in data for k in forbidden):
        return None
    try:
        return model(**data).model_dump()
    except pydantic.ValidationError:
        return None


VALUES = [
    "true", "false", "null", "0", "1", "2", "1.0", "0.5", '"yes"', '"NO"', '"maybe"', '" true"', '"on"', '"f"', '"x"', '""',
    "[]", '["a"]', '["a", null]', '["a", 1]', "[null]", "[1]", "{}", '"3"', '"3.0"', '"3.5"', '" 4 "', '"1_0"', '"1__0"', '"+5"', "3.0", "3.5", "-2", "1e2",
]


def random_replies(names, n, seed):
    rng = random.Random(seed)
    good = {"flag": ["true", "false", '"yes"', "1"], "text": ['"a"', "null"], "list": ['["a", "b"]', "[]"], "int": ["3", '"4"']}
    kinds = {
        **dict.fromkeys(["is_request_satisfied", "is_in_loop", "is_progress_being_made"], "flag"),
        **dict.fromkeys(["facts", "guesses", "plan"], "list"),
        "revision": "int",
    }
    out = []
    for _ in range(n):
        items = []
        for name in names:
            if rng.random() < 0.08:
                continue
            pool = VALUES if rng.random() < 0.2 else good[kinds.get(name, "text")]
            items.append(f'"{name}": {rng.choice(pool)}')
            if rng.random() < 0.03:
                items.append(f'"{name}": {rng.choice(VALUES)}')
        if rng.random() < 0.1:
            items.append('"confidence": 0.5')
        if rng.random() < 0.05:
            items.append('"task": "again"')
        rng.shuffle(items)
        raw = "{" + ", ".join(items) + "}"
        shape = rng.random()
        if shape < 0.1:
            raw = f"```json\n{raw}\n```"
        elif shape < 0.15:
            raw = f"  ```{raw}```  "
        elif shape < 0.18:
            raw += " x"
        elif shape < 0.2:
            raw = f"[{raw}]"
        elif shape < 0.22:
            raw = raw.replace('"', "'")
        elif shape < 0.24:
            raw = raw[:-1] + ",}"
        elif shape < 0.26:
            raw = f"{raw},{raw}"
        out.append(raw)
    return out + ["", "null", "3", '"x"', "[]", "{}", "{", "}{", "{}]", "NaN", "nul", "{}\n{}", '{"a": 01}', "text ```json\n{}\n```"]


@pytest.mark.parametrize(
    ("kind", "model", "seed"),
    [(rp.PROGRESS, Progress, 1), (rp.FIRST_LEDGER, Ledger, 2), (rp.NEXT_LEDGER, Ledger, 3)],
    ids=["progress", "first", "next"],
)
def test_parsing_equals_a_lenient_typed_model(spark, kind, model, seed):
    raws = random_replies(kind.names, 2500, seed)
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    parsed = rp.parse_replies(df, "raw", kind).collect()
    accepted = 0
    for row in parsed:
        expected = plain_parse(raws[row.id], model, kind.forbidden)
        got = None if row.reason else {n: row[n] for n in kind.names}
        if expected is not None:
            accepted += 1
            expected = {n: expected[n] for n in kind.names}
        assert got == expected, (raws[row.id], row.reason)
    assert 300 < accepted < 2500


def reasons(spark, kind, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    return [r.reason for r in rp.parse_replies(df, "raw", kind).orderBy("id").collect()]


def test_reasons(spark):
    flags = '"is_request_satisfied": true, "is_in_loop": false, "is_progress_being_made": true'
    assert reasons(
        spark, rp.PROGRESS,
        "{%s}" % flags, "no json", "[1]", '"text"', "{%s} x" % flags, '{"is_request_satisfied": true}',
        '{%s, "next_speaker": 3}' % flags, '{"is_request_satisfied": null, %s}' % flags[30:], '{%s, "reasoning": null}' % flags, None,
    ) == [
        None, "not_json", "not_object", "not_object", "not_json", "missing:is_in_loop",
        "type:next_speaker", "type:is_request_satisfied", "type:reasoning", "not_json",
    ]
    assert reasons(spark, rp.FIRST_LEDGER, '{"task": "x"}', '{"revision": 2}', '{"facts": null}') == ["key_collision", None, "type:facts"]
    assert reasons(spark, rp.NEXT_LEDGER, '{"task": "x"}', '{"revision": 2}', '{"plan": "x"}') == ["key_collision", "key_collision", "type:plan"]


def test_accepted_and_quarantined_are_all_rows(spark):
    df = spark.createDataFrame([(1, "{}"), (2, "x"), (3, '{"facts": ["a"]}')], "id long, raw string")
    parsed = rp.parse_replies(df, "raw", rp.NEXT_LEDGER)
    assert {(r.id, tuple(r.facts)) for r in rp.accepted(parsed).collect()} == {(1, ()), (3, ("a",))}
    refused = rp.quarantined(parsed, rp.NEXT_LEDGER)
    assert refused.columns == ["id", "raw", "reason"]
    assert [r.id for r in refused.collect()] == [2]


LEDGER = "case_id long, revision long, facts array<string>, guesses array<string>, plan array<string>"


@pytest.fixture
def logged(spark):
    rows = [
        (1, 0, ["a", "b"], [], ["[procurement] count the pallets", "close"]),
        (1, 1, ["a", "c"], [], ["[finance] ask the bank\nagain", "close"]),
        (2, 0, [], [], []),
    ]
    return spark.createDataFrame(rows, LEDGER)


def test_plan_steps_and_workers(spark, logged):
    registry = spark.createDataFrame([("procurement",)], "name string")
    steps = ledgers.plan_steps(logged, registry)
    got = sorted((tuple(r) for r in steps.collect()), key=str)
    assert got == [
        (1, 0, 0, "procurement", "count the pallets", True),
        (1, 0, 1, None, "close", False),
        (1, 1, 0, "finance", "ask the bank\nagain", False),
        (1, 1, 1, None, "close", False),
    ]
    counts = {r.worker: (r.known, r.n_steps, r.n_cases) for r in ledgers.steps_per_worker(steps).collect()}
    assert counts == {"procurement": (True, 1, 1), "finance": (False, 1, 1), None: (False, 2, 1)}


def test_revision_delta(logged):
    rows = ledgers.revision_delta(logged).collect()
    assert [tuple(r) for r in rows] == [(1, 1, ["c"], ["b"], ["close"])]


def test_replan_inputs(spark, logged):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    got = {r.case_id: tuple(r)[1:] for r in ledgers.replan_inputs(cases, logged).collect()}
    assert got == {
        1: ("a\nc", "[finance] ask the bank\nagain\nclose", 2),
        2: ("", "", 1),
        3: ("(none)", "(none)", 1),
    }
