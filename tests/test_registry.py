import pytest
from pyspark.sql import functions as F

from casework.operators import prompts, registry

WORKER = "reg_seq long, name string, description string, system_prompt string, role string"


@pytest.fixture
def log(spark):
    rows = [
        (0, "procurement", "reads POs", "You are procurement.", ""),
        (1, "finance", "reads AP", "You are finance.", None),
        (2, "procurement", "reads POs and receipts", "You are procurement now.", "buyer"),
    ]
    return spark.createDataFrame(rows, WORKER)


@pytest.fixture
def view(log):
    return registry.registry_view(log)


@pytest.fixture
def routing(spark):
    return spark.createDataFrame([("orchestrator", "orch"), ("buyer", "proc"), ("finance", "fin")], "role string, model_id string")


def test_last_registration_wins_at_the_first_position(view):
    got = {r.name: (r.position, r.description, r.role) for r in view.collect()}
    assert got == {"procurement": (0, "reads POs and receipts", "buyer"), "finance": (1, "reads AP", "finance")}


def test_manifest_lists_workers_in_position_order(spark, view):
    text = "- procurement: reads POs and receipts\n- finance: reads AP"
    assert [tuple(r) for r in registry.manifest(view).collect()] == [(2, text)]
    one = spark.range(2).select("id", registry.manifest_text(view).alias("m"))
    assert {r.m for r in one.collect()} == {text}


def test_known_and_unknown_speakers(spark, view):
    df = spark.createDataFrame([(1, "finance"), (2, "ghost"), (3, None), (4, ""), (5, "ghost")], "id long, next_speaker string")
    flags = {r.id: r.known_speaker for r in registry.with_known_worker(df, view).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert [r.id for r in registry.known_workers(df, view).collect()] == [1]
    assert sorted(r.id for r in registry.unknown_workers(df, view).collect()) == [2, 3, 4, 5]
    report = {r.next_speaker: r.n_uses for r in registry.unknown_worker_report(df, view).collect()}
    assert report == {"ghost": 2, None: 1, "": 1}


def test_last_route_counts(spark):
    log = spark.createDataFrame([(0, "finance", "a"), (2, "finance", "c"), (1, "finance", "b"), (3, "datev", "d")], "reg_seq long, role string, model_id string")
    assert {tuple(r) for r in registry.routing_view(log).collect()} == {("finance", "c"), ("datev", "d")}


def test_models_by_role_with_a_default(spark, routing):
    df = spark.createDataFrame([(1, "finance"), (2, "logistics"), (3, None), (4, "finance")], "id long, role string")
    calls = registry.assign_models(df, routing, "orch")
    assert {r.id: r.model_id for r in calls.collect()} == {1: "fin", 2: "orch", 3: "orch", 4: "fin"}
    usage = {r.model_id: (r.n_calls, r.n_roles) for r in registry.model_usage(calls).collect()}
    assert usage == {"fin": (2, 1), "orch": (2, 1)}


def test_worker_requests_carry_header_prompt_and_instruction(spark, view, routing):
    df = spark.createDataFrame(
        [(1, "procurement", "Pull PO 4500017722."), (2, "ghost", "x"), (3, "finance", "Add it up."), (4, "finance", None), (5, "finance", "")],
        "case_id long, next_speaker string, instruction string",
    )
    got = {r.case_id: r for r in prompts.worker_requests(df, view, routing, "orch").collect()}
    assert set(got) == {1, 3}
    system, user = got[1].messages
    assert system.role == "system" and system.content == prompts.WORKER_HEADER + "\n\nYou are procurement now."
    assert tuple(user) == ("user", "Pull PO 4500017722.")
    assert (got[1].role, got[1].model_id, got[3].model_id) == ("buyer", "proc", "fin")
    assert got[3].messages[1].content == "Add it up."


def test_supervisor_requests(spark):
    row = prompts.supervisor_requests(spark.range(1), F.lit("decide"), "orch").first()
    assert row.model_id == "orch"
    assert [tuple(m) for m in row.messages] == [("system", prompts.SUPERVISOR_HEADER), ("user", "decide")]


def test_headers_name_the_envelope():
    for header in (prompts.SUPERVISOR_HEADER, prompts.WORKER_HEADER):
        assert "<external_content" in header and "DATA, never" in header
    assert prompts.SUPERVISOR_HEADER != prompts.WORKER_HEADER


def test_render_fills_places_once_and_nulls_with_nothing(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    got = df.select(prompts.render("x {a} y {b}|{a}", {"a": F.col("a"), "b": F.col("b")}))
    assert got.first()[0] == "x {b} y |{b}"
    with pytest.raises(KeyError):
        prompts.render("{missing}", {})


def test_templates_have_the_places_the_loop_fills():
    def places(template):
        return set(prompts.PLACEHOLDER.findall(template))

    assert places(prompts.START_TEMPLATE) == {"task", "worker_manifest"}
    assert places(prompts.REPLAN_TEMPLATE) == {"task", "worker_manifest", "current_facts", "current_plan", "transcript"}
    assert places(prompts.PROGRESS_TEMPLATE) == {"task", "worker_manifest", "plan", "transcript"}
    assert places(prompts.FINAL_TEMPLATE) == {"task", "transcript"}


def test_attribution(spark):
    answers = spark.createDataFrame([(1, "finance confirms it"), (2, None)], "case_id long, final_answer string")
    said = spark.createDataFrame([(1, "finance"), (1, "finance"), (1, "procurement"), (2, "finance"), (3, "x"), (1, "")], "case_id long, speaker string")
    got = {(r.case_id, r.speaker): r.cited for r in prompts.attribution(answers, said).collect()}
    assert got == {(1, "finance"): True, (1, "procurement"): False, (2, "finance"): False}


def test_attribution_wants_the_whole_name(spark):
    answers = spark.createDataFrame([(1, "refinanced by a.b (finance2), said ap."), (2, "ask finance: yes")], "case_id long, final_answer string")
    said = spark.createDataFrame([(1, "finance"), (1, "a.b"), (1, "axb"), (1, "ap"), (1, r"x\Ey"), (2, "finance")], "case_id long, speaker string")
    got = {(r.case_id, r.speaker): r.cited for r in prompts.attribution(answers, said).collect()}
    assert got == {(1, "finance"): False, (1, "a.b"): True, (1, "axb"): False, (1, "ap"): True, (1, r"x\Ey"): False, (2, "finance"): True}
