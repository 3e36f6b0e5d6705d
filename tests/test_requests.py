from casework.operators import prompts


def test_no_request_without_speaker_or_instruction(spark):
    dispatches = spark.createDataFrame(
        [(1, "finance", "pay"), (2, "finance", None), (3, "finance", ""), (4, None, "pay"), (5, "ghost", "pay")],
        "case_id long, next_speaker string, instruction string",
    )
    registry = spark.createDataFrame([("finance", "You pay.", "fin")], "name string, system_prompt string, role string")
    routing = spark.createDataFrame([("fin", "m")], "role string, model_id string")
    sent = prompts.worker_requests(dispatches, registry, routing, "d").collect()
    assert [(r["case_id"], r["messages"][1]["content"]) for r in sent] == [(1, "pay")]
