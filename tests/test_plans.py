"""What the plans must and must not contain."""

import re

import pytest

from casework.operators import replay
from casework.plans.queries import QUERIES

from .conftest import DATA
from .test_replay import table, random_cases


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("envelope_audit", "struct<text:string,lang:string,source:string>"),
        ("stall_runs", "struct<event_id:bigint,user_id:bigint,event_type:string>"),
        ("po_invoice_recon", "struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>"),
        ("attribution", "struct<conv_id:bigint,role:string>"),
        ("source_domain_reject", "struct<doc_id:bigint,source:string>"),
    ],
)
def test_scans_read_only_what_is_needed(spark, name, columns):
    assert columns in plan(QUERIES[name](spark, DATA))


@pytest.mark.parametrize(
    ("name", "filters"),
    [
        ("po_invoice_recon", "EqualTo(l_linestatus,F)"),
        ("dunning", "EqualTo(o_orderstatus,O)"),
        ("requests", "EqualTo(role,user)"),
    ],
)
def test_filters_reach_the_scan(spark, name, filters):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", formatted(QUERIES[name](spark, DATA)))
    assert any(filters in p for p in pushed)


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_replay_shuffles_its_rows_once(spark):
    steps = table(spark, random_cases(1, 5, 30))
    once = plan(replay.replay_trace(steps), final=True).split("== Initial Plan ==")[0]
    assert once.count("Exchange hashpartitioning") == 1
    # Cut into chunks: the rows once more, by chunk and reused, and one row per chunk.
    cut = plan(replay.replay_trace(steps, rows_per_chunk=5), final=True).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in cut


@pytest.mark.parametrize("name", ["prior_context", "prior_context_log", "final_summary", "registry_view", "replan_inputs"])
def test_texts_take_no_sort_aggregate(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    # One makes vendor records unique, on the vendor table.
    assert "SortAggregate" not in text.replace("SortAggregate(key=[vendor_id", "")


def test_a_flow_shows_its_priors_without_a_shuffle(spark):
    text = plan(QUERIES["prior_context"](spark, DATA))
    assert text.count("hashpartitioning") == 1 and "hashpartitioning(vendor_id" in text


def test_stages_of_a_flow_add_no_shuffle(spark):
    text = plan(QUERIES["composed_task"](spark, DATA))
    # The one shuffle makes vendor ids unique, on the broadcast side; cases stay where they are.
    assert text.count("hashpartitioning") == 1 and "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    assert "doc_id" not in text[text.index("hashpartitioning") :]
