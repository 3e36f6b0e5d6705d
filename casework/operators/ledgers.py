"""Task ledgers: plan steps, what a revision changed, and the inputs of the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import first_match
from .registry import with_known_worker
from .skew import WIDE_ROWS_PER_CHUNK, OrderedLog, row_hash

# Fixed value: what stands for a missing ledger.
NO_LEDGER = "(none)"
STEP = r"(?s)^\[([^\]]+)\]\s*(.*)$"


def plan_steps(ledgers: DataFrame, registry: DataFrame | None = None, keys: Sequence[str] = ("case_id", "revision")) -> DataFrame:
    """One row per plan step: ``keys, step, worker, text`` and ``known`` when a registry is given.

    A step without a ``[worker]`` prefix has a null worker and keeps its text.
    """
    rows = ledgers.select(*keys, F.posexplode("plan").alias("step", "_line"))
    worker = first_match("_line", STEP, 1)
    steps = rows.select(
        *keys,
        F.col("step").cast("bigint").alias("step"),
        worker.alias("worker"),
        F.when(worker.isNull(), F.col("_line")).otherwise(F.regexp_extract("_line", STEP, 2)).alias("text"),
    )
    return steps if registry is None else with_known_worker(steps, registry, "worker", "known")


def steps_per_worker(steps: DataFrame, case: str = "case_id") -> DataFrame:
    """Steps and cases per planned worker, counted per case first."""
    per_case = steps.groupBy("worker", "known", case).agg(F.count(F.lit(1)).alias("_n"))
    return per_case.groupBy("worker", "known").agg(
        F.sum("_n").alias("n_steps"), F.count(F.lit(1)).alias("n_cases")
    )


def revision_delta(
    ledgers: DataFrame,
    case: str = "case_id",
    revision: str = "revision",
    rows_per_chunk: int = WIDE_ROWS_PER_CHUNK,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """Per revision after the first: facts learned and dropped, plan steps repeated verbatim.

    ``counts_from``: see ``OrderedLog.ranged``; use it when ``ledgers`` is costly to read.
    """
    log = OrderedLog.ranged(
        ledgers.select(case, revision, "facts", "plan"), case, revision,
        rows_per_chunk=rows_per_chunk, counts_from=counts_from,
    )
    before = log.neighbour({"_facts": "facts", "_plan": "plan", "_revision": revision})
    df = before.result.where(F.col("_revision").isNotNull())
    return df.select(
        case,
        revision,
        F.array_except("facts", "_facts").alias("learned"),
        F.array_except("_facts", "facts").alias("dropped"),
        F.array_intersect("plan", "_plan").alias("repeated_steps"),
    )


def latest_ledgers(ledgers: DataFrame, case: str = "case_id", revision: str = "revision") -> DataFrame:
    """The row of the highest revision per case; among equal revisions the one of a fixed hash.

    Spark drops rows that cannot be the latest before it shuffles them.
    """
    order = Window.partitionBy(case).orderBy(F.col(revision).desc(), row_hash(ledgers))
    return ledgers.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def replan_inputs(
    cases: DataFrame, ledgers: DataFrame, case: str = "case_id", revision: str = "revision"
) -> DataFrame:
    """Per case: facts and plan of the latest ledger as text, and the next revision.

    A case without a ledger shows ``(none)`` and starts at revision 1; a
    ledger with an empty list shows the empty string.
    """
    latest = latest_ledgers(ledgers.select(case, revision, "facts", "plan"), case, revision)
    joined = cases.select(case).join(latest, case, "left")
    return joined.select(
        case,
        F.coalesce(F.array_join("facts", "\n"), F.lit(NO_LEDGER)).alias("current_facts"),
        F.coalesce(F.array_join("plan", "\n"), F.lit(NO_LEDGER)).alias("current_plan"),
        (F.coalesce(F.col(revision), F.lit(0)) + 1).cast("bigint").alias("next_revision"),
    )

