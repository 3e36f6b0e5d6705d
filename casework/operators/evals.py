"""Measure field accuracy against labels and how a workflow performs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def field_accuracy(
    predictions: DataFrame, labels: DataFrame, key: str, workflow: str, fields: Sequence[str]
) -> DataFrame:
    """Accuracy per workflow and field with subtotals. ``level`` tells them apart from
    null workflows: 0 a workflow's field, 1 a whole workflow, 3 everything.

    Both tables are unique on ``key`` and hold every field; ``predictions``
    also hold ``workflow``. Two nulls agree. Each pair of rows is counted for
    all fields at once and only the counts are unpivoted.
    """
    p, g = predictions.alias("p"), labels.alias("g")
    joined = p.join(g, F.col(f"p.{key}") == F.col(f"g.{key}"))
    per_workflow = joined.groupBy(F.col(f"p.{workflow}").alias("workflow")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(f"p.{f}").eqNullSafe(F.col(f"g.{f}"))).alias(f"_ok_{f}") for f in fields],
    )
    counts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_ok_{f}").alias("ok")) for f in fields])
    return (
        per_workflow.select("workflow", "_n", F.inline(counts))
        .rollup("workflow", "field")
        .agg(F.sum("_n").alias("n_values"), F.sum("ok").alias("n_correct"), F.grouping_id().alias("_level"))
        .withColumn("accuracy", F.col("n_correct") / F.col("n_values"))
        .withColumnRenamed("_level", "level")
        .select("workflow", "field", "n_values", "n_correct", "accuracy", "level")
    )


def workflow_rates(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates per group from flags ``escalated`` and ``was_exception`` and a ``cost_cents``.

    Straight-through cases were not escalated; a false positive was escalated
    without being an exception, measured against the routine cases.
    """
    routine = ~F.col("was_exception")
    counted = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.col("escalated")).alias("n_escalated"),
        F.count_if(routine).alias("n_routine"),
        F.count_if(F.col("escalated") & routine).alias("n_false_positive"),
        F.sum("cost_cents").cast("bigint").alias("cost_cents"),
    )
    return counted.select(
        *by,
        "n_cases",
        (1 - F.col("n_escalated") / F.col("n_cases")).alias("straight_through_rate"),
        (F.col("n_escalated") / F.col("n_cases")).alias("escalation_rate"),
        F.when(F.col("n_routine") > 0, F.col("n_false_positive") / F.col("n_routine")).alias("false_positive_rate"),
        (F.col("cost_cents") / F.col("n_cases")).alias("cents_per_case"),
    )
