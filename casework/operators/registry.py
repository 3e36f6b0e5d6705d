"""Worker registry, known and unknown speakers, and model assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_filled, text_or_empty
from .skew import BROADCAST_ROWS, ROWS_PER_CHUNK, lookup
from .transcripts import join_lines

WORKER_FIELDS = ("description", "system_prompt", "role")


def registry_view(log: DataFrame) -> DataFrame:
    """Registrations in ``reg_seq`` order to one row per worker name.

    A later registration replaces the values but keeps the position of the
    first. A worker without a role has its name as role.
    """
    fields = [c for c in WORKER_FIELDS if c in log.columns]
    rows = log.select("name", "reg_seq", *fields)
    # Ranked alone, so that Spark drops rows that cannot be the last before it
    # shuffles them; first places come from a partial aggregate.
    newest = Window.partitionBy("name").orderBy(F.col("reg_seq").desc())
    last = rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").select(F.col("name").alias("_name"), *fields)
    first = rows.groupBy("name").agg(F.min("reg_seq").alias("position"))
    view = first.join(last, F.col("name").eqNullSafe(F.col("_name"))).select("name", "position", *fields)
    role = F.col("role") if "role" in fields else F.lit(None).cast("string")
    return view.withColumn("role", F.when(is_filled(role), role).otherwise(F.col("name")))


def manifest(registry: DataFrame) -> DataFrame:
    """``n_workers, manifest``: one ``- name: description`` line per worker, in position order."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), text_or_empty("description"))
    rows = registry.select(F.lit("workers").alias("_all"), "position", line.alias("_text"))
    joined = join_lines(rows, "_all", "position", F.col("_text"), "manifest")
    return joined.select(F.col("n_lines").alias("n_workers"), "manifest")


def manifest_text(registry: DataFrame) -> Column:
    """The manifest as a scalar for prompts: computed once, not joined to every row."""
    return manifest(registry).select("manifest").scalar()


def with_known_worker(
    df: DataFrame, registry: DataFrame, speaker: str = "next_speaker", out: str = "known_speaker",
    broadcast_rows: int = BROADCAST_ROWS, rows_per_task: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Flag rows whose speaker is non-empty and registered."""
    names = registry.select(F.col("name").alias(speaker), F.lit(True).alias("_known")).distinct()
    joined = lookup(df, names, speaker, "left", broadcast_rows, rows_per_task)
    flag = F.coalesce(F.col("_known"), F.lit(False)) & is_filled(speaker)
    return joined.select(*df.columns, F.coalesce(flag, F.lit(False)).alias(out))


def known_workers(df: DataFrame, registry: DataFrame, speaker: str = "next_speaker", **bounds) -> DataFrame:
    names = registry.select(F.col("name").alias(speaker)).distinct()
    return lookup(df, names, speaker, "left_semi", **bounds).select(*df.columns)


def unknown_workers(df: DataFrame, registry: DataFrame, speaker: str = "next_speaker", **bounds) -> DataFrame:
    """Rows naming a worker nobody registered; a null name is nobody's too."""
    names = registry.select(F.col("name").alias(speaker)).distinct()
    return lookup(df, names, speaker, "left_anti", **bounds).select(*df.columns)


def unknown_worker_report(df: DataFrame, registry: DataFrame, speaker: str = "next_speaker") -> DataFrame:
    """Uses per unregistered name. Names are counted before the join, so no name is hot in it."""
    counts = df.groupBy(speaker).agg(F.count(F.lit(1)).alias("n_uses"))
    return unknown_workers(counts, registry, speaker)


def routing_view(log: DataFrame) -> DataFrame:
    """Routes set in ``reg_seq`` order to one model per role; the last one set counts."""
    return log.groupBy("role").agg(F.max_by("model_id", "reg_seq").alias("model_id"))


def assign_models(
    df: DataFrame, routing: DataFrame, default_model: str, role: str = "role",
    broadcast_rows: int = BROADCAST_ROWS, rows_per_task: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``model_id``: the one routed to the role, else the default.

    ``routing`` has one row per role; see ``routing_view``.
    """
    routes = routing.select(F.col("role").alias(role), F.col("model_id").alias("_model"))
    joined = lookup(df, routes, role, "left", broadcast_rows, rows_per_task)
    return joined.select(*df.columns, F.coalesce("_model", F.lit(default_model)).alias("model_id"))


def model_usage(calls: DataFrame, role: str = "role") -> DataFrame:
    """Calls and distinct roles per model, counted per (model, role) first."""
    per_role = calls.groupBy("model_id", role).agg(F.count(F.lit(1)).alias("_n"))
    return per_role.groupBy("model_id").agg(
        F.sum("_n").alias("n_calls"), F.count(role).alias("n_roles")
    )
